"""The 64-bit fingerprint of binary models: MurmurHash3 x86 128, lower half."""

from __future__ import annotations

M32 = 0xFFFFFFFF
SEED = 0xFD14DEFF
#: Fixed values of the public algorithm.
C = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
ROTATE_KEY = (15, 16, 17, 18)
ROTATE_STATE = (19, 17, 15, 13)
ADD = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & M32


def _mixed(k: int, i: int) -> int:
    return _rotl(k * C[i] & M32, ROTATE_KEY[i]) * C[(i + 1) % 4] & M32


def _final(h: int) -> int:
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


def murmur3_x86_128(data: bytes, seed: int) -> tuple[int, int, int, int]:
    """The four 32-bit words of the hash."""
    h = [seed] * 4
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        for i in range(4):
            h[i] ^= _mixed(int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little"), i)
            h[i] = (_rotl(h[i], ROTATE_STATE[i]) + h[(i + 1) % 4]) * 5 + ADD[i] & M32
    for i in range(4):
        rest = data[whole + 4 * i : whole + 4 * i + 4]
        if rest:
            h[i] ^= _mixed(int.from_bytes(rest, "little"), i)
    h = [x ^ len(data) for x in h]

    def spread():
        h[0] = sum(h) & M32
        for i in (1, 2, 3):
            h[i] = (h[i] + h[0]) & M32

    spread()
    h[:] = [_final(x) for x in h]
    spread()
    return tuple(h)


def fingerprint(text: str | bytes) -> int:
    a, b, _, _ = murmur3_x86_128(text.encode() if isinstance(text, str) else text, SEED)
    return b << 32 | a
