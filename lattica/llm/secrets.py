"""Secrets in texts: fixed patterns, and dictionary-primed zstandard novelty.

Base spans follow three patterns (assign, access, hex), each leftmost and non-overlapping, kept if long enough.

Novelty spans: a candidate is a run of MINIMUM or more letters, digits and +/_=- that no base span touches, has both letters and
digits, and follows a sensitive word within CONTEXT characters on its line; of NAME=VALUE the value is one (and the name, if it is long
and follows another sensitive word). It is compressed by a zstandard compressor whose raw
dictionary is a list of common identifiers followed by the code around it (AROUND characters on each side, without the
candidate and its other copies, of which only words between separators stay). Its marginal bytes over those of an empty input, divided by
those of a random string of its length and alphabet, are its novelty; candidates of NOVELTY and more say something that neither the identifiers nor their surroundings do and are reported as kind ``novel``.

CONTEXT and AROUND are parameters of the method: how far a sensitive word reaches, and how much code a string is held against. Every
candidate of every text is judged; work grows in proportion to a text's length.

Positions are code points, ends exclusive. Defined results: a null text is empty; null and repeated ids pass through; equal texts have
equal spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches

# The three patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
_SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "signature", "session", "cookie")
_SENSITIVE_BYTES = tuple(x.encode() for x in _SENSITIVE)
_WORD = re.compile("(?ai:" + "|".join(_SENSITIVE) + ")")
MINIMUM, CONTEXT, AROUND, NOVELTY = 16, 48, 1024, 0.75
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_EQUALS = re.compile(r"=+")
_HEX_RUN = re.compile(rb"[0-9a-f]{16}")
IDENTIFIERS = (
    "access account address admin api application authorization backend bearer bucket cache callback certificate client cloud config connection "
    "content cookie credential credentials database default development device digest domain email encryption endpoint environment example expires "
    "filename function gateway handler header hostname identifier import instance integration internal json kubernetes localhost location login "
    "manager message method middleware module namespace network number object option package parameter password path permission platform policy "
    "private production profile protocol provider proxy public query redirect region release remote repository request resource response return role "
    "root schema secret security server service session setting signature source staging status storage string subscription system template tenant "
    "test timeout timestamp token transaction type update upload user username value variable version volume webhook worker 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; raw and low are the text's bytes and their lower-case form."""
    out = []
    if any(x in low for x in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    if _HEX_RUN.search(raw):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_ALPHABETS = (string.digits, "abcdef", "ABCDEF", string.ascii_lowercase, string.ascii_uppercase)
_NAME_PART = re.compile(r"(?<![^_/-])[A-Za-z]{4,}(?![^_/-])")
LONG = 1024  # the expectation a character of longer strings is that of this length


def _marginal(candidate: str, surroundings: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + surroundings, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


@lru_cache(maxsize=1 << 14)
def _random_rate(length: int, alphabet: str) -> float:
    """Marginal bytes per character of a random string; 1 where zstandard stores it plainly."""
    r = random.Random(f"{length} {alphabet}")
    return min(1.0, _marginal("".join(r.choice(alphabet) for _ in range(length)), b"") / length)


def _alphabet(candidate: str) -> str:
    """The smallest usual alphabet: digits, hexadecimal or all letters of each case, and the signs that occur."""
    used = set(candidate)
    out = [x for x, wide in zip(_ALPHABETS[:3], ("", *_ALPHABETS[3:]), strict=True) if used & set(x) and not used & (set(wide) - set(x))]
    out += [x for x in _ALPHABETS[3:] if used & (set(x) - set("abcdefABCDEF"))]
    return "".join(out) + "".join(sorted(used - set("".join(out))))


def novelty(candidate: str, before: str, after: str, around: int = AROUND) -> float:
    """Marginal compressed bytes of a candidate between its surroundings, as a share of a random string's."""
    words = ["\n"] * len(candidate)  # what stays of equal copies: names are explained by their parts, random strings are not
    for m in _NAME_PART.finditer(candidate):
        words[m.start() : m.end()] = m[0]
    words = "".join(words)
    before, after = (x.replace(candidate, words) for x in (before, after))
    expected = len(candidate) * _random_rate(min(len(candidate), LONG), _alphabet(candidate))
    return _marginal(candidate, after[:around].encode() + b"\n" + before[max(0, len(before) - around) :].encode()) / expected


def _candidates(text: str, context: int = CONTEXT) -> list[tuple[int, int]]:
    """Runs of MINIMUM and more characters after sensitive words, values without their names; they do not overlap.

    One pass from left to right; every search ends where a word's context does."""
    values, names = {}, set()  # end -> start of values, the innermost word's
    start, end = 0, 0
    for word in _WORD.finditer(text):
        if word.start() >= end:
            start = word.start()
            while start and text[start - 1] in _IN_RUN:
                start -= 1
            end = _RUN.match(text, start).end()
        stop = word.end() + context
        if (m := _EQUALS.search(text, word.end(), min(end, stop))) and m.end() < stop and end - m.end() >= MINIMUM:
            values[end] = max(m.end(), values.get(end, 0))
        b = end
        while b < stop and (first := _RUN.search(text, b, stop)):
            a = first.start()
            if text.find("\n", word.end(), a) >= 0:
                break
            b = first.end() if first.end() < stop else _RUN.match(text, a).end()
            if b - a < MINIMUM:
                continue
            if (m := _EQUALS.search(text, a, b)) and b - m.end() >= MINIMUM:
                if m.start() - a >= MINIMUM:
                    names.add((a, m.start()))
                a = m.end()
            values[b] = max(a, values.get(b, 0))
    return sorted({(a, b) for b, a in values.items()} | names)


def novel_spans(text: str, low: bytes, base: list[tuple[int, int, int]], context: int = CONTEXT, around: int = AROUND) -> list[tuple[int, int, int]]:
    """The candidates within context characters of a sensitive word that around characters on each side do not explain; base is sorted."""
    if not any(x in low for x in _SENSITIVE_BYTES):
        return []
    out = []
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))
    for a, b in _candidates(text, context):
        inner = text[a:b]
        before = bisect_left(starts, b)
        if before and furthest[before - 1] > a or not (any(c.isdigit() for c in inner) and any(c.isalpha() for c in inner)):
            continue
        if novelty(inner, text[max(0, a - around - (b - a) + 1) : a], text[b : b + around + (b - a) - 1], around) >= NOVELTY:
            out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, context: int = CONTEXT, around: int = AROUND) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, in order."""
    text = text or ""
    raw = text.encode()
    low = raw.lower()
    base = base_spans(text, raw, low)
    return base, sorted(base + novel_spans(text, low, base, context, around))


_SCHEMA = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])


def scan_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", context: int = CONTEXT, around: int = AROUND) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                base, every = scan(text.as_py(), context, around)
                counts = [sum(k == i for _, k, _ in every) for i in range(4)]
                found.append((*counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), counts[3]))
            columns = [pa.array([x[i] for x in found], f.type) for i, f in enumerate(_SCHEMA)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *_SCHEMA.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
