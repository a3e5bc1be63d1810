"""Best paths of sentences by their parts.

Where no token goes on over a blank that follows another character (``Dictionary.parted``), every path passes the place before such a
blank. Sentences are cut there, equal parts of a block are decoded once, and costs are put together: sums where there is one context,
products of context tables by minimum and sum where there are several. Results are those of the whole sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lattica.operators.lattice import INFINITE, Dictionary, Lattice
from lattica.plans.model import BOS, EOS

TOP = 2147483646
CONTEXTS = 8  # more are decoded as whole sentences


class Parts:
    """A block of sentences cut into parts, with the distinct ones."""

    def __init__(self, sentences: list[bytes]):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sentences])]).astype(np.int64)
        raw = b"".join(sentences)
        data = np.frombuffer(raw, np.uint8)
        blank = data == 0x20
        cut = np.zeros(len(data), bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(cut)
        one = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(raw)]).dictionary_encode()
        self.distinct, self.of = one.dictionary, one.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sentence = np.searchsorted(offsets, at, "right") - 1
        self.place = at - offsets[self.sentence]
        self.first = np.searchsorted(self.sentence, np.arange(len(sentences) + 1))
        self.empty = np.zeros(len(self.distinct), bool)  # blanks alone
        if len(at):
            self.empty[self.of] = np.add.reduceat(~blank, at, dtype=np.int64) == 0

    def per_sentence(self, value: np.ndarray) -> np.ndarray:
        """Sums over the parts of each sentence."""
        total = np.concatenate([[0], np.cumsum(value)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def before(self, value: np.ndarray) -> np.ndarray:
        """Sums over the parts before each part in its sentence."""
        total = np.cumsum(value) - value
        return total - total[self.first[:-1][self.sentence]] if len(total) else total


def _largest(lat: Lattice) -> np.ndarray:
    """Of each sentence, the largest cost of a node but the end, as a magnitude."""
    return np.maximum.reduceat(np.where(lat.stat == EOS, 0, np.abs(lat.cost)), lat.bos)


def costs(sentences: list[bytes], dictionary: Dictionary, blocks: Callable[[pa.Array], Iterator]) -> np.ndarray:
    """Costs of the cheapest paths."""
    m = dictionary.model
    ids = np.unique(np.append(m.right, 0))
    if not dictionary.parted or len(ids) > CONTEXTS:
        return _whole(sentences, dictionary)
    p, r = Parts(sentences), len(ids)
    table, large = np.full((len(p.distinct), r, r), INFINITE), np.zeros(len(p.distinct), np.int64)
    for which, texts in blocks(p.distinct):
        lat = Lattice(texts, dictionary)
        value = _by_context(lat, ids)
        last = np.flatnonzero((lat.stat != EOS) & (lat.stat != BOS) & (lat.end == lat.begin[lat.eos][lat.sentence]))
        part, right = which[lat.sentence[last]], np.searchsorted(ids, lat.right[last])
        for i in range(r):
            np.minimum.at(table[:, i], (part, right), value[last, i])
        large[which] = np.maximum.reduceat(np.abs(value).max(1), lat.bos)
    table[p.empty] = np.where(np.eye(r, dtype=bool), 0, INFINITE)
    limit = p.per_sentence(large[p.of] + int(np.abs(m.matrix).max()))
    if (limit > TOP).any():  # a node's cost may be too large
        return _whole(sentences, dictionary)
    value, owner = table[p.of], p.sentence
    while len(owner) and (owner[1:] == owner[:-1]).any():
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        even = np.flatnonzero(place % 2 == 0)
        pair = even[(even + 1 < len(owner)) & (np.append(owner, -1)[even + 1] == owner[even])]
        a, b = value[pair], value[pair + 1]
        both = np.full(a.shape, INFINITE)
        for k in range(r):
            np.minimum(both, a[:, :, k, None] + b[:, k, None, :], out=both)
        value[pair] = both
        value, owner = value[even], owner[even]
    out = np.full(len(sentences), int(m.matrix[0, 0]))
    start = int(np.searchsorted(ids, 0))
    out[owner] = (value[:, start] + m.matrix[ids, 0]).min(1)
    return out


def _by_context(lat: Lattice, ids: np.ndarray) -> np.ndarray:
    """Costs of all nodes (0 for the ends) after each right context before the sentence."""
    m = lat.model
    if len(ids) == 1:
        return np.where(lat.stat == EOS, 0, lat.cost)[:, None]
    left, right, edge = lat.edges()
    keep = np.flatnonzero(lat.stat[right] != EOS)
    keep = keep[np.argsort(lat.begin[right[keep]], kind="stable")]
    left, right, edge = left[keep], right[keep], edge[keep]
    value = np.zeros((len(lat.stat), len(ids)), np.int64)
    wave = lat.begin[right]
    cuts = np.append(np.flatnonzero(np.r_[True, wave[1:] != wave[:-1]]), len(wave)) if len(wave) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        to = right[a:b]
        if not wave[a]:  # after the sentence's begin alone
            value[to] = m.matrix[ids][:, lat.left[to]].T + lat.local[to, None]
            continue
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        value[to[first]] = np.minimum.reduceat(value[left[a:b]] + edge[a:b, None], first, axis=0)
    return value


def _whole(sentences: list[bytes], dictionary: Dictionary) -> np.ndarray:
    lat = Lattice(sentences, dictionary)
    return lat.cost[lat.eos]


NODE = ("begin", "start", "end", "entry", "stat", "kind", "left", "right", "pos", "wcost", "cost", "id")


class Best:
    """Tokens of the best paths of a block, as a lattice has its nodes: sentence, begin, ..., id; total costs; surfaces as strings."""

    def __init__(self, sentences: list[bytes], p: Parts, nodes: dict[str, np.ndarray], strings: pa.Array, counts: np.ndarray, cost: np.ndarray, made: np.ndarray, step: int):
        first = np.cumsum(counts) - counts
        n = counts[p.of]
        part = np.repeat(np.arange(len(p.of)), n)
        index = np.repeat(first[p.of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self._nodes, self._index, self._strings = nodes, index, strings
        self._shift = {"cost": p.before(cost[p.of])[part], "id": p.before(made[p.of])[part]} | dict.fromkeys(("begin", "start", "end"), p.place[part])
        self.sentence, self.virtual = p.sentence[part], {}
        self.total = p.per_sentence(cost[p.of]) + step

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in NODE:
            raise AttributeError(name)
        value = self._nodes[name][self._index]
        if name in self._shift:
            value = value + self._shift[name]
        setattr(self, name, value)
        return value

    def strings(self) -> pa.Array:
        return self._strings.take(pa.array(self._index))


def best(sentences: list[bytes], dictionary: Dictionary, blocks: Callable[[pa.Array], Iterator], strings: Callable) -> Best | None:
    """Tokens of the best paths; None where sentences can't be decoded by parts. strings(lattice, nodes): their surfaces."""
    m = dictionary.model
    if not dictionary.parted or m.matrix.shape != (1, 1):
        return None
    p, step = Parts(sentences), int(m.matrix[0, 0])
    size = len(p.distinct)
    cost, made, large, counts = (np.zeros(size, np.int64) for _ in range(4))
    found, texts_of, owner = [], [], []
    for which, texts in blocks(p.distinct):
        lat = Lattice(texts, dictionary)
        nodes = lat.best()
        nodes = nodes[(lat.stat[nodes] != BOS) & (lat.stat[nodes] != EOS)]
        cost[which] = np.where(p.empty[which], 0, lat.cost[lat.eos] - step)
        made[which], large[which] = lat.eos - lat.bos - 1, _largest(lat)
        counts[which] = np.bincount(lat.sentence[nodes], minlength=len(texts))
        found.append([getattr(lat, f)[nodes] for f in NODE])
        texts_of.append(strings(lat, nodes))
        owner.append(which[lat.sentence[nodes]])
    if (p.per_sentence(large[p.of] + abs(step)) > TOP).any():
        return None
    if not found:
        found, texts_of, owner = [[np.zeros(0, np.int64)] * len(NODE)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
    order = np.argsort(np.concatenate(owner), kind="stable")
    nodes = {f: np.concatenate([x[i] for x in found])[order] for i, f in enumerate(NODE)}
    return Best(sentences, p, nodes, pa.concat_arrays(texts_of).take(pa.array(order)), counts, cost, made, step)
