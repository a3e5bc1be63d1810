"""Word lattices of many sentences at once, as numpy arrays.

Candidates are found for a whole block of sentences together: hashes of all substrings of a length come from one running
sum, so a dictionary lookup is an array search per distinct surface length. The dynamic programs go through the block in
waves, one for each byte position, with array operations over all nodes that begin there in any sentence.

Rules: blanks before a token belong to it (rlength); a token's candidates are its dictionary entries, shorter surfaces
first, then unknown words by the class of its first character: the run of compatible characters if it is a grouping class and at most
max_grouping_size characters longer, prefixes of 1 to length characters of that class, else one character. Nodes no path reaches
are not made. Among equal costs the left node that begins last wins, then the one made first. Trailing blanks make no token and the
end attaches to the last position reached.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from lattica.plans.model import BOS, EOS, NORMAL, UNKNOWN, Model

_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
INFINITE = np.int64(1) << np.int64(60)
FILTER = 20
SPARSE = 150  # edges a wave below which single steps are faster


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Text:
    """A block of sentences in UTF-8 with hashes of any substring."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, sentences: list[bytes]):
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in sentences])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(sentences), np.uint8)
        self.sizes = np.diff(self.offsets)
        n = len(self.data) + 1
        if len(Text._up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("_up", _BASE), ("_down", inverse)):
                a = np.full(max(n, 1 << 20), base, np.uint64)
                a[0] = 1
                setattr(Text, name, np.cumprod(a))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUES[self.data] * Text._up[: n - 1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Text._down[start])


def parted(model: Model) -> bool:
    """Whether no token goes on over a blank that follows another character, so that every path passes the place before it."""
    return np.count_nonzero(model.char_mask & model.char_mask[0x20]) == 1 and not any(b" " in x for x in model.surfaces)


class Dictionary:
    """Surfaces of a model by length, for array lookups."""

    def __init__(self, model: Model):
        self.model = model
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.filter = np.zeros(1 << FILTER, bool)
        self.parted = parted(model)
        if model.surfaces:
            text = Text(model.surfaces)
            h = text.hashes(text.offsets[:-1], text.offsets[1:])
            self.filter[h & np.uint64((1 << FILTER) - 1)] = True
            for size in np.unique(text.sizes):
                at = np.flatnonzero(text.sizes == size)
                order = at[np.argsort(h[at], kind="stable")]
                heads = np.zeros(1 << 16, bool)
                first = text.data[text.offsets[at]].astype(np.int64)
                heads[first * 256 + (text.data[text.offsets[at] + 1] if size > 1 else 0)] = True
                if size == 1:
                    heads = np.repeat(heads.reshape(256, 256).any(1), 256)
                self.by_length.append((int(size), h[order], order, heads))

    def matches(self, text: Text, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into start, end, surface) of all entries that begin at the starts and end by the limits."""
        who, ends, found = [], [], []
        follow = np.append(text.data[1:], 0).astype(np.int64)
        pair = text.data[start].astype(np.int64) * 256 + np.where(start + 1 < limit, follow[start], 0) if len(start) else start
        for size, h, order, heads in self.by_length:
            at = np.flatnonzero(heads[pair] & (start + size <= limit))
            if not len(at):
                continue
            x = text.hashes(start[at], start[at] + size)
            maybe = self.filter[x & np.uint64((1 << FILTER) - 1)]
            at, x = at[maybe], x[maybe]
            k = np.minimum(np.searchsorted(h, x), len(h) - 1)
            hit = h[k] == x
            at = at[hit]
            who.append(at)
            ends.append(start[at] + size)
            found.append(order[k[hit]])
        if not who:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(who), np.concatenate(ends), np.concatenate(found)


@dataclass
class Chars:
    """Characters of a block."""

    at: np.ndarray  # byte place in the block
    end: np.ndarray
    sentence: np.ndarray
    code: np.ndarray  # 0 beyond the basic plane
    kind: np.ndarray
    mask: np.ndarray


def characters(text: Text, model: Model) -> Chars:
    d = text.data.astype(np.int64)
    at = np.flatnonzero((text.data & 0xC0) != 0x80)
    end = np.append(at[1:], len(d))
    pad = np.concatenate([d, np.zeros(4, np.int64)])
    b0, b1, b2 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63
    n = end - at
    code = np.select([n == 1, n == 2, n == 3], [b0, (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2], 0)
    sentence = np.searchsorted(text.offsets, at, "right") - 1
    return Chars(at, end, sentence, code, model.char_class[code].astype(np.int64), model.char_mask[code].astype(np.int64))


def _next_where(flag: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest index >= i with flag, at most stop[i]."""
    n = len(flag)
    nxt = np.where(flag, np.arange(n), n)
    return np.minimum(np.minimum.accumulate(nxt[::-1])[::-1], stop) if n else nxt


def _ranges(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Candidates:
    """Candidate tokens of every position of a block (places in bytes of the block)."""

    sentence: np.ndarray
    begin: np.ndarray  # with leading blanks
    start: np.ndarray
    end: np.ndarray
    entry: np.ndarray
    stat: np.ndarray
    kind: np.ndarray  # class of the first character


def unknown_spans(c: Chars, model: Model, last: np.ndarray, heads: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which of the heads want unknown words; of each span the index into those, the character after its last one, the step: 0 the run, 1 to length a prefix, 1 << 20 a single character).

    last: the index after the last character of each character's sentence; hit: heads that dictionary entries begin at."""
    want = ~hit | model.invoke[c.kind[heads]]
    n, h = len(c.at), heads[want]
    kind = c.kind[h]
    with_next = np.zeros(n, bool)  # character i goes on from i - 1
    if n:
        with_next[1:] = (c.mask[1:] & c.mask[:-1]) != 0
        with_next[1:] &= c.sentence[1:] == c.sentence[:-1]
    run_end = _next_where(~with_next, last)
    after = h + 1
    group_end = np.where(after < last[h], run_end[np.minimum(after, n - 1)], after) if n else after
    group_end = np.where((after < last[h]) & with_next[np.minimum(after, n - 1)] if n else False, group_end, after)
    group = model.group[kind]
    fits = group & (group_end - after <= model.conf.max_grouping_size)
    who_u, end_u, step_u = [np.flatnonzero(fits)], [group_end[fits]], [np.zeros(int(fits.sum()), np.int64)]
    alive = np.ones(len(h), bool)
    longest = model.length[kind]
    made = fits.copy()
    end = after.copy()
    for i in range(1, int(longest.max()) + 1 if len(h) else 1):
        alive &= longest >= i
        alive &= ~(group & (end == group_end))  # the run's own end is there already, and nothing follows it
        at = np.flatnonzero(alive)
        who_u.append(at)
        end_u.append(end[at])
        step_u.append(np.full(len(at), i))
        made |= alive
        go = alive & (end < last[h])
        go[go] = (c.mask[end[go]] & c.mask[h[go]]) != 0
        alive = go
        end = np.where(alive, end + 1, end)
    single = np.flatnonzero(~made & ~hit[want])
    who_u.append(single)
    end_u.append(after[single])
    step_u.append(np.full(len(single), 1 << 20))
    return want, np.concatenate(who_u), np.concatenate(end_u), np.concatenate(step_u)


def candidates(text: Text, dictionary: Dictionary, chars: Chars | None = None) -> Candidates:
    """All candidates of all character positions, in order of making within a position."""
    model = dictionary.model
    c = chars or characters(text, model)
    n = len(c.at)
    last = np.searchsorted(c.sentence, np.arange(len(text.sizes)), "right")[c.sentence] if n else np.zeros(0, np.int64)  # index after the sentence's last character
    blank = (c.mask & model.char_mask[0x20]) != 0
    head = _next_where(~blank, last)  # first character that isn't blank
    pos = np.flatnonzero(head < last)
    first = head[pos]  # the token's first character
    heads, inverse = np.unique(first, return_inverse=True)  # look up once for all positions of a blank run
    who, ends, surface = dictionary.matches(text, c.at[heads], text.offsets[c.sentence[heads] + 1])
    entries = model.first[surface + 1] - model.first[surface]
    hit = np.zeros(len(heads), bool)
    hit[who] = True
    known_head = np.repeat(who, entries)
    known_end = np.repeat(ends, entries)
    known_entry = np.repeat(model.first[surface], entries) + _ranges(entries)
    known_rank = known_end - c.at[heads[known_head]] if len(who) else known_end
    # dictionaries in turn, then shorter surfaces, then entry order
    known_order = np.stack([model.dict_id[known_entry], known_rank, known_entry]) if len(who) else np.zeros((3, 0), np.int64)
    # unknown words of the heads
    want, wu, eu, su = unknown_spans(c, model, last, heads, hit)
    kind = c.kind[heads[want]]
    rows = model.unknown[kind[wu] + 1] - model.unknown[kind[wu]]
    back = np.flatnonzero(want)
    unk_head = np.repeat(back[wu], rows)
    unk_end = np.repeat(c.end[eu - 1] if len(eu) else eu, rows)
    unk_entry = np.repeat(model.unknown[kind[wu]], rows) + _ranges(rows)
    big = np.int64(1) << 40
    unk_order = np.stack([np.full(len(unk_head), big), np.repeat(su, rows), unk_entry])
    head_of = np.concatenate([known_head, unk_head])
    ends_of = np.concatenate([known_end, unk_end])
    entry_of = np.concatenate([known_entry, unk_entry])
    stat = np.concatenate([np.full(len(known_head), NORMAL), np.full(len(unk_head), UNKNOWN)])
    a, b, d = np.concatenate([known_order, unk_order], 1)
    order = np.lexsort((d, b, a, head_of))
    head_of, ends_of, entry_of, stat = head_of[order], ends_of[order], entry_of[order], stat[order]
    per_head = np.bincount(head_of, minlength=len(heads))
    begins_at = np.cumsum(per_head) - per_head
    per_pos = per_head[inverse] if len(pos) else np.zeros(0, np.int64)
    take = np.repeat(begins_at[inverse], per_pos) + _ranges(per_pos) if len(pos) else np.zeros(0, np.int64)
    place = np.repeat(pos, per_pos)
    char = heads[head_of[take]] if len(take) else take
    return Candidates(c.sentence[place], c.at[place], c.at[char], ends_of[take], entry_of[take], stat[take], c.kind[char])


class Lattice:
    """Reachable nodes of a block with costs, best paths, and on demand edges and probabilities.

    Nodes are ordered by sentence and then by making: BOS, tokens by begin, EOS. Places count bytes from the sentence's begin.
    """

    def __init__(self, sentences: list[bytes], dictionary: Dictionary, constraints: list | None = None):
        self.model, self.text = dictionary.model, Text(sentences)
        m, text = self.model, self.text
        c = candidates(text, dictionary)
        base = text.offsets[:-1]
        n = len(sentences)
        if constraints:
            c, virtual = _constrained(c, text, dictionary, constraints)
        else:
            virtual = {}
        # BOS of every sentence, then its tokens
        who = np.concatenate([np.arange(n), c.sentence])
        order = np.lexsort((np.concatenate([np.full(n, -1), np.arange(len(c.sentence))]), np.concatenate([np.full(n, -1), c.begin]), who))
        pick = lambda bos, rest: np.concatenate([bos, rest])[order]
        zero, minus = np.zeros(n, np.int64), np.full(n, -1)
        self.sentence = who[order]
        self.begin = pick(zero, c.begin - base[c.sentence])
        self.start = pick(zero, c.start - base[c.sentence])
        self.end = pick(zero, c.end - base[c.sentence])
        self.entry = pick(minus, c.entry)
        self.stat = pick(np.full(n, BOS), c.stat)
        self.kind = pick(zero, c.kind)
        self.virtual = {}
        if virtual:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.virtual = {int(place[n + k]): v for k, v in virtual.items()}
        self._costs()
        self._prune_and_end()

    def _attributes(self) -> None:
        m, real = self.model, self.entry >= 0
        e = np.where(real, self.entry, 0)
        take = lambda a: np.where(real, a[e], 0) if len(a) else np.zeros(len(e), np.int64)
        self.left, self.right, self.pos, self.wcost = take(m.left), take(m.right), take(m.pos), take(m.cost)
        penalty = np.zeros(len(e), np.int64)
        for pos, cost in m.conf.penalties().items():
            penalty[real & (self.pos == pos) & (self.start != self.begin)] = cost
        self.local = self.wcost + penalty

    def _edges_into(self, nodes: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left node, index into nodes) for left nodes that end at the positions, best ties first."""
        slot = self.text.offsets[:-1] + np.arange(len(self.text.sizes))  # a sentence of n bytes has n + 1 positions
        by_end = np.flatnonzero(self.stat != EOS)
        keys = slot[self.sentence[by_end]] + self.end[by_end]
        order = np.lexsort((-self._first_key[by_end], keys))
        by_end = by_end[order]
        upto = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(self.text.data) + len(slot)))])
        wanted = slot[self.sentence[nodes]] + position
        lo = upto[wanted]
        count = upto[wanted + 1] - lo
        return by_end[np.repeat(lo, count) + _ranges(count)], np.repeat(np.arange(len(nodes)), count)

    def _costs(self) -> None:
        """Best costs and predecessors by waves of begins."""
        self._attributes()
        self._first_key = np.where(self.stat == BOS, -1, self.begin)
        tokens = np.flatnonzero(self.stat != BOS)
        tokens = tokens[np.argsort(self.begin[tokens], kind="stable")]
        left, to = self._edges_into(tokens, self.begin[tokens])
        right = tokens[to]
        edge = self.model.matrix[self.right[left], self.left[right]] + self.local[right]
        self.cost, self.prev = np.full(len(self.entry), INFINITE), np.full(len(self.entry), -1)
        self.cost[self.stat == BOS] = 0
        if len(right):
            heads = np.flatnonzero(np.r_[True, right[1:] != right[:-1]])  # first edge of each node
            wave_of = self.begin[right[heads]]
            cuts = np.flatnonzero(np.r_[True, wave_of[1:] != wave_of[:-1]])
            bounds = np.append(heads[cuts], len(right))
            node_bounds = np.append(cuts, len(heads))
            if len(right) < SPARSE * len(cuts):
                self._one_by_one(left, right, edge)
                cuts = cuts[:0]
            for w in range(len(cuts)):
                a, b = bounds[w], bounds[w + 1]
                first = heads[node_bounds[w] : node_bounds[w + 1]] - a
                total = self.cost[left[a:b]] + edge[a:b]
                low = np.minimum.reduceat(total, first)
                counts = np.diff(np.append(first, b - a))
                best = np.flatnonzero(total == np.repeat(low, counts))
                owner = np.repeat(np.arange(len(first)), counts)[best]
                best = best[np.r_[True, owner[1:] != owner[:-1]]]
                nodes = right[a + first]
                ok = low < INFINITE // 2
                self.cost[nodes] = np.where(ok, low, INFINITE)
                self.prev[nodes] = np.where(ok, left[a + best], -1)
        if ((self.cost > 2147483646) & (self.cost < INFINITE // 2)).any():
            raise ValueError("too long sentence.")

    def _one_by_one(self, left: np.ndarray, right: np.ndarray, edge: np.ndarray) -> None:
        """The same over single edges, for blocks whose waves are too thin for array operations."""
        cost, prev = self.cost.tolist(), self.prev.tolist()
        for a, b, c in zip(left.tolist(), right.tolist(), edge.tolist(), strict=True):
            c += cost[a]
            if c < cost[b]:
                cost[b], prev[b] = c, a
        self.cost, self.prev = np.array(cost, np.int64), np.array(prev, np.int64)
        self.cost[self.cost >= INFINITE // 2] = INFINITE
        self.prev[self.cost == INFINITE] = -1

    def _prune_and_end(self) -> None:
        n = len(self.text.sizes)
        keep = self.cost < INFINITE // 2
        new = np.cumsum(keep) - 1
        reach = np.zeros(n, np.int64)
        np.maximum.at(reach, self.sentence[keep], self.end[keep])
        size = np.bincount(self.sentence[keep], minlength=n)
        slot = np.cumsum(size)  # EOS of sentence i goes after its last node
        put = lambda a, v: np.insert(a[keep], slot, v)
        prev = np.where(self.prev >= 0, new[self.prev], -1)
        prev = prev[keep]
        prev = np.where(prev >= 0, prev + self.sentence[keep][np.maximum(prev, 0)], -1)
        self.virtual = {int(new[k] + self.sentence[k]): v for k, v in self.virtual.items() if keep[k]}
        ids = np.arange(n)
        self.sentence, self.stat, self.entry = put(self.sentence, ids), put(self.stat, EOS), put(self.entry, -1)
        self.begin, self.start, self.end = put(self.begin, reach), put(self.start, self.text.sizes), put(self.end, self.text.sizes)
        self.kind, self.cost = put(self.kind, 0), put(self.cost, INFINITE)
        self.prev = np.insert(prev, slot, -1)
        self.eos = slot + ids
        self.bos = np.concatenate([[0], self.eos[:-1] + 1]) if n else self.eos
        self._attributes()
        self._first_key = np.where(self.stat == BOS, -1, self.begin)
        left, to = self._edges_into(self.eos, reach)
        right = self.eos[to]
        total = self.cost[left] + self.model.matrix[self.right[left], self.left[right]]
        heads = np.flatnonzero(np.r_[True, right[1:] != right[:-1]]) if len(right) else np.zeros(0, np.int64)
        if len(heads):
            low = np.minimum.reduceat(total, heads)
            counts = np.diff(np.append(heads, len(total)))
            best = np.flatnonzero(total == np.repeat(low, counts))
            owner = np.repeat(np.arange(len(heads)), counts)[best]
            best = best[np.r_[True, owner[1:] != owner[:-1]]]
            self.cost[right[heads]], self.prev[right[heads]] = low, left[best]
        self.id = np.arange(len(self.stat)) - np.repeat(self.bos, self.eos - self.bos + 1)

    def best(self) -> np.ndarray:
        """Nodes of the best paths, BOS and EOS included, in order."""
        on = [self.eos]
        now = self.prev[self.eos]
        while len(now := now[now >= 0]):
            on.append(now)
            now = self.prev[now]
        return np.sort(np.concatenate(on))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, cost) of all edges; cost includes the right node's word cost and blank penalty."""
        nodes = np.flatnonzero(self.stat != BOS)
        left, to = self._edges_into(nodes, self.begin[nodes])
        right = nodes[to]
        return left, right, self.model.matrix[self.right[left], self.left[right]] + self.local[right]

    def marginals(self, theta: float | None = None):
        """alpha, beta, node probabilities (float32), edges with probabilities, and log Z of each sentence."""
        theta = self.model.conf.theta if theta is None else theta
        left, right, cost = self.edges()
        score = -theta * cost
        n = len(self.stat)
        alpha, beta = np.full(n, -np.inf), np.full(n, -np.inf)
        alpha[self.bos], beta[self.eos] = 0.0, 0.0
        # end positions of EOS come after every token that begins there
        wave = np.where(self.stat == EOS, self.text.sizes[self.sentence] + 1, self.begin)
        order = np.lexsort((right, wave[right]))
        _waves(alpha, left[order], right[order], score[order], wave[right[order]])
        order = np.lexsort((left, -self._last_key()[left]))
        _waves(beta, right[order], left[order], score[order], -self._last_key()[left[order]])
        z = alpha[self.eos]
        with np.errstate(invalid="ignore"):
            node = np.exp(alpha + beta - z[self.sentence])
            edge = np.exp(alpha[left] + score + beta[right] - z[self.sentence[right]])
        return alpha.astype(np.float32), beta.astype(np.float32), np.nan_to_num(node).astype(np.float32), (left, right, cost, np.nan_to_num(edge).astype(np.float32)), z

    def _last_key(self) -> np.ndarray:
        return np.where(self.stat == EOS, np.int64(1) << 40, self.end)

    def nbest(self, sentence: int, n: int) -> list[tuple[int, list[int]]]:
        """Up to n cheapest paths of a sentence: (cost, nodes).

        A path is the tree of best predecessors with side steps, each of which costs what its edge costs beyond the best edge into its node. From every
        path found, the n cheapest side steps after its last one are candidates, gathered for all its nodes at once."""
        import heapq

        if not 1 <= n <= 512:
            raise ValueError("n must be between 1 and 512")
        if not hasattr(self, "_side"):
            left, right, cost = self.edges()
            extra = self.cost[left] + cost - self.cost[right]
            order = np.lexsort((extra, right))
            at = np.searchsorted(right[order], np.arange(len(self.stat) + 1))
            best = np.full(len(self.stat), -1)
            some = np.flatnonzero(np.diff(at))
            best[some] = left[order][at[some]]
            self._side = left[order], extra[order], at, best.tolist()
        left, extra, at, best = self._side

        def down(node: int) -> list[int]:
            out = []
            while node >= 0:
                out.append(node)
                node = best[node]
            return out

        found = [(0, down(int(self.eos[sentence])))]
        heap, made, first = [], 0, 0
        while len(found) < n:
            more, path = found[-1]
            nodes = np.array(path[first:], np.int64)
            begin = at[nodes] + 1
            size = np.maximum(at[nodes + 1] - begin, 0)
            edge = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = np.repeat(np.arange(first, len(path)), size)
            step = extra[edge]
            if len(step) > n:
                cheap = np.argpartition(step, n - 1)[:n]
                edge, place, step = edge[cheap], place[cheap], step[cheap]
            for d, i, e in zip(step.tolist(), place.tolist(), edge.tolist(), strict=True):
                made += 1
                heapq.heappush(heap, (more + d, made, len(found) - 1, i, e))
            if not heap:
                break
            more, _, parent, i, e = heapq.heappop(heap)
            found.append((more, found[parent][1][: i + 1] + down(int(left[e]))))
            first = i + 1
        total = int(self.cost[self.eos[sentence]])
        return [(total + more, path[::-1]) for more, path in found]

    def paths(self, sentence: int):
        """All paths of a sentence as (cost, nodes), cheapest first, made as they are asked for; backwards A* whose bound is the exact best cost."""
        import heapq

        if not hasattr(self, "_by_right"):
            left, right, cost = self.edges()
            order = np.argsort(right, kind="stable")
            self._by_right = left[order], cost[order], np.searchsorted(right[order], np.arange(len(self.stat) + 1))
        left, cost, at = self._by_right
        eos = int(self.eos[sentence])
        heap = [(int(self.cost[eos]), 0, 0, eos, None)]
        made = 0
        while heap:
            total, _, behind, node, after = heapq.heappop(heap)
            path = (node, after)
            if self.stat[node] == BOS:
                nodes = []
                while path:
                    nodes.append(path[0])
                    path = path[1]
                yield total, nodes
                continue
            for k in range(at[node], at[node + 1]):
                made += 1
                gone = behind + int(cost[k])
                heapq.heappush(heap, (int(self.cost[left[k]]) + gone, made, gone, int(left[k]), path))

    def feature(self, node: int) -> str:
        if self.entry[node] < 0:
            return self.virtual.get(node, self.model.conf.bos_feature)
        return self.model.features[self.entry[node]]

    def surfaces(self, nodes: np.ndarray) -> list[str]:
        raw, base = self.text.data.tobytes(), self.text.offsets[self.sentence[nodes]]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip((base + self.start[nodes]).tolist(), (base + self.end[nodes]).tolist(), strict=True)]


def _waves(value: np.ndarray, source: np.ndarray, target: np.ndarray, score: np.ndarray, wave: np.ndarray) -> None:
    """value[target] = log of the sum of exp(value[source] + score), wave after wave; targets are contiguous within a wave."""
    if not len(target):
        return
    cuts = np.append(np.flatnonzero(np.r_[True, wave[1:] != wave[:-1]]), len(wave))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        t = target[a:b]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        x = value[source[a:b]] + score[a:b]
        top = np.maximum.reduceat(x, first)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            value[t[first]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, b - a)))), first))


INSIDE, TOKEN = 2, 1


def _constrained(c: Candidates, text: Text, dictionary: Dictionary, constraints: list) -> tuple[Candidates, dict[int, str]]:
    """Candidates that obey each sentence's constraints: (boundaries {byte: TOKEN or INSIDE}, features {begin: (end, pattern)}).

    Where nothing fits at a position, an unknown word over the following inside run is tried, then a token whose feature is the pattern itself."""
    from lattica.plans.model import csv_split

    model = dictionary.model

    @lru_cache(1 << 14)
    def fits(pattern: str, feature: str) -> bool:
        return pattern == "*" or all(a in ("*", b) for a, b in zip(csv_split(pattern), csv_split(feature), strict=False))

    rows, virtual = [], {}
    order = np.argsort(c.sentence, kind="stable")
    bounds = np.searchsorted(c.sentence[order], np.arange(len(text.sizes) + 1)).tolist()
    chars = characters(text, model)
    of = np.searchsorted(chars.sentence, np.arange(len(text.sizes) + 1)).tolist()  # characters of each sentence
    char_at, char_end = chars.at.tolist(), chars.end.tolist()
    every = list(zip(*(a[order].tolist() for a in (c.sentence, c.begin, c.start, c.end, c.entry, c.stat, c.kind)), strict=True))
    for s, given in enumerate(constraints):
        base, size = int(text.offsets[s]), int(text.sizes[s])
        tuples = every[bounds[s] : bounds[s + 1]]
        if not given:
            rows += tuples
            continue
        edges, features = given
        stops = sorted(p for p, k in edges.items() if k == TOKEN)

        def allowed(t, edges=edges, features=features, base=base):
            begin, end = t[1] - base, t[3] - base
            if edges.get(end) == INSIDE:
                return False
            if begin not in features:
                return True
            return edges.get(begin) == TOKEN and edges.get(end) == TOKEN and fits(features[begin][1], model.features[t[4]])

        by_begin: dict[int, list] = {}
        for t in tuples:
            by_begin.setdefault(t[1] - base, []).append(t)
        at = {char_at[k] - base: k for k in range(of[s], of[s + 1])}
        for begin in sorted(by_begin):
            after = bisect_right(stops, begin)
            limit = stops[after] if after < len(stops) else size
            inside = [t for t in by_begin[begin] if t[3] - base <= limit and t[2] - base < limit]
            good = [t for t in inside if allowed(t)]
            if not good and edges.get(begin) != INSIDE and by_begin[begin][0][2] - base < limit:
                _, b, start, _, _, _, kind = by_begin[begin][0]
                k = at[start - base]
                end = char_end[k] - base
                while end < limit and edges.get(end) == INSIDE:
                    k += 1
                    end = char_end[k] - base
                made = [(s, b, start, base + end, e, UNKNOWN, kind) for e in range(model.unknown[kind], model.unknown[kind + 1])]
                good = [t for t in made if allowed(t)]
                if not good and begin in features:
                    good = [(s, b, start, base + end, -2, UNKNOWN, kind)]
                    virtual[len(rows)] = features[begin][1]
            rows += good
    cols = np.array(rows, np.int64).reshape(-1, 7).T
    return Candidates(cols[0], cols[1], cols[2], cols[3], cols[4], cols[5], cols[6]), virtual
