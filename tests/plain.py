"""A plain, slow lattice decoder to hold the array code against."""

from __future__ import annotations

import math

from lattica.plans.model import BOS, EOS, NORMAL, UNKNOWN, Model


def plain_candidates(m: Model, s: bytes, begin: int):
    text = s[begin:].decode()
    code = lambda ch: ord(ch) if ord(ch) < 65536 else 0
    mask = lambda ch: int(m.char_mask[code(ch)])
    space = int(m.char_mask[0x20])
    k = 0
    while k < len(text) and mask(text[k]) & space:
        k += 1
    if k == len(text):
        return []
    start = begin + len(text[:k].encode())
    rest = text[k:]
    kind = int(m.char_class[code(rest[0])])
    out = []
    raw = s[start:]
    for d in sorted(set(m.dict_id[m.dict_id >= 0].tolist())):
        for i, surface in enumerate(m.surfaces):
            if raw.startswith(surface):
                out += [(start, start + len(surface), e, NORMAL, kind) for e in range(m.first[i], m.first[i + 1]) if m.dict_id[e] == d]
    if out and not m.invoke[kind]:
        return out

    def unknown(n):
        end = start + len(rest[:n].encode())
        return [(start, end, e, UNKNOWN, kind) for e in range(m.unknown[kind], m.unknown[kind + 1])]

    group = None
    if m.group[kind]:
        n = 1
        while n < len(rest) and mask(rest[n]) & mask(rest[n - 1]):
            n += 1
        if n - 1 <= m.conf.max_grouping_size:
            out += unknown(n)
        group = n
    n = 1
    for _ in range(int(m.length[kind])):
        if n == group:
            break
        out += unknown(n)
        if n >= len(rest) or not mask(rest[n]) & mask(rest[0]):
            break
        n += 1
    if not out:
        out = unknown(1)
    return out


def plain_lattice(m: Model, s: bytes):
    """Nodes (begin, start, end, entry, stat, kind, id), best cost and previous node of each, edges into each."""
    nodes = [(0, 0, 0, -1, BOS, 0, 0)]
    cost, prev, into = [0], [-1], [[]]
    ends = {0: [0]}
    penalties = m.conf.penalties()
    at = lambda e, a: 0 if e < 0 else int(a[e])
    for p in range(len(s)):
        if p not in ends:
            continue
        for start, end, e, stat, kind in plain_candidates(m, s, p):
            k = len(nodes)
            nodes.append((p, start, end, e, stat, kind, k))
            local = int(m.cost[e]) + (penalties.get(int(m.pos[e]), 0) if start != p else 0)
            edges = [(left, int(m.matrix[at(nodes[left][3], m.right), m.left[e]]) + local) for left in ends[p]]
            best = min(edges, key=lambda x: (cost[x[0]] + x[1], -(nodes[x[0]][0] if nodes[x[0]][4] != BOS else -1), x[0]))
            cost.append(cost[best[0]] + best[1])
            prev.append(best[0])
            into.append(edges)
            ends.setdefault(end, []).append(k)
    last = max(p for p in ends if p <= len(s))
    edges = [(left, int(m.matrix[at(nodes[left][3], m.right), 0])) for left in ends[last]]
    best = min(edges, key=lambda x: (cost[x[0]] + x[1], -(nodes[x[0]][0] if nodes[x[0]][4] != BOS else -1), x[0]))
    nodes.append((last, len(s), len(s), -1, EOS, 0, len(nodes)))
    cost.append(cost[best[0]] + best[1])
    prev.append(best[0])
    into.append(edges)
    return nodes, cost, prev, into


def plain_best(m: Model, s: bytes):
    nodes, cost, prev, _ = plain_lattice(m, s)
    path, k = [], len(nodes) - 1
    while k >= 0:
        path.append(k)
        k = prev[k]
    return [nodes[k] for k in reversed(path)], cost[-1]


def plain_paths(m: Model, s: bytes):
    """(cost, nodes) of every path."""
    nodes, _, _, into = plain_lattice(m, s)
    done, stack = [], [(len(nodes) - 1, 0, (len(nodes) - 1,))]
    while stack:
        k, c, path = stack.pop()
        if not into[k]:
            done.append((c, path))
        for left, edge in into[k]:
            stack.append((left, c + edge, (left, *path)))
    return sorted(done)


def plain_marginals(m: Model, s: bytes, theta: float):
    paths = plain_paths(m, s)
    z = math.log(sum(math.exp(-theta * c) for c, _ in paths))
    out: dict[int, float] = {}
    for c, path in paths:
        for k in path:
            out[k] = out.get(k, 0.0) + math.exp(-theta * c - z)
    return out, z
