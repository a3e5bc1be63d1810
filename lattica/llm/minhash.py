"""Near-duplicate groups by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. profile: every text's set of word shingles (64-bit hashes), its digest and COORDINATES minima. Texts of equal sets are
   one node from here on.
2. postings: a node is posted under its (coordinate, value) pairs. Two nodes that agree in at least MATCHES coordinates
   have one in common among the COORDINATES - MATCHES + 1 rarest of each (prefix principle, in one global order by posting
   count); pairs that nobody else has take the first places and need no row. Common values of shared passages thus
   fall out unless they make up most of a text.
3. links, in linear rounds: each node is compared with one centre among its lists (another random order each round) and
   linked when the full sets confirm it. Lists whose nodes are all in one component can add nothing and are skipped.
4. merging: the posting lists that still join several components are merged with counters. Inside a list the rarest values come first
   again, by their count in that list, so that what all its members share takes no part: collisions in these shorter prefixes name
   the candidates, whose other coordinates are then counted once a list, and pairs of MATCHES and more are held against SKETCH further
   coordinates (a byte each). Of what is left, pairs that can't be links are refuted there and then: shingles are counted in COUNTS hash buckets
   a node, and the sum of the lesser counts is never below the number of common shingles. First each node's best partner is confirmed (BEST
   passes; in long lists other centres of its bands), which joins most of what belongs together; then all other pairs of different components that pass both thresholds and may be links. No pair is skipped but those
   already connected, so the components are those of all pairs.

Lists of more than PIECE nodes are never one task's work. LONG_ROUNDS further rounds of step 3 (none by default) can run on them while the components in them become fewer, to take the groups of
near copies out of them. The nodes that are left in long lists are posted once more, in one table of BANDS rows a node, by bands of BAND further minima each:
texts that have a passage in common but are not similar seldom agree in a whole band, so long lists of passages dissolve in linear work. In the last
round of step 3 each node also meets the centres of all its bands. What is longer still is compared in pieces of BLOCK nodes outside of a list's largest
component against BLOCK nodes of the whole list.

A pair of similarity 0.8 agrees in fewer than 36 of 64 coordinates about 4 times in a million (binomial tail); more similar ones
more rarely; it agrees in fewer than SKETCH_MATCHES of SKETCH, or WIDE_MATCHES of the first WIDE of them, or in no whole band, about 3 times in 10 millions each. A confirmed link is exact up to collisions of 64-bit hashes.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; texts of fewer words
than a shingle are one shingle; null ids take part, are never the smallest and are kept only if no other id is in their
component; repeated rows are rows of their own in one component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches, materialize, scratch

from .components import connected
from .textblocks import as_bytes, blocks, mix, word_hashes, word_spans

COORDINATES, MATCHES = 64, 36
SHINGLE, PERCENT = 5, 80
ROUNDS = 2
SKETCH, SKETCH_MATCHES = 512, 364  # five standard deviations below a similarity of 0.8
WIDE, WIDE_MATCHES = 256, 172  # the first of them; five standard deviations too
COUNTS = 1024  # buckets; the more shingles a text has, the weaker is the bound
BANDS, BAND = 50, 6  # a pair of similarity 0.8 has no whole band in common 3 times in ten millions
PIECE, BLOCK = 256, 512
LONG_ROUNDS, SHRINK, BEST = 0, 0.8, 1
CHUNK = 2048  # rows merged at a time
PAIRS, SLICE = 1 << 18, 1 << 13  # candidates at a time, and those compared at a time
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = np.random.default_rng(13).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block, rising inside each text, and where each text's begin (n + 1)."""
    starts, ends, before = word_spans(offsets, data)
    h = word_hashes(starts, ends, data)
    n = np.diff(before)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(before[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    there = n[doc]
    value = np.zeros(len(first), np.uint64)
    for j in range(k):
        value += np.where(j < there, padded[first + j], np.uint64(0)) * _ROLL[j]
    value = mix(value + np.minimum(there, k).astype(np.uint64))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _digests(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]).astype(np.uint64)
    return mix((sums[begins[1:]] - sums[begins[:-1]]) + np.diff(begins).astype(np.uint64)).view(np.int64)


def _profile(k: int):
    def run(batches):
        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            for a, b, offs, part in blocks(offsets, data):
                values, begins = shingle_sets(offs, part, k)
                n = np.diff(begins)
                some = np.flatnonzero(n)
                sig = np.zeros((b - a, COORDINATES), np.int32)
                if len(some):
                    at = begins[some]
                    for i, m in enumerate(_MULTIPLIERS):
                        sig[some, i] = (np.minimum.reduceat(values * m, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * COORDINATES, COORDINATES, dtype=np.int32)), pa.array(sig.reshape(-1)))
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), pa.array(n.astype(np.int64)), pa.array(_digests(values, begins)), lists], names=[*kept, "n", "node", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            for _, _, offs, part in blocks(offsets, data):
                values, begins = shingle_sets(offs, part, k)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(values, begins)), pa.array([raw[8 * i : 8 * j] for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.binary())], names=["node", "set"]
                )

    return run


def _minima(column: pa.Array, size: int, shift: int, dtype) -> np.ndarray:
    """(rows, size): the high bits of each set's minima under further hash functions."""
    offsets, raw = column.buffers()[1], column.buffers()[2]
    offsets = np.frombuffer(offsets, np.int32)[column.offset :][: len(column) + 1]
    values = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
    at = (offsets[:-1] - offsets[0]) // 8
    out = np.zeros((len(column), size), dtype)
    for lo in range(0, len(column), 64):  # 64 sets at a time stay in the cache
        hi = min(lo + 64, len(column))
        part = values[at[lo] : at[hi] if hi < len(column) else len(values)]
        for i, m in enumerate(_SKETCH[:size]):
            out[lo:hi, i] = np.minimum.reduceat(part * m, at[lo:hi] - at[lo]) >> np.uint64(shift)
    return out


def _bucket_counts(column: pa.Array) -> np.ndarray:
    """(rows, COUNTS): how many of a set's hashes are in each bucket; 255 stands for that many or more."""
    out = np.zeros((len(column), COUNTS), np.uint8)
    for i, x in enumerate(column):
        values = np.frombuffer(x.as_buffer(), np.uint64)
        out[i] = np.minimum(np.bincount((values % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS), 255)
    return out


def _may_link(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets with bucket counts x and y, of so many shingles together, may be similar enough. False is exact: no two sets have more in common than
    the sum of the lesser counts."""
    least = np.minimum(x, y)
    return ((100 + percent) * least.sum(1, dtype=np.int64) >= percent * sizes) | (least == 255).any(1)


def _sketches(batches):
    for batch in batches:
        low = _minima(batch.column("set"), SKETCH, 40, np.uint32).astype(np.uint8) if batch.num_rows else np.zeros((0, SKETCH), np.uint8)
        counts = _bucket_counts(batch.column("set"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (low, counts))], names=["node", "sketch", "counts"])


def _band_tokens(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            minima = _minima(part.column("set"), BANDS * BAND, 0, np.uint64).reshape(part.num_rows, BANDS, BAND)
            tokens = mix((mix(minima) * _ROLL[:BAND]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            node, n = (pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.reshape(-1).view(np.int64)), node, n], names=["token", "node", "n"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _prefixes(posted: DataFrame, matches: int) -> DataFrame:
    """posted (node, token): the rows of each node's prefix, without tokens that one node alone has."""
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most a signature each
    room = F.lit(1 - matches) + F.size("t")  # of the all - matches + 1 places of a prefix the node's own tokens take all - size first
    return mine.filter(room > 0).select("node", F.explode(F.slice("t", F.lit(1), room)).alias("p")).select("node", "p.token")


def postings(nodes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(token, node) of the prefix of each node, without tokens that one node alone has."""
    return _prefixes(nodes.select("node", F.posexplode("sig").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("token")), matches)


def _whole_lists(batches):
    """Tables of about CHUNK rows out of a stream sorted by token, lists uncut."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            token = table.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1], "left"))  # the last list may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _pairs_of(start: np.ndarray, follow: np.ndarray):
    """Index pairs (start, start + 1 to start + follow), at most about PAIRS at a time."""
    upto = np.cumsum(follow)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        n = follow[lo:hi]
        x = np.repeat(start[lo:hi], n)
        yield x, x + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def _candidates(g: np.ndarray, sig: np.ndarray, comp: np.ndarray, matches: int):
    """Pairs of rows of one list (g, rising) that collide in their prefixes and are in different components; repeats are possible."""
    n = len(g)
    token = ((g.astype(np.uint64)[:, None] * np.uint64(COORDINATES) + np.arange(COORDINATES, dtype=np.uint64)) << np.uint64(32)) | sig.view(np.uint32).astype(np.uint64)
    token = token.reshape(-1)
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1]])
    df = np.empty(len(token), np.int64)
    df[order] = np.repeat(np.diff(np.r_[first, len(token)]), np.diff(np.r_[first, len(token)]))
    entry = np.flatnonzero(df > 1)
    row = entry // COORDINATES
    shared = np.bincount(row, minlength=n)
    entry = entry[np.lexsort((token[entry], df[entry], row))]
    row = entry // COORDINATES
    place = np.arange(len(entry)) - np.repeat(np.cumsum(shared) - shared, shared)
    entry = entry[place < (shared - matches + 1)[row]]  # the row's prefix, after the tokens that are its own
    row = entry // COORDINATES
    # of two rows in different components, one is outside of their list's largest
    by = np.lexsort((comp, g))
    begin = np.flatnonzero(np.r_[True, (g[by][1:] != g[by][:-1]) | (comp[by][1:] != comp[by][:-1])])
    size = np.diff(np.r_[begin, n])
    rank = np.lexsort((-size, g[by][begin]))
    lead = begin[rank[np.r_[True, g[by][begin][rank][1:] != g[by][begin][rank][:-1]]]] if n else begin
    largest = np.zeros(int(g[-1]) + 1 if n else 0, comp.dtype)
    largest[g[by][lead]] = comp[by][lead]
    inside = comp == largest[g]
    order = np.lexsort((row, inside[row], token[entry]))  # outsiders lead their runs
    row, t = row[order], token[entry][order]
    last = np.r_[np.flatnonzero(t[1:] != t[:-1]), len(t) - 1] if len(t) else np.zeros(0, np.int64)
    ends = np.repeat(last, np.diff(np.r_[-1, last]))
    follow = np.where(inside[row], 0, ends - np.arange(len(t)))
    some = np.flatnonzero(follow)
    for a, b in _pairs_of(some, follow[some]):
        a, b = row[a], row[b]
        ok = comp[a] != comp[b]
        a, b = a[ok], b[ok]
        pair = np.sort(np.minimum(a, b) * n + np.maximum(a, b))
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair  # faster than np.unique, which hashes
        yield pair // max(n, 1), pair % max(n, 1)


def _merge(percent: int, matches: int, best: bool, counted: bool = False):
    """Pairs of whole lists that pass both thresholds: each node's most similar one of a list, or all. counted: only those that may be links by their bucket counts."""

    def named(x, y):
        a, b = np.minimum(x, y), np.maximum(x, y)
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        for table in _whole_lists(batches):
            table = table.combine_chunks()
            token, side, node, n, comp = (table.column(c).to_numpy() for c in ("token", "side", "node", "n", "comp"))
            g = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
            sig = np.ascontiguousarray(table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), COORDINATES))
            sketch, *counts = (np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(c)]) for c in ("sketch", "counts")[: 1 + counted])
            lists, own, seen = table.column("lists"), {}, np.zeros(0, np.int64)
            most, who = np.zeros(len(node), np.int64), np.full(len(node), -1)  # each row's most similar one so far
            for x, y in _candidates(g, sig, comp, matches):
                ok = ((side[x] & 1 & side[y] >> 1) | (side[y] & 1 & side[x] >> 1)) > 0
                ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[ok], y[ok]
                new = ~np.isin(x * len(node) + y, seen)  # pairs that collide again, in another part of the candidates
                x, y = x[new], y[new]
                for lo in range(0, len(x), SLICE):
                    u, v = x[lo : lo + SLICE], y[lo : lo + SLICE]
                    ok = (sig[u] == sig[v]).view(np.uint8).sum(1, dtype=np.uint8) >= matches  # at most COORDINATES
                    u, v = u[ok], v[ok]
                    ok = (sketch[u, :WIDE] == sketch[v, :WIDE]).sum(1) >= WIDE_MATCHES
                    u, v = u[ok], v[ok]
                    like = (sketch[u] == sketch[v]).sum(1)
                    ok = like >= SKETCH_MATCHES
                    u, v, like = u[ok], v[ok], like[ok]
                    seen = np.concatenate([seen, u * len(node) + v])
                    if counted:
                        ok = _may_link(counts[0][u], counts[0][v], n[u] + n[v], percent)
                        u, v, like = u[ok], v[ok], like[ok]
                    if not best:
                        for k in np.unique(np.r_[u, v]).tolist():
                            if k not in own:
                                own[k] = set(lists[k].as_py())
                        first = [min(own[a] & own[b]) == t for a, b, t in zip(u.tolist(), v.tolist(), token[u].tolist(), strict=True)]
                        yield named(node[u[first]], node[v[first]])  # a pair is named in one list of those that both are in
                        continue
                    u, v, like = np.r_[u, v], np.r_[v, u], np.r_[like, like]
                    order = np.lexsort((-node[v], like))  # the best one last, which stays
                    u, v, like = u[order], v[order], like[order]
                    better = like > most[u]
                    most[u[better]], who[u[better]] = like[better], v[better]
            if best:
                x = np.flatnonzero(who >= 0)
                yield named(node[x], node[who[x]])

    return run


def _mixed(named: DataFrame) -> DataFrame:
    """Lists (token, node, n, comp) that join several components, with their size."""
    mixed = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 <> c1").drop("c0", "c1")
    return named.join(mixed, "token")


def _labelled(lists: DataFrame, stars: DataFrame) -> DataFrame:
    """lists (token, node, n) with the component of each node, only of tokens that still join several components."""
    s = stars.select(F.col("a").alias("node"), F.col("b").alias("m"))
    return _mixed(lists.join(s, "node", "left").select("token", "node", "n", F.coalesce("m", "node").alias("comp")))


def _centre_pairs(named: DataFrame, r: int, percent: int) -> DataFrame:
    """Each node with the centres of its lists, (a, b), repeats included; long lists meet their centre in pieces."""
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    centre = named.groupBy("token").agg(F.min_by(F.struct(F.col("node").alias("c"), F.col("comp").alias("cc"), F.col("n").alias("cn")), F.xxhash64("node", F.lit(r))).alias("s"), F.max("size").alias("size"))
    centre = centre.select("token", "s", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    dealt = named.withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int"))
    pairs = dealt.join(centre, ["token", "piece"]).select("node", "comp", "n", "s.*").filter("comp <> cc").filter(100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))
    return pairs.select(F.col("node").alias("a"), F.col("c").alias("b"))


def _centres(named: DataFrame, r: int, percent: int) -> DataFrame:
    """Each node with one of the centres of its lists, (a, b)."""
    return _centre_pairs(named, r, percent).groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(r))).alias("b"))


def _bands(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, node, n): the nodes of long lists by the values of whole bands."""
    long = named.filter(F.col("size") > PIECE).select("node", "n").distinct()
    return sets.join(long, "node").select("node", "n", "set").mapInArrow(_band_tokens, "token long, node long, n long")


def _bounded_lists(named: DataFrame, banded: DataFrame | None) -> DataFrame:
    """The lists (token, node, n, comp, side) in which every pair that the thresholds ask for still meets, none longer than PIECE or about two blocks.
    banded: the lists of bands that still join several components, in place of long lists."""
    columns = ["token", "node", "n", "comp"]
    out = named.filter(F.col("size") <= PIECE).select(*columns, F.lit(3).alias("side"))
    if banded is None:
        return out
    out = out.union(banded.filter(F.col("size") <= PIECE).select(*columns, F.lit(3).alias("side")))
    long = banded.filter(F.col("size") > PIECE)
    lead = long.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.max("k").alias("inside"))
    long = long.join(lead, "token").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("outer", F.ceil((F.col("size") - F.col("inside")) / BLOCK).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    every = long.withColumn("x", upto("outer")).withColumn("y", mine("blocks", 1)).withColumn("side", F.lit(2))
    outside = long.filter("comp <> largest").withColumn("x", mine("outer", 2)).withColumn("y", upto("blocks")).withColumn("side", F.lit(1))
    dealt = every.select(*columns, "side", "x", "y").union(outside.select(*columns, "side", "x", "y"))
    return out.union(dealt.select(F.xxhash64("token", "x", "y").alias("token"), "node", "n", "comp", "side"))


def node_components(docs: DataFrame, profile: DataFrame, shingle: int, percent: int, matches: int = MATCHES) -> DataFrame:
    """(a, b): nodes and the smallest node of their component, where that is another one."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        nodes = profile.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))
        distinct = profile.filter("n > 0").select("node", "sig").dropDuplicates(["node"])
        lists = postings(distinct, matches).join(nodes.select("node", "n"), "node")
        lists = materialize(lists.select("token", "node", "n"), "minhash-lists")
        posted = lists.select("node").distinct()
        wanted = nodes.join(posted, "node", "left_semi").select(F.col("id").alias("__id")).distinct()
        picked = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        sets = picked.select("text").mapInArrow(_sets(shingle), "node long, set binary").join(posted, "node", "left_semi").dropDuplicates(["node"])
        sets = materialize(sets, "minhash-sets")
        stars = spark.createDataFrame([], "a long, b long")
        known, left, bands, stage, passes = None, None, None, "centres", 0  # then "long", "best", "all"
        for r in itertools.count():
            named = materialize(_labelled(lists, stars), "minhash-mixed")
            most, long = named.agg(F.max("size"), F.count_distinct(F.when(F.col("size") > PIECE, F.col("comp")))).first()  # components that long lists still join
            if most is None:
                break
            if stage == "centres" and r == ROUNDS:
                stage = "long"
            if stage == "long" and (not long or r >= ROUNDS + LONG_ROUNDS or left is not None and long > SHRINK * left):
                stage = "best"
            left = long
            banded = None
            if most > PIECE and (stage in ("best", "all") or r == ROUNDS - 1):
                if bands is None:  # later long lists hold no other nodes
                    bands = materialize(_bands(named, sets), "minhash-bands")
                banded = materialize(_labelled(bands, stars), "minhash-banded")
            if stage in ("centres", "long"):
                wanted = named if stage == "centres" else named.filter(F.col("size") > PIECE)
                pairs = _centres(wanted, r, percent)
                if banded is not None:
                    pairs = pairs.union(_centre_pairs(banded, r, percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                more = _confirmed(pairs, sets, percent)
            else:
                if known is None:
                    rest = named.select("node").distinct()
                    sketches = sets.join(rest, "node", "left_semi").mapInArrow(_sketches, "node long, sketch binary, counts binary")
                    known = materialize(sketches.join(distinct, "node"), "minhash-known")
                best = stage == "best"
                bounded = materialize(_bounded_lists(named, None if best else banded), "minhash-bounded")
                own = bounded.groupBy("node").agg(F.collect_set("token").alias("lists"))  # at most two prefixes, and its pieces of long lists
                whole = bounded.join(known.join(own, "node"), "node").repartition("token").sortWithinPartitions("token")
                found = whole.mapInArrow(_merge(percent, matches, best, True), "a long, b long")
                if best and banded is not None:  # of long lists, other centres
                    found = found.union(_centre_pairs(banded, r, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
                found = found.distinct()
                more = _confirmed(materialize(found, "minhash-pairs"), sets, percent)
            stars = connected(materialize(more.union(stars), "minhash-links"))
            if stage == "all":
                break
            passes += stage == "best"
            if passes == BEST:
                stage = "all"
        keep(stars)
    return stars


def _labelled_profile(rows: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written profile of rows (doc_id, text, others), and per node its component (node, comp, component_id)."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    profile = materialize(rows.mapInArrow(_profile(shingle), f"{kept}, n long, node long, sig array<int>"), "minhash-profile")
    stars = node_components(rows, profile, shingle, percent)
    nodes = profile.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    named = nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", "id", F.coalesce("m", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    return profile, named.join(smallest, "comp").select("node", "comp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id of its component), kept."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profile, label = _labelled_profile(rows, shingle, percent)
    some = profile.filter("n > 0").select("doc_id", "n", "node").join(label.drop("comp"), "node").select("doc_id", "n", "component_id")
    none = profile.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per component, all columns: that of the smallest id (null ids last), then of the smallest digest and row hash.

    Rows are told apart by id and content, so rows without an id, or with one id and several texts, stay if their components differ.
    Texts without words are in no component; of those that repeat an id and a content, one stays."""
    bound_batches(docs.sparkSession)
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    profile, label = _labelled_profile(docs.select("doc_id", "text", key.alias("key")), shingle, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    some = profile.filter("n > 0").select("doc_id", "key", "node").join(label.select("node", "comp"), "node")
    some = some.groupBy("comp").agg(F.min(order).alias("first")).select("first.doc_id", "first.key")
    won = some.unionByName(profile.filter("n = 0").select("doc_id", "key")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__won"))
    rows = docs.select(F.col("doc_id").alias("__doc"), key.alias("__key"), F.struct(*docs.columns).alias("__row"))
    kept = rows.join(won, (rows["__key"] == won["__won"]) & rows["__doc"].eqNullSafe(won["__id"]), "left_semi")
    one = kept.groupBy("__doc", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
