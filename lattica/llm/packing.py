"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut at word starts into pieces (their concatenation is the whole text).
Pieces are dealt by a hash of id and content to shards of about SHARD pieces, and each shard is packed by itself, in
falling order of length:

* a piece goes to the open bin with the least room that still holds it (best fit);
* if none does, a bin is opened whose length costs least per word it can still get: cost(L) over the piece plus the
  words of the remaining pieces that would fit beside it, at most L;
* at the end every bin shrinks to the smallest permitted length that holds its contents.

The cost of a sequence of length L is FIXED + L + QUADRATIC * L**2 by default (attention grows with the square).

Rows that repeat an id and a text are spread over the shards. Shards bound a task's memory; best fit over all pieces at once
would save a fraction of the cost that the README states with figures.

Defined results: null or wordless texts give one piece of 0 words with bin_id null, bin_size 0; null ids are dealt by
content; repeated rows are packed as often as they occur; ties in length are ordered by id and piece; an empty table
gives no rows. Extra columns do not matter; with_text keeps the pieces' text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches

from .mixing import word_count
from .textblocks import as_bytes, blocks, word_spans

LENGTHS = (256, 512, 1024, 2048, 4096)
FIXED = 16.0
QUADRATIC = 1 / 8192
SHARD = 8192


def cost(length: int) -> float:
    return FIXED + length + QUADRATIC * length * length


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in it and final bin length of each size; sizes are positive and at most the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rising = sorted(sizes)
    upto = np.concatenate([[0], np.cumsum(rising, dtype=np.int64)]).tolist()
    rooms: list[int] = []  # distinct rooms of open bins, rising
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    length: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for done, i in enumerate(order):
        x = sizes[i]
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
        else:
            left = len(sizes) - done - 1  # the pieces still to come are the `left` smallest
            best = None
            for size in lengths:
                if size >= x:
                    beside = upto[min(left, bisect_left(rising, size - x + 1))]
                    key = (price(size) / (x + min(size - x, beside)), size)
                    best = min(best or key, key)
            b, room = len(used), best[1]
            used.append(0)
            length.append(best[1])
        bins[i], offsets[i] = b, used[b]
        used[b] += x
        if room := room - x:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(b)
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return bins, offsets, [final[b] for b in bins]


def _repeats(h: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How often a task has met each row's hash before, for hashes that a batch has repeated; seen holds only those."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(h)])
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(first, times)
    for at, k in zip(first.tolist(), times.tolist(), strict=True):
        value = int(h[order[at]])
        if k > 1 or value in seen:
            out[order[at : at + k]] += seen.get(value, 0)
            seen[value] = seen.get(value, 0) + k
    return out


def _cut(largest: int, with_text: bool):
    names = ["doc_id", "piece", "word_start", "n_words", "h", "repeat"] + ["text"] * with_text

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            repeat = _repeats(batch.column("h").to_numpy(), seen)
            for a, b, offs, part in blocks(offsets, data):
                starts, _, before = word_spans(offs, part)
                n = np.diff(before)
                parts = np.maximum(1, -(-n // largest))
                row = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                word = piece * largest
                at = pa.array(row + a)
                out = [batch.column("doc_id").take(at), pa.array(piece), pa.array(word), pa.array(np.minimum(largest, n[row] - word)), batch.column("h").take(at), pa.array(repeat[row + a])]
                if with_text:
                    lo = np.where(piece == 0, offs[row], starts[np.minimum(before[row] + word, max(len(starts) - 1, 0))] if len(starts) else offs[row])
                    ends = np.append(lo[1:], offs[-1])
                    last = piece == parts[row] - 1
                    hi = np.where(last, offs[row + 1], ends)
                    raw = part.tobytes()
                    out.append(pa.array([raw[i:j].decode("utf-8") for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _pack_shard(lengths):
    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("h", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        n = table.column("n_words").to_numpy()
        some = np.flatnonzero(n > 0)
        bins, offsets, final = pack(n[some].tolist(), lengths)
        shard = table.column("shard").to_numpy()
        bin_id, offset, size = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        bin_id[some], offset[some], size[some] = shard[some] * (1 << 32) + np.array(bins, np.int64), offsets, final
        keep = [c for c in table.column_names if c not in ("shard", "h", "repeat")]
        return pa.table([*(table.column(c) for c in keep), pa.array(bin_id, mask=n == 0), pa.array(offset, mask=n == 0), pa.array(size)], names=[*keep, "bin_id", "bin_offset", "bin_size"])

    return run


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, word_start, n_words, [text,] bin_id, bin_offset, bin_size."""
    bound_batches(docs.sparkSession)
    largest = max(lengths)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = rows.select(F.sum(F.greatest(F.lit(1), F.ceil(word_count(F.col("text")) / largest))).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(pieces) // shard))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    body = ", text string" if with_text else ""
    cut = rows.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(_cut(largest, with_text), f"doc_id {id_type}, piece long, word_start long, n_words long, h long, repeat long{body}")
    # rows that repeat an id and a text are dealt by their task and place too, so that no shard gets all of them
    again = F.when(F.col("repeat") > 0, F.spark_partition_id()).otherwise(-1)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("h", "piece", "repeat", again), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(tuple(lengths)), f"doc_id {id_type}, piece long, word_start long, n_words long{body}, bin_id long, bin_offset long, bin_size long")
