"""Lattices as tables: characters, classes, runs, candidates, nodes and edges, all as DataFrame operators.

This form scales with the cluster whatever the dictionary's size: a dictionary lookup is an equi-join on the substrings that pass a
filter of fixed size, never a prefix comparison of all pairs. Characters, runs and substrings of a sentence are cut where it is read, in time that follows its length. Small tables (classes, character map, connection costs) are joined as they are; Spark
broadcasts those below its own size threshold.

Character positions (ci) and byte positions run within a sentence; ``end_ci`` is exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.decode import _apply, _sums
from lattica.operators.lattice import Text
from lattica.plans.model import Model

_BITS = 22  # of the filter that substrings pass before they are joined
_HEAD = 1 << 40
CHAR_FIELDS = {"ci": "int", "ch": "string", "cp": "int", "byte_len": "int", "byte_pos": "int"}


def _cut(sentences: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, sentence offsets, and of each character its place, sentence and number in the sentence."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sentences])]).astype(np.int64)
    data = np.frombuffer(b"".join(sentences), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(at, offsets)
    n = np.diff(first)
    return data, offsets, at, np.repeat(np.arange(len(sentences)), n), np.arange(len(at)) - np.repeat(first[:-1], n)


def _code_points(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    pad = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63, pad[at + 3] & 63
    return np.select([size == 1, size == 2, size == 3], [b0, (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2], (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)


def chars(sentences: DataFrame, keys: Sequence[str], text: str = "sentence", fields: Sequence[str] = tuple(CHAR_FIELDS)) -> DataFrame:
    """keys, ci, ch, cp, byte_len, byte_pos of every character, or those fields that are asked for."""

    def work(block):
        data, offsets, at, sentence, ci = _cut(block)
        size = np.diff(np.append(at, len(data)))
        made = {
            "ci": lambda: ci,
            "ch": lambda: pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)),
            "cp": lambda: _code_points(data, at, size),
            "byte_len": lambda: size,
            "byte_pos": lambda: at - offsets[sentence],
        }
        return sentence, [made[f]() if f == "ch" else pa.array(made[f]().astype(np.int32)) for f in fields]

    return _apply(sentences.filter(F.col(text) != "").select(*keys, text), text, ", ".join(f"{f} {CHAR_FIELDS[f]}" for f in fields), work)


def class_runs(sentences: DataFrame, keys: Sequence[str], model: Model, text: str = "sentence") -> DataFrame:
    """keys, run_id (from 1), class_id of its first character, first_ci, run_end: the stretches that runs marks, cut where a sentence is read.

    Classes are those of the model."""
    of_class, of_mask = model.char_class.astype(np.int32), model.char_mask.astype(np.int32)

    def work(block):
        data, _, at, sentence, ci = _cut(block)
        code = _code_points(data, at, np.diff(np.append(at, len(data))))
        code = np.where(code > 65535, 0, code)
        mask = of_mask[code]
        begins = ci == 0
        begins[1:] |= (mask[1:] & mask[:-1]) == 0
        head = np.flatnonzero(begins)
        stop = np.append(head[1:], len(at)) - 1  # its last character
        row = sentence[head]
        run_id = np.arange(1, len(head) + 1) - np.searchsorted(row, row, "left")
        i32 = lambda x: pa.array(x.astype(np.int32))
        return row, [pa.array(run_id), i32(of_class[code[head]]), i32(ci[head]), i32(ci[stop] + 1)]

    return _apply(sentences.filter(F.col(text) != "").select(*keys, text), text, "run_id long, class_id int, first_ci int, run_end int", work)


def classify(characters: DataFrame, char_map: DataFrame, default_class: int) -> DataFrame:
    """Adds class_id and type_mask; code points beyond the basic plane count as 0."""
    key = F.when(F.col("cp") > 65535, 0).otherwise(F.col("cp"))
    m = char_map.select(F.col("code_point").alias("__cp"), "class_id", "type_mask")
    joined = characters.join(m, key == F.col("__cp"), "left").drop("__cp")
    return joined.withColumns({"class_id": F.coalesce("class_id", F.lit(default_class)), "type_mask": F.coalesce("type_mask", F.lit(1 << default_class))})


def runs(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds run_id, run_end (exclusive): stretches in which each character shares a class with the one before."""
    w = Window.partitionBy(*keys).orderBy("ci")
    broken = F.coalesce(F.col("type_mask").bitwiseAND(F.lag("type_mask").over(w)) == 0, F.lit(True))
    with_id = classified.withColumn("__b", broken.cast("int")).withColumn("run_id", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return with_id.drop("__b").withColumn("run_end", (F.max("ci").over(Window.partitionBy(*keys, "run_id")) + 1).cast("int"))


def heads(with_runs: DataFrame, keys: Sequence[str], space_mask: int) -> DataFrame:
    """Adds head_ci: the first non-blank character from each position on, null where only blanks follow."""
    w = Window.partitionBy(*keys).orderBy("ci").rowsBetween(0, Window.unboundedFollowing)
    return with_runs.withColumn("head_ci", F.min(F.when(F.col("type_mask").bitwiseAND(F.lit(space_mask)) == 0, F.col("ci"))).over(w))


class _Surfaces:
    """What a filter of fixed size keeps of a dictionary's surfaces: sizes in bytes, first two bytes by size, bits of hashes. Whatever passes is still to be joined."""

    def __init__(self, lexicon: DataFrame):
        def marks(batches):
            for batch in batches:
                block = Text([x.encode() for x in batch.column(0).to_pylist() if x])
                at, size = block.offsets[:-1], block.sizes
                first = np.append(block.data, 0).astype(np.int64)
                head = first[at] << 8 | np.where(size > 1, first[at + 1], 0)
                bit = (block.hashes(at, at + size) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_HEAD | size << 16 | head, bit])))], names=["v"])

        v = lexicon.select("surface").mapInArrow(marks, "v long").distinct().toArrow().column("v").to_numpy()  # at most 2 ** _BITS, and 65,536 a size
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[v[v < _HEAD]] = True
        head = v[v >= _HEAD] - _HEAD
        self.heads = []
        for size in np.unique(head >> 16).tolist():
            some = np.zeros(1 << 16, bool)
            some[head[head >> 16 == size] & 65535] = True
            self.heads.append((size, np.repeat(some.reshape(256, 256).any(1), 256) if size == 1 else some))

    def find(self, sentences: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(sentence, first character, character after the last, substring) of what passes, by sentence."""
        block = Text(sentences)
        _, _, at, sentence, ci = _cut(sentences)
        limit, number = block.offsets[sentence + 1], np.append(np.cumsum((block.data & 0xC0) != 0x80), 0)  # characters up to each byte
        follow = np.append(block.data, 0)
        pair = follow[at].astype(np.int32) << 8 | np.where(at + 1 < limit, follow[at + 1], 0)
        follow[-1] = 0
        who, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, heads in self.heads:
            x = np.flatnonzero(heads[pair])
            x = x[at[x] + size <= limit[x]]
            x = x[self.bits[block.hashes(at[x], at[x] + size) & np.uint64((1 << _BITS) - 1)]]
            x = x[(follow[at[x] + size] & 0xC0) != 0x80]  # it ends with a character
            who.append(x)
            sizes.append(np.full(len(x), size))
        x, size = np.concatenate(who), np.concatenate(sizes)
        order = np.argsort(x, kind="stable")
        x, size = x[order], size[order]
        gather = np.repeat(at[x] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        surface = pa.StringArray.from_buffers(len(x), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(block.data[gather])))
        return sentence[x], ci[x], ci[x] + number[at[x] + size - 1] - number[at[x]] + 1, surface


def prefix_matches(sentences: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "sentence", lengths: Sequence[int] | None = None) -> DataFrame:
    """keys, ci, end_ci, surface, entry columns: every dictionary surface (of lengths given in characters) at every position, by an equi-join on the substrings that may be one.

    Only keys, positions and substrings move, never the sentences."""
    if lengths is not None:
        lexicon = lexicon.filter(F.char_length("surface").isin(list(lengths)))
    known = _Surfaces(lexicon)

    def work(block):
        sentence, ci, end, surface = known.find(block)
        return sentence, [pa.array(ci.astype(np.int32)), pa.array(end.astype(np.int32)), surface]

    return _apply(sentences.select(*keys, text), text, "ci int, end_ci int, surface string", work).join(lexicon, "surface")


def match_counts(sentences: DataFrame, lexicon: DataFrame, text: str = "sentence") -> DataFrame:
    """surface, n, positions (sum of ci), entry columns: prefix_matches counted by surface, first in each block."""
    known = _Surfaces(lexicon)

    def work(block, copies):
        sentence, ci, _, surface = known.find(block)
        one = surface.dictionary_encode()
        code, n = one.indices.to_numpy(zero_copy_only=False), copies[sentence]
        total = lambda x: pa.array(np.bincount(code, x, len(one.dictionary)).astype(np.int64))
        return [one.dictionary, total(n), total(n * ci)]

    sums = _sums(sentences, text, "surface string, n long, positions long", work)
    return sums.groupBy("surface").agg(F.sum("n").alias("n"), F.sum("positions").alias("positions")).join(lexicon, "surface")


def unknown_spans(with_runs: DataFrame, classes: DataFrame, matched: DataFrame, keys: Sequence[str], space_mask: int, longest_group: int = 24) -> DataFrame:
    """keys, ci, end_ci, class_id, step of unknown words; matched: keys, ci with dictionary hits.

    step 0 is the run, 1 to length are prefixes of the class, 1 << 20 the single character that is left where nothing else is."""
    w = Window.partitionBy(*keys).orderBy("ci")
    flags = classes.select("class_id", "invoke", "grp", F.col("length").alias("max_len"))
    at = with_runs.filter(F.col("type_mask").bitwiseAND(F.lit(space_mask)) == 0).join(flags, "class_id")
    at = at.join(matched.select(*keys, "ci").distinct().withColumn("hit", F.lit(True)), [*keys, "ci"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    want = at.filter(~F.col("hit") | F.col("invoke"))
    extra = F.col("run_end") - F.col("ci") - 1
    fits = F.col("grp") & (extra <= longest_group)
    # prefixes share a class with the first character, one by one: its own later characters, at most max_len of them
    longest = classes.agg(F.max("length")).first()[0] or 0  # one number
    following = [F.lead("type_mask", j).over(w) for j in range(1, longest)]
    shared = with_runs.select(*keys, "ci", F.array(*[F.coalesce(x.bitwiseAND(F.col("type_mask")) != 0, F.lit(False)) for x in following]).alias("same") if following else F.array().cast("array<boolean>").alias("same"))
    want = want.join(shared, [*keys, "ci"])
    prefix = F.size(F.filter(F.sequence(F.lit(1), F.size("same") + 1), lambda i: F.forall(F.slice(F.col("same"), F.lit(1), i - 1), lambda x: x)))
    steps = F.when(F.col("max_len") > 0, F.sequence(F.lit(1), F.least("max_len", prefix))).otherwise(F.array().cast("array<int>"))
    # the run's own end is there already, and no longer prefix follows it
    steps = F.when(F.col("grp"), F.filter(steps, lambda i: i < F.col("run_end") - F.col("ci"))).otherwise(steps)
    want = want.withColumn("steps", steps).withColumn("fits", fits)
    spans = F.concat(
        F.when(F.col("fits"), F.array(F.struct(F.lit(0).alias("step"), F.col("run_end").cast("int").alias("end_ci")))).otherwise(F.array().cast("array<struct<step:int,end_ci:int>>")),
        F.transform("steps", lambda i: F.struct(i.cast("int").alias("step"), (F.col("ci") + i).cast("int").alias("end_ci"))),
    )
    only = F.array(F.struct(F.lit(1 << 20).alias("step"), (F.col("ci") + 1).cast("int").alias("end_ci")))
    spans = F.when((F.size(spans) == 0) & ~F.col("hit"), only).otherwise(spans)
    return want.select(*keys, "ci", "class_id", F.explode(spans).alias("s")).select(*keys, "ci", "class_id", "s.step", "s.end_ci")


def nodes(matches: DataFrame, unknown: DataFrame, unknown_entries: DataFrame, with_heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate nodes of all positions: begin_ci, start_ci, end_ci, left_id, right_id, pos_id, word_cost, feature, stat.

    All positions are kept, a superset of those a path reaches."""
    cols = ["left_id", "right_id", "word_cost", "feature"]
    known = matches.select(*keys, F.col("ci").alias("start_ci"), "end_ci", *cols, F.lit(0).alias("stat"))
    unk = unknown.join(unknown_entries.select("class_id", *cols), "class_id").select(*keys, F.col("ci").alias("start_ci"), "end_ci", *cols, F.lit(1).alias("stat"))
    begins = with_heads.filter("head_ci is not null").select(*keys, F.col("ci").alias("begin_ci"), F.col("head_ci").alias("start_ci"))
    return begins.join(known.unionByName(unk), [*keys, "start_ci"])


def edges(node_table: DataFrame, matrix: DataFrame, keys: Sequence[str], penalties: DataFrame | None = None) -> DataFrame:
    """Pairs of adjacent nodes with the cost of the step: connection, word cost and the penalty of a leading blank.

    penalties: pos_id, penalty, and ord where a part of speech may stand there more than once; the first counts."""
    left = node_table.select(*keys, F.col("end_ci").alias("begin_ci"), F.col("begin_ci").alias("l_begin"), F.col("right_id").alias("right_ctx"), F.col("feature").alias("l_feature"))
    right = node_table
    if penalties is not None:
        if "ord" in penalties.columns:
            penalties = penalties.groupBy("pos_id").agg(F.min_by("penalty", "ord").alias("penalty"))
        right = right.join(penalties, "pos_id", "left").withColumn("penalty", F.when(F.col("start_ci") > F.col("begin_ci"), F.coalesce("penalty", F.lit(0))).otherwise(0))
    else:
        right = right.withColumn("penalty", F.lit(0))
    both = right.join(left, [*keys, "begin_ci"])
    return both.join(matrix.select("right_ctx", F.col("left_ctx").alias("left_id"), F.col("cost").alias("connection")), ["right_ctx", "left_id"]).withColumn("step_cost", F.col("connection") + F.col("word_cost") + F.col("penalty"))
