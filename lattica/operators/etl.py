"""Dictionary-building pipelines: merges, patches, cost overrides, morphology."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import csv_fields, final_consonant, log_cost
from lattica.plans.shared import bound_batches, materialize

PIECE = 1 << 22  # bytes of texts whose words are counted at once
OFTEN = 4096  # words of a larger share of the text than one in so many are dealt over several tasks
SALTS = 16


def length_filter(entries: DataFrame, shortest: int, longest: int, column: str = "surface") -> DataFrame:
    """Entries whose surface (or base form) has a number of characters within the bounds."""
    return entries.filter(F.char_length(column).between(shortest, longest))


def base_form_only(entries: DataFrame, cell: int = 6) -> DataFrame:
    """Entries whose surface is their own base form (a feature cell, from 0)."""
    return entries.filter(F.col("surface") == F.get(csv_fields(F.col("feature")), F.lit(cell)))


def choose_sources(entries: DataFrame, wanted: Sequence[str], column: str = "source") -> DataFrame:
    return entries.filter(F.col(column).isin(*wanted))


def extension_merge(entries: DataFrame, extension: DataFrame) -> DataFrame:
    """Adds ext by surface and left id; extension: key "surface,left_id", ext."""
    e = extension.select("key", F.trim("ext").alias("ext"))
    return entries.withColumn("key", F.concat_ws(",", "surface", F.col("left_id").cast("string"))).join(e, "key", "left").withColumn("ext", F.coalesce("ext", F.lit(""))).drop("key")


def insert_absent(lexicon: DataFrame, new: DataFrame, keys: Sequence[str] = ("surface", "pos", "semantic_class")) -> DataFrame:
    """The lexicon with the new rows that no available row has the keys of."""
    return lexicon.unionByName(new.join(lexicon.filter("is_available"), list(keys), "left_anti"), allowMissingColumns=True)


def apply_patch(rows: DataFrame, minus: DataFrame, plus: DataFrame) -> DataFrame:
    """Lines taken out and put in, as often as the patch says."""
    return rows.exceptAll(minus).unionAll(plus)


def apply_hunks(rows: DataFrame, hunks: DataFrame) -> DataFrame:
    """rows (line_no, line) with hunks (line_no, removed, added: lines put after that one) applied in place: line_no, line, numbered anew from 0.

    The numbering counts the lines before in ranges of line numbers, so it is one file's work only inside a range."""
    both = rows.join(hunks, "line_no", "left")
    old = F.when(F.coalesce("removed", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array("line"))
    kept = both.select("line_no", F.posexplode(F.concat(old, F.coalesce("added", F.array().cast("array<string>")))).alias("k", "line"))
    span = F.expr("line_no div 65536")
    before = kept.groupBy(span.alias("span")).agg(F.count("*").alias("n"))
    before = before.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))  # a row per 65,536 lines
    place = F.row_number().over(Window.partitionBy("span").orderBy("line_no", "k")) - 1
    return kept.withColumn("span", span).withColumn("place", place).join(F.broadcast(before), "span").select((F.col("before") + F.col("place")).cast("int").alias("line_no"), "line")


def override_costs(entries: DataFrame, costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word costs replaced where an override (keys, new_cost) exists."""
    return entries.join(costs.select(*keys, "new_cost"), list(keys), "left").withColumn("word_cost", F.coalesce("new_cost", "word_cost")).drop("new_cost")


def override_connections(matrix: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cells (right_ctx, left_ctx, new_cost) put into a matrix."""
    return matrix.join(overrides, ["right_ctx", "left_ctx"], "left").withColumn("cost", F.coalesce("new_cost", "cost")).drop("new_cost")


def first_id(ids: DataFrame, pattern: Column) -> DataFrame:
    """The lowest id whose feature matches."""
    return ids.filter(pattern).agg(F.min("id").alias("id"))


def override_first(matrix: DataFrame, right_ids: DataFrame, left_ids: DataFrame, rules: Sequence[tuple[Column, Column, int]]) -> DataFrame:
    """A matrix with the cost of each rule (condition on right features, on left features, cost) at the first ids that match; the last rule of a cell counts."""
    new = None
    for k, (right, left, cost) in enumerate(rules):
        one = first_id(right_ids, right).select(F.col("id").alias("right_ctx")).crossJoin(first_id(left_ids, left).select(F.col("id").alias("left_ctx"))).withColumns({"new_cost": F.lit(cost), "k": F.lit(k)})  # one row
        new = one if new is None else new.unionByName(one)
    if new is None:
        return matrix
    last = new.filter("right_ctx is not null and left_ctx is not null").groupBy("right_ctx", "left_ctx").agg(F.max_by("new_cost", "k").alias("new_cost"))
    return override_connections(matrix, last)


def classify_names(tokens: DataFrame, places: DataFrame, persons: DataFrame, place: str = "place", person: str = "person") -> DataFrame:
    """Class of each surface: a place if it is one, else a person."""
    t = tokens.join(places.select("surface", F.lit(place).alias("a")).distinct(), "surface", "left").join(persons.select("surface", F.lit(person).alias("b")).distinct(), "surface", "left")
    return t.withColumn("semantic_class", F.coalesce("a", "b", F.lit("*"))).drop("a", "b")


def scale_costs(entries: DataFrame, rules: Sequence[tuple[Column, float]]) -> DataFrame:
    """Word costs times the factor of the first rule that holds, toward zero."""
    out = None
    for condition, factor in rules:
        value = (F.col("word_cost") * factor).cast("int")
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return entries.withColumn("word_cost", out.otherwise(F.col("word_cost")) if out is not None else F.col("word_cost"))


def retag_like(entries: DataFrame, surface: str, model_surface: str, tag: str) -> DataFrame:
    """One surface takes the tag given and the context ids of another."""
    ids = entries.filter(F.col("surface") == model_surface).agg(F.min("left_id").alias("__l"), F.min("right_id").alias("__r"))  # one row
    rows = entries.crossJoin(F.broadcast(ids))
    mine = F.col("surface") == surface
    return rows.withColumns(
        {"left_id": F.when(mine, F.col("__l")).otherwise(F.col("left_id")), "right_id": F.when(mine, F.col("__r")).otherwise(F.col("right_id")), "feature": F.when(mine, F.regexp_replace("feature", "^[^,]*", tag)).otherwise(F.col("feature"))}
    ).drop("__l", "__r")


def conjugate(stems: DataFrame, endings: DataFrame) -> DataFrame:
    """stems (base, stem, ctype, ...) with endings (ctype, form, ending): one row per form; empty surfaces and repeats go."""
    rows = stems.join(endings, "ctype").withColumn("surface", F.concat("stem", "ending"))
    return rows.filter("surface <> ''").dropDuplicates()


def with_final_consonant(lexicon: DataFrame, reading: str = "read") -> DataFrame:
    return lexicon.withColumn("final", final_consonant(F.col(reading)))


def export_lines(lexicon: DataFrame) -> DataFrame:
    """Available rows of an authoring table as dictionary lines, with their part of speech as file name."""
    cell = lambda c: F.coalesce(F.col(c), F.lit("*"))
    line = F.concat_ws(",", "surface", F.lit("0"), F.lit("0"), F.lit("0"), "pos", cell("semantic_class"), F.col("final"), cell("read"), cell("type"), cell("start_pos"), cell("end_pos"), cell("expression"))
    return with_final_consonant(lexicon.filter("is_available")).select("pos", "surface", line.alias("line"))


def edit(lexicon: DataFrame, chosen: Column, change, apply: bool) -> DataFrame:
    """Get, modify, add: rows chosen are changed; in test mode only the changed rows are given."""
    changed = change(lexicon.filter(chosen))
    return lexicon.filter(~F.coalesce(chosen, F.lit(False))).unionByName(changed) if apply else changed


def available(lexicon: DataFrame) -> DataFrame:
    """Rows of an authoring table that are switched on."""
    return lexicon.filter("is_available")


def tags(lexicon: DataFrame) -> DataFrame:
    """The distinct pairs of part of speech and class."""
    return lexicon.select("pos", "semantic_class").distinct()


def sorted_unique(lines: DataFrame) -> DataFrame:
    """Distinct lines in byte order."""
    return lines.distinct().orderBy(*lines.columns)


def ranked(lexicon: DataFrame, group: str = "pos", order: str = "surface") -> DataFrame:
    """Adds rank: the place of an entry in its group by surface, from 1."""
    return lexicon.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def neighbours(rows: DataFrame, items: str) -> DataFrame:
    """left, right, n of neighbouring items of an array column, paired inside the row."""
    a = F.col(items)
    some = F.greatest(F.size(a) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(a, F.lit(1), some), F.slice(a, F.lit(2), some), lambda x, y: F.struct(x.alias("left"), y.alias("right")))
    return rows.select(F.explode(pairs).alias("p")).select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("n"))


def _words(texts: pa.Array, line_break: str | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, whether the next word follows it in its sentence, the distinct words) of blank-separated words of texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    begins = offsets[:-1] - offsets[0]
    ends = np.zeros(len(data) + 1, bool)  # a sentence begins here
    ends[begins] = True
    between = data == 0x20
    if line_break is not None:
        breaks = data == ord(line_break)
        between |= breaks
        ends[:-1] |= breaks
    new = ends[:-1].copy()
    new[1:] |= between[:-1]
    first = np.flatnonzero(new & ~between)  # of each word
    letters = ~between
    sizes = np.add.reduceat(letters, first, dtype=np.int64) if len(first) else first
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data[letters])]).dictionary_encode()
    sentence = np.cumsum(ends)[first]
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(sentence[1:] == sentence[:-1], [False] * min(1, len(first))).astype(bool), words.dictionary.cast(pa.large_string())


def _pieces(batches: Iterable[pa.RecordBatch], line_break: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """_words of about PIECE bytes of texts at once, whatever the batches hold."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary()).fill_null(b"")
        total, at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)), 0
        while at < len(column):
            before = int(total[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + PIECE - size, "right")))
            held.append(column.slice(at, stop - at))
            size, at = size + int(total[stop - 1]) - before, stop
            if size >= PIECE or at < len(column):
                yield _words(pa.concat_arrays(held), line_break)
                held, size = [], 0
    if held:
        yield _words(pa.concat_arrays(held), line_break)


def _counted(texts: DataFrame, text: str, line_break: str | None, schema: str, count) -> DataFrame:
    """Rows of count(codes, followed, words), summed up by piece."""
    bound_batches(texts.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for piece in _pieces(batches, line_break):
            yield pa.RecordBatch.from_arrays(count(*piece), names=names)

    return texts.select(text).mapInArrow(run, schema)


def pair_costs(texts: DataFrame, text: str = "sentence", factor: float = 200.0, vocabulary: int | None = None, line_break: str | None = None) -> DataFrame:
    """left, right, n, cost of neighbouring blank-separated words: add-half smoothed negative log conditional frequency of the pairs that occur.

    A text is a sentence, or several where a line break is given. Words and pairs are counted where texts are read, so only counts move. The vocabulary is that of the texts unless given."""

    def of_words(code, followed, words):
        return [words.cast(pa.string()), pa.array(np.bincount(code, followed, len(words)).astype(np.int64))]

    def of_pairs(code, followed, words):
        at = np.flatnonzero(followed)
        key, n = np.unique(code[at] * len(words) + code[at + 1], return_counts=True)
        take = lambda i: words.take(pa.array(i)).cast(pa.string())
        return [take(key // max(1, len(words))), take(key % max(1, len(words))), pa.array(n)]

    words = materialize(_counted(texts, text, line_break, "left string not null, n_left long", of_words).groupBy("left").agg(F.sum("n_left").alias("n_left")), "words")
    total = words.agg(F.count("*").alias("kinds"), F.sum("n_left").alias("n_all"))  # one row
    words = words.crossJoin(F.broadcast(total))
    often = words.filter(F.col("n_left") * OFTEN > F.col("n_all")).select("left", F.lit(True).alias("often"))  # fewer than OFTEN words
    words = words.withColumn("salt", F.explode(F.when(F.col("n_left") * OFTEN > F.col("n_all"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    pairs = _counted(texts, text, line_break, "left string not null, right string not null, n long", of_pairs).join(F.broadcast(often), "left", "left")
    # moved once, to where the first word's total is; counted there, as pairs that repeat are few after the first count
    pairs = pairs.withColumn("salt", F.when(F.col("often"), F.pmod(F.hash("right"), F.lit(SALTS))).otherwise(0)).repartition("left", "salt").groupBy("left", "salt", "right").agg(F.sum("n").alias("n"))
    kinds = F.col("kinds") if vocabulary is None else F.lit(vocabulary)
    return pairs.join(words.hint("shuffle_hash"), ["left", "salt"]).select("left", "right", "n", log_cost((F.col("n") + 0.5) / (F.col("n_left") + 0.5 * kinds), factor).alias("cost"))


def pair_matrix(pairs: DataFrame, words: DataFrame | int, factor: float = 200.0) -> DataFrame:
    """left, right, n, cost of counted pairs (left, right, n). With a table of words (w) for the vocabulary's size, unseen pairs are filled in: its rows are all pairs."""
    if isinstance(words, int):
        kinds, rows = F.lit(words), pairs
    else:
        w = words.select("w").distinct()
        kinds = F.lit(w.count())
        rows = w.select(F.col("w").alias("left")).crossJoin(w.select(F.col("w").alias("right"))).join(pairs, ["left", "right"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = pairs.groupBy("left").agg(F.sum("n").alias("n_left"))
    cost = log_cost((F.col("n") + 0.5) / (F.coalesce("n_left", F.lit(0)) + 0.5 * kinds), factor)
    return rows.join(first, "left", "left").select("left", "right", *(["n"] if isinstance(words, int) else []), cost.alias("cost"))


def word_costs(words: DataFrame, word: str = "w", factor: float = 200.0) -> DataFrame:
    """word, n, cost: add-half smoothed negative log frequency."""
    counts = words.groupBy(word).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(word, "n", log_cost((F.col("n") + 0.5) / (F.col("total") + 0.5 * F.col("kinds")), factor).alias("cost"))
