"""Dictionary compilation: part-of-speech ids, context ids, costs from a model, checks, matrices; tables in, tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import csv_fields, quantized_cost, quote_field
from lattica.operators.rewrite import Rule, pos_id, rewrite, template_column
from lattica.plans.model import EngineConf, Model
from lattica.plans.shared import materialize


def compile_entries(entries: DataFrame, pos_rules: Sequence[tuple[str, int]] = (), node_format: str | None = None, wakati: bool = False) -> DataFrame:
    """Entries with pos_id in dictionary order: bytes of the surface, then as given. Empty surfaces go."""
    feature = F.lit("") if wakati else F.col("feature")
    rows = entries.filter("surface <> ''").withColumn("pos_id", pos_id(pos_rules, F.col("feature"))).withColumn("feature", feature)
    return rows.orderBy("surface", *[c for c in ("dict_id", "entry_ord") if c in rows.columns])


def surface_runs(entries: DataFrame) -> DataFrame:
    """surface, n_entries, entries in order: the runs that a lookup returns."""
    fields = [c for c in entries.columns if c != "surface"]
    return entries.groupBy("surface").agg(F.count("*").alias("n_entries"), F.sort_array(F.collect_list(F.struct(*(["entry_ord"] + [f for f in fields if f != "entry_ord"])))).alias("entries"))  # at most 255 of a surface


def violations(entries: DataFrame, lsize: int, rsize: int) -> DataFrame:
    """Entries whose context ids are outside of the matrix or whose surface has more than 255 entries."""
    many = entries.groupBy("surface").count().filter("count > 255").select("surface", F.lit("too many entries").alias("problem"))
    bad = entries.filter(~F.col("left_id").between(0, rsize - 1) | ~F.col("right_id").between(0, lsize - 1)).select("surface", F.lit("context id").alias("problem"))
    return bad.unionByName(many)


def context_ids(features: DataFrame, column: str, bos: str) -> DataFrame:
    """id, feature: the begin and end of sentences is 0, distinct contexts follow from 1 in byte order.

    The numbering is a count of smaller contexts in range partitions: a sort, then offsets of partition counts, so no single task sees all.
    The ranges are written before they are counted, so both branches see the same ones."""
    distinct = features.filter(F.col(column).isNotNull() & (F.col(column) != bos)).select(F.col(column).alias("feature")).distinct()
    ranged = materialize(distinct.repartitionByRange("feature").withColumn("part", F.spark_partition_id()), "context-ranges")
    place = F.row_number().over(Window.partitionBy("part").orderBy("feature"))
    low = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = low.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    ids = ranged.withColumn("place", place).join(before, "part").select((F.col("before") + F.col("place")).cast("int").alias("id"), "feature")
    zero = features.sparkSession.createDataFrame([(0, bos)], "id int, feature string")
    return zero.unionByName(ids)


def auto_ids(entries: DataFrame, rules: dict[str, Sequence[Rule]], left_ids: DataFrame, right_ids: DataFrame) -> DataFrame:
    """Fills empty or negative context ids from the rewritten features."""
    rows = entries.withColumns({"__l": rewrite(rules["left"], F.col("feature")), "__r": rewrite(rules["right"], F.col("feature"))})
    rows = rows.join(left_ids.select(F.col("feature").alias("__l"), F.col("id").alias("__li")), "__l", "left").join(right_ids.select(F.col("feature").alias("__r"), F.col("id").alias("__ri")), "__r", "left")
    pick = lambda own, found: F.when(F.col(own).isNull() | (F.col(own) < 0), F.col(found)).otherwise(F.col(own))
    return rows.withColumns({"left_id": pick("left_id", "__li"), "right_id": pick("right_id", "__ri")}).drop("__l", "__r", "__li", "__ri")


def model_costs(entries: DataFrame, rules: dict[str, Sequence[Rule]], templates: Sequence[str], model: DataFrame, factor: int, char_type: str | None = None, all_entries: bool = False) -> DataFrame:
    """Word costs from a model (alpha, feature): the sum over an entry's unigram features, as an integer cost. Only empty costs unless all_entries."""
    u = entries.withColumn("ufeature", rewrite(rules["unigram"], F.col("feature")))
    distinct = u.select("ufeature", *([char_type] if char_type else [])).distinct()
    cells = {"F": csv_fields(F.col("ufeature"))}
    whole = {"t": F.col(char_type) if char_type else F.lit("0"), "u": F.col("ufeature"), "w": F.lit("")}
    every = F.filter(F.array(*[template_column(t, cells, whole) for t in templates]), lambda x: x.isNotNull())
    each = distinct.withColumn("f", F.explode_outer(every)).join(model.select("alpha", F.col("feature").alias("f")), "f", "left")
    sums = each.groupBy("ufeature", *([char_type] if char_type else [])).agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("__a"))
    keys = ["ufeature"] + ([char_type] if char_type else [])
    cost = quantized_cost(F.col("__a"), factor)
    new = cost if all_entries else F.when(F.col("word_cost").isNull(), cost).otherwise(F.col("word_cost"))
    return u.join(sums, keys, "left").withColumn("word_cost", new).drop("__a", "ufeature")


def matrix_from_model(left_ids: DataFrame, right_ids: DataFrame, templates: Sequence[str], model: DataFrame, factor: int) -> DataFrame:
    """right_ctx, left_ctx, cost of every pair of contexts: the sum of its bigram features' weights. The pairs are the result's own rows."""
    l = left_ids.select(F.col("id").alias("left_ctx"), F.col("feature").alias("lf"))  # noqa: E741
    r = right_ids.select(F.col("id").alias("right_ctx"), F.col("feature").alias("rf"))
    pairs = r.crossJoin(l)
    cells = {"L": csv_fields(F.col("rf")), "R": csv_fields(F.col("lf"))}
    every = F.filter(F.array(*[template_column(t, cells, {"l": F.col("lf"), "r": F.col("rf")}) for t in templates]), lambda x: x.isNotNull())
    each = pairs.select("right_ctx", "left_ctx", F.explode_outer(every).alias("f")).join(model.select("alpha", F.col("feature").alias("f")), "f", "left")
    return each.groupBy("right_ctx", "left_ctx").agg(quantized_cost(F.coalesce(F.sum("alpha"), F.lit(0.0)), factor).alias("cost"))


def to_csv(entries: DataFrame) -> DataFrame:
    """Entries as dictionary source lines."""
    return entries.select(F.concat_ws(",", quote_field(F.col("surface")), F.col("left_id").cast("string"), F.col("right_id").cast("string"), F.col("word_cost").cast("string"), "feature").alias("line"))


def model_lines(model: DataFrame) -> DataFrame:
    """A model as text lines in byte order of features, 16 decimals."""
    return model.orderBy("feature").select(F.concat(F.format_string("%.16f", "alpha"), F.lit("\t"), F.col("feature")).alias("line"))


def id_lines(ids: DataFrame) -> DataFrame:
    return ids.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), "feature").alias("line"))


def dictionary_info(entries: DataFrame) -> DataFrame:
    """Entries, surfaces and longest surface of each dictionary."""
    return entries.groupBy("dict_id").agg(F.count("*").alias("size"), F.countDistinct("surface").alias("surfaces"), F.max(F.octet_length("surface")).alias("longest"))


def load_model(entries: DataFrame, conf: EngineConf, chars: str, unknown: str, matrix, pos_rules: Sequence[tuple[str, int]] = ()) -> Model:
    """A Model of an entries table (surface, left_id, right_id, word_cost, feature[, dict_id])."""
    from lattica.operators.rewrite import pos_of

    cols = ["surface", "left_id", "right_id", "word_cost", "feature"] + (["dict_id"] if "dict_id" in entries.columns else [])
    order = [c for c in ("dict_id", "entry_ord", "surface") if c in entries.columns]
    rows = entries.orderBy(*order).select(*cols).toArrow()  # a dictionary, which every executor will hold
    return Model.build(list(zip(*[c.to_pylist() for c in rows.columns], strict=True)), conf, chars, unknown, matrix, pos_of(pos_rules))
