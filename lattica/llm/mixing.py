"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets the rate r_d that minimises sum r log r - r under one token constraint per source,
sum over s of r_d * size_d = target_s, and 0 <= r_d <= 2. The solution tilts rates exponentially in the
constraint's own coefficient, r_d = min(2, exp(lambda_s * size_d / mean size of s)), and lambda_s maximises a concave
dual, whose gradient and curvature are sums over documents. Documents of equal source and size have equal rates, so the
sums run over (source, size, number of documents) cells; every Newton step is one join and one aggregation of
that table, and the multipliers stay in a table of their own, one row per source, from step to step. A step that
leaves its bracket is replaced by a bisection.

Rates become copies in two exact steps. Per source, cells in falling order of size get whole numbers of copies so that
the words taken so far follow the words wanted so far (the rest is at most half of the smallest document); a source's cells are its different
sizes, whose number grows with the square root of its words at most. Inside a cell all documents have the same size, so any of them may get
the odd copies: they go by a hash of id and text. Rows that repeat an id and a text are one key with a number, however many they
are; keys are cut by that hash into sub-cells of about CELL documents, each of which gets its share of the odd copies in hash order.
No step depends on the order of rows or partitions: sums are of whole numbers or decimals, so reruns agree.

Targets: sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; a target
stops at MAX_COPIES times its source's words and the excess goes to the others by weight until none is above, which is
min(weight * level, limit) for one common level, found by aggregations of the table of sources.

Defined results: null text and text without words have size 0, rate 1 and take 0 words; null is a source; sources of other types go by their text;
a source without words has target 0; null ids are told apart by their texts; repeated rows are documents of their own; an
empty table gives no rows; extra columns are left out of the decision.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.shared import materialize

from .columns import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
CELL = 256
ROWS = 4096
STEPS = 60
TOLERANCE = 1e-7


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _turns(per: DataFrame) -> DataFrame:
    """per (source, ...) with turn: the source's place from 0 in code point order, null last. Sorted in ranges; only their sizes meet in the driver."""
    order = [F.col("source").isNull(), F.col("source").cast("string"), F.col("source")]
    ranged = per.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__range"))
    ranged = materialize(ranged, "mix-ranges")  # written, so that a source's range stays
    before, upto = [], 0
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():  # a row a partition at most
        before.append((r["__range"], upto))
        upto += r["count"]
    offsets = per.sparkSession.createDataFrame(before, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("turn", place).join(F.broadcast(offsets), "__range").withColumn("turn", F.col("turn") + F.col("__before")).drop("__range", "__before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: source, source_size, n_docs, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("turn") % len(weights)).cast("int") + 1)
    w = materialize(_turns(per).select("source", "source_size", "n_docs", weight.alias("w"), (MAX_COPIES * F.col("source_size")).alias("cap")), "mix-weights")
    total, level, capped = None, 0.0, -1
    while True:  # the level only rises, and with it the sources at their limit
        full = F.col("cap") < F.col("w") * F.lit(level)
        r = w.agg(F.sum("source_size").alias("all"), F.count_if(full).alias("k"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        total = share * (r["all"] or 0)
        if r["k"] == capped or not r["open"]:
            break
        capped, level = r["k"], (total - (r["cap"] or 0)) / r["open"]
    return w.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))


def _exact_sum(x):
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def _solve(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """source -> lam, by safeguarded Newton steps on the dual."""
    log2 = F.log(F.lit(float(MAX_COPIES)))
    least = cells.filter("size > 0").groupBy("source").agg(F.min("size").alias("least"))
    state = targets.join(least.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    full = F.col("target") >= MAX_COPIES * F.col("source_size")
    state = state.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        mean.alias("mean"),
        full.alias("done"),
        F.when(full, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("lam"),
        F.lit(-1e6).alias("lo"),
        (F.coalesce(log2 / (F.col("least") / mean), F.lit(0.0)) + 1).alias("hi"),
    )
    state = materialize(state, "mix-state")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        tilt = F.col("lam") * x
        rate = F.exp(F.least(tilt, log2))
        words = F.col("n") * F.col("size")
        sums = (
            cells.join(state.filter(~F.col("done")), F.col("source").eqNullSafe(F.col("s")))
            .groupBy(F.col("s").alias("__s"))
            .agg(_exact_sum(words * rate).alias("got"), _exact_sum(F.when(tilt < log2, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        step = state.join(sums, F.col("s").eqNullSafe(F.col("__s")), "left")
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        new = F.col("lam") - off / F.col("slope")
        new = F.when((F.col("slope") > 0) & (new > lo) & (new < hi), new).otherwise((lo + hi) / 2)
        done = F.col("done") | F.col("got").isNull() | (F.abs(off) <= TOLERANCE * F.col("target"))
        state = materialize(
            step.select("s", "source_size", "target", "mean", done.alias("done"), F.when(done, F.col("lam")).otherwise(new).alias("lam"), F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi")),
            "mix-state",
        )
        if not state.filter(~F.col("done")).limit(1).count():
            break
    return state.select(F.col("s").alias("source"), "lam", "mean", "target", "source_size")


def _whole_copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the cells of one source; in falling order of size, words taken follow words wanted."""
    pdf = pdf.sort_values("size", ascending=False)
    wanted = taken = 0.0
    copies = []
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
        if not size:
            copies.append(n)
            continue
        wanted += n * size * rate
        k = min(max(round((wanted - taken) / size), 0), MAX_COPIES * n)
        taken += k * size
        copies.append(k)
    return pdf[["source", "size", "n"]].assign(copies=pd.Series(copies, index=pdf.index, dtype="int64"))


def _shares(sizes: DataFrame, weights, share: float, cell: int) -> tuple[DataFrame, DataFrame]:
    """Keys (source, size, doc_id, h; m rows each) with base copies for each row and one more for odd of them; and the targets."""
    cells = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    targets = materialize(source_targets(sizes, weights, share), "mix-targets")
    solved = _solve(cells, targets).withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam") == float("inf"), float(MAX_COPIES)).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(MAX_COPIES))))))
    rated = cells.join(solved, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", rate.alias("rate"))
    kind = sizes.schema["source"].dataType.simpleString()
    dealt = materialize(rated.groupBy("source").applyInPandas(_whole_copies, f"source {kind}, size long, n long, copies long"), "mix-copies")
    c = dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", F.expr("copies div n").alias("base"), (F.col("copies") % F.col("n")).alias("cell_odd"))
    keys = sizes.groupBy("source", "size", "doc_id", "h").agg(F.count("*").alias("m"))
    keys = keys.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    keys = keys.withColumn("rank", F.xxhash64("doc_id", "h")).withColumn("sub", F.pmod("rank", F.ceil(F.col("n") / cell)).cast("long"))
    subs = keys.groupBy("source", "size", "sub", "n", "cell_odd").agg(F.sum("m").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0))
    subs = subs.withColumn("upto", upto).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("sub").alias("b"), F.expr("(cell_odd * upto) div n - (cell_odd * (upto - k)) div n").alias("here")
    )
    keys = keys.join(subs, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("b")))
    before = F.sum("m").over(Window.partitionBy("source", "size", "sub").orderBy("rank", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    odd = F.greatest(F.lit(0), F.least(F.col("m"), F.col("here") - F.col("before")))
    return keys.withColumn("before", before).select("source", "size", "doc_id", "h", "m", "base", odd.alias("odd")), targets


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cell: int = CELL) -> DataFrame:
    """sizes: doc_id, source, size, h (a hash of the text). Adds source_size, target, copies; one row per row."""
    keys, targets = _shares(sizes, weights, share, cell)
    part = F.explode(F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("odd").alias("k")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("odd")).alias("k"))))
    parts = keys.select("source", "size", "doc_id", part.alias("p")).select("source", "size", "doc_id", "p.copies", "p.k").filter("k > 0")
    # a key's rows are alike: k of them are made again, at most ROWS from one array
    runs = parts.select("source", "size", "doc_id", "copies", "k", F.explode(F.sequence(F.lit(0), F.expr(f"(k - 1) div {ROWS}"))).alias("run"))
    rows = runs.withColumn("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(ROWS), F.col("k") - ROWS * F.col("run")))))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(t, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "copies")


def document_sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """A written table: doc_id, source, size in words, h."""
    body = F.coalesce(F.col(text), F.lit(""))
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(body).alias("size"), F.xxhash64(body).alias("h")), "mix-sizes")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cell: int = CELL) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    keys, _ = _shares(document_sizes(docs), weights, share, cell)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.xxhash64(body).alias("__h"))
    same = F.col("__i").eqNullSafe(F.col("doc_id")) & F.col("__s").eqNullSafe(F.col("source")) & (F.col("__h") == F.col("h"))
    rows = rows.join(keys, same)
    place = F.row_number().over(Window.partitionBy("__i", "__s", "__h").orderBy(F.xxhash64("__row")))
    single = rows.filter("m = 1").withColumn("__times", F.col("base") + F.col("odd"))
    several = rows.filter("m > 1").withColumn("__times", F.col("base") + (place <= F.col("odd")).cast("long"))
    times = single.select("__row", "__times").unionByName(several.select("__row", "__times")).filter("__times > 0")
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
