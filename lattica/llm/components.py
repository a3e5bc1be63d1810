"""Connected components of a graph in tables: alternating large and small stars, each one aggregation and one join.

Every round is a written table; edges, nodes and labels never meet in the driver. A hub's neighbours are pre-aggregated
to their minimum before the shuffle, and the join back may be split at the hub by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.shared import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, label: str = "stars") -> DataFrame:
    """edges (a, b) of longs -> (a, b): every node but the smallest of its component, and that smallest."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = _mark(now)
    while before[0]:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), label)
        after = _mark(now)
        if after == before:
            break
        before = after
    return now
