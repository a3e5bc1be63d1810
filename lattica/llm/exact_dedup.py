"""Exact deduplication with salted, content-checked combining. DataFrame operators only.

1. local: Spark's partial aggregation merges equal texts inside each input partition;
2. salted: partial groups meet per (digest, salt), so a group of copies that holds a third of all rows is merged
   by as many tasks as there are salts;
3. global: at most one row per salt and content is left of each group; their maximum and sum give the winner.

All three steps group by the normalised text itself beside its digest (SHA-256, a second 64-bit hash, byte length): two texts are merged
only when their whole contents are equal, and the last step also numbers the different contents of a digest. The winners go back to the documents over
(digest, salt), where again no key holds more than a salt's share of a group. That is a comparison of contents too wherever a digest has been
found to stand for one content; a digest with several contents takes its documents back over the contents themselves.

Defined results: a null text counts as empty; null ids are smaller than any other id and are kept only when a group
has no other (``keep_id`` is then null); repeated rows of one id are one row each, all ``kept`` if the id is; an empty table
gives no rows; other columns are passed through untouched unless their name is one of the result's, which replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.shared import materialize

from .columns import ascii_lower, salt_of

SALTS = 32


KEY = ["__sha", "__h2", "__len"]


def digests(norm: Column) -> list[Column]:
    return [F.sha2(norm.cast("binary"), 256).alias("__sha"), F.xxhash64(norm).alias("__h2"), F.octet_length(norm).alias("__len")]


def _keyed(docs: DataFrame, text: str, doc_id: str, normalise, salts: int, digest) -> DataFrame:
    norm = normalise(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("__id"), F.struct(*docs.columns).alias("__row"), norm.alias("__norm"))
    return rows.select("__id", "__row", "__norm", *digest(F.col("__norm")), salt_of(F.col("__id"), salts).alias("__salt"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=ascii_lower, salts: int = SALTS, digest=digests) -> DataFrame:
    """One row per (content, salt): its digest and salt, __norm, __nth (the content's number within its digest), __keep and __size of the whole group."""
    salted = _keyed(docs, text, doc_id, normalise, salts, digest).groupBy(*KEY, "__salt", "__norm").agg(F.max("__id").alias("__max"), F.count("*").alias("__n"))
    numbered = salted.withColumn("__nth", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("__norm")))
    group = Window.partitionBy(*KEY, "__norm")  # a row per salt at most
    return numbered.select(*KEY, "__salt", "__norm", "__nth", F.max("__max").over(group).alias("__keep"), F.sum("__n").over(group).alias("__size"))


def _labelled(docs: DataFrame, text: str, doc_id: str, normalise, salts: int, digest, columns: list[str]) -> DataFrame:
    """columns of the keyed documents, with __keep and __size of their group."""
    groups = materialize(exact_groups(docs, text, doc_id, normalise, salts, digest).drop("__norm"), "exact-groups")
    rows = _keyed(docs, text, doc_id, normalise, salts, digest)
    several = groups.filter("__nth > 1").select(*KEY).distinct()
    if several.isEmpty():  # every digest is one content
        return rows.select(*columns, *KEY, "__salt").join(groups.drop("__nth"), [*KEY, "__salt"])
    whole = exact_groups(docs, text, doc_id, normalise, salts, digest).drop("__nth").join(several, KEY, "left_semi")
    one = rows.join(several, KEY, "left_anti").select(*columns, *KEY, "__salt").join(groups.drop("__nth"), [*KEY, "__salt"])
    return one.unionByName(rows.join(whole, [*KEY, "__salt", "__norm"]).select(*one.columns))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=ascii_lower, salts: int = SALTS, digest=digests) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return _labelled(docs, text, doc_id, normalise, salts, digest, ["__id"]).select(
        F.col("__id").alias(doc_id),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=ascii_lower, salts: int = SALTS, digest=digests) -> DataFrame:
    """The documents whose row stays, all columns; of rows that repeat an id and a content, one."""
    kept = _labelled(docs, text, doc_id, normalise, salts, digest, ["__id", "__row"]).filter(F.col("__id").eqNullSafe(F.col("__keep")))
    # rows that repeat id and content are few, if any; only they are grouped, each task's first, the others stay where the join has put them
    norm = normalise(F.coalesce(F.col("__row")[text], F.lit("")))
    key = ["__id", *KEY]
    repeated = materialize(_keyed(docs, text, doc_id, normalise, salts, digest).groupBy(*key).agg(F.count("*").alias("__rows")).filter("__rows > 1").drop("__rows"), "exact-repeated")
    if repeated.isEmpty():
        return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
    same = [kept["__id"].eqNullSafe(repeated["__id"]), *(kept[c] == repeated[c] for c in KEY)]
    once = kept.join(repeated, same, "left_anti").select("__row")
    again = kept.join(repeated, same, "left_semi").groupBy("__id", norm.alias("__norm")).agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row")
    return once.unionByName(again).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
