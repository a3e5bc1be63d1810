"""Evaluation of token tables by position: an equi-join on start offsets, then counts per level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import csv_fields
from lattica.plans.model import csv_split


def offsets(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds start: bytes of the tokens before."""
    w = Window.partitionBy(*keys).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("start", F.coalesce(F.sum(F.octet_length("surface")).over(w), F.lit(0)))


def _shown(level: int):
    """The surface and the first ``level`` features; all of them for -1."""
    fields = csv_fields(F.col("feature"))
    return F.concat_ws(",", F.array(F.col("surface")), fields if level < 0 else F.slice(fields, F.lit(1), F.lit(max(level, 0))) if level else F.array().cast("array<string>"))


def evaluate(system: DataFrame, gold: DataFrame, keys: Sequence[str], levels: Sequence[int] = (0, -1)) -> DataFrame:
    """level, correct, n_system, n_gold, precision, recall, f (per cent)."""
    shown = {f"l{i}": _shown(x) for i, x in enumerate(levels)}
    s = offsets(system, keys).select(*keys, "start", *[c.alias("s_" + n) for n, c in shown.items()], F.lit(1).alias("s"))
    g = offsets(gold, keys).select(*keys, "start", *[c.alias("g_" + n) for n, c in shown.items()], F.lit(1).alias("g"))
    both = s.join(g, [*keys, "start"], "full")
    sums = both.agg(F.count("s").alias("n_system"), F.count("g").alias("n_gold"), *[F.sum(F.when(F.col("s_" + n) == F.col("g_" + n), 1).otherwise(0)).alias(n) for n in shown])
    return _figures(sums, levels)


def evaluate_arrays(df: DataFrame, levels: Sequence[int] = (0, -1), system: str = "system", gold: str = "gold") -> DataFrame:
    """The same for sentences whose tokens (arrays of structs of surface and feature, in order) stand in one row: nothing is moved but sums."""
    wanted = list(levels)

    def tokens(column: pa.Array):
        column = column.fill_null([])
        flat = column.flatten()
        surface, feature = (flat.field(n).cast(pa.large_string()).dictionary_encode() for n in ("surface", "feature"))
        n = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        texts = surface.dictionary.to_pylist()
        code = surface.indices.to_numpy(zero_copy_only=False)
        size = np.array([len(x.encode()) for x in texts], np.int64)[code] if len(code) else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        first = np.cumsum(n) - n
        start = start - np.append(start, 0)[np.minimum(first, len(start))][row] if len(start) else start
        return row, start, texts, code, [csv_split(x) for x in feature.dictionary.to_pylist()], feature.indices.to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            (rs, ss, ts, cs, fs, ks), (rg, sg, tg, cg, fg, kg) = tokens(batch.column(0)), tokens(batch.column(1))
            wide = 1 + int(max(ss.max(initial=0), sg.max(initial=0)))
            place_s, place_g = rs * wide + ss, rg * wide + sg  # neither falls
            low, high = np.searchsorted(place_g, place_s, "left"), np.searchsorted(place_g, place_s, "right")
            n = high - low
            s = np.repeat(np.arange(len(n)), n)
            g = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts = []
            for level in wanted:
                text = lambda surface, cells, level=level: ",".join([surface, *(cells if level < 0 else cells[:level])])
                ids: dict[str, int] = {}
                shown = []
                for texts, code, cells, kind in ((ts, cs[s], fs, ks[s]), (tg, cg[g], fg, kg[g])):
                    pair, index = np.unique(code.astype(np.int64) * max(len(cells), 1) + kind, return_inverse=True)
                    one = np.array([ids.setdefault(text(texts[x // max(len(cells), 1)], cells[x % max(len(cells), 1)]), len(ids)) for x in pair.tolist()], np.int64)
                    shown.append(one[index])
                counts.append(int((shown[0] == shown[1]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(rs), len(rg), *counts)], names=names)

    names = ["n_system", "n_gold", *(f"l{i}" for i in range(len(wanted)))]
    sums = df.select(system, gold).mapInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return _figures(sums, levels)


def _figures(sums: DataFrame, levels: Sequence[int]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(x).alias("level"), F.coalesce(F.col(f"l{i}"), F.lit(0)).alias("correct")) for i, x in enumerate(levels)])
    out = sums.select("n_system", "n_gold", F.inline(rows))
    percent = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(100.0 * F.col("correct") / F.col(n))
    out = out.withColumns({"precision": percent("n_system"), "recall": percent("n_gold")})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total)).select("level", "correct", "n_system", "n_gold", "precision", "recall", "f")


def report(result: DataFrame) -> DataFrame:
    """The figures as lines."""
    name = F.when(F.col("level") < 0, "LEVEL ALL: ").otherwise(F.format_string("LEVEL %d:    ", F.col("level").cast("int")))
    return result.select("level", F.concat(name, F.format_string("%4.4f(%d/%d) %4.4f(%d/%d) %4.4f", "precision", "correct", "n_system", "recall", "correct", "n_gold", "f")).alias("line"))


def raw_sentences(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sentence: the text of token tables; EOS stands for an empty one."""
    parts = F.sort_array(F.collect_list(F.struct("tok_idx", "surface")))
    text = F.array_join(F.transform(parts, lambda x: x["surface"]), "")
    return tokens.groupBy(*keys).agg(F.when(text == "", "EOS").otherwise(text).alias("sentence"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str = "text") -> DataFrame:
    """Rows on which two outputs disagree; a missing one counts."""
    both = a.select(*keys, F.col(column).alias("a")).join(b.select(*keys, F.col(column).alias("b")), list(keys), "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))
