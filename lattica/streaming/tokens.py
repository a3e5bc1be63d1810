"""Tokenizing streams, with models that may change between micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lattica.operators.decode import tokenize
from lattica.plans.model import Model


def tokenize_stream(lines: DataFrame, model: Model, text: str = "value") -> DataFrame:
    """Tokens of a stream of sentences, in append mode and without state."""
    return tokenize(lines, model, text)


def swapping(lines: DataFrame, load: Callable[[], tuple[str, Model]], sink: Callable[[DataFrame, int], None], text: str = "value") -> DataStreamWriter:
    """Every micro-batch asks for the current (version, model) and decodes with it; sink gets its tokens with their model_version."""

    def work(batch: DataFrame, epoch: int) -> None:
        version, model = load()
        sink(tokenize(batch, model, text).withColumn("model_version", F.lit(version)), epoch)

    return lines.writeStream.foreachBatch(work)


def token_counts(tokens: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of surfaces in event-time windows; later rows than the watermark are dropped by Spark."""
    return tokens.withWatermark(ts, late).groupBy(F.window(ts, size), "surface").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "surface", "n")
