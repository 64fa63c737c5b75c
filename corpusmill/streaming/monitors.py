"""Streaming views, an extension: recordings as they arrive, and early stopping kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import METADATA


def metadata_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Recording metadata as it is appended, with its time."""
    return spark.readStream.schema(METADATA).json(folder).withColumn("at", F.to_timestamp("timestamp"))


def recordings_per_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, recordings, accepted, seconds); rows later than ``late`` are left out."""
    rows = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("window"))
    return rows.agg(F.count("*").alias("recordings"), F.count_if(F.col("accepted")).alias("accepted"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"))


def latest_status(stream: DataFrame) -> DataFrame:
    """(prompt_id, filename, accepted) of each prompt's newest recording."""
    newest = F.max_by(F.struct("filename", "accepted"), "at").alias("r")
    return stream.groupBy("prompt_id").agg(newest).select("prompt_id", "r.filename", "r.accepted")


def early_stopping_stream(stream: DataFrame, patience: int = 10, min_delta: float = 0.001) -> DataFrame:
    """(run, best_value, counter, stopped) after each batch of (run, step, value)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, counter, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")
        for v in rows["value"]:
            if v < best - min_delta:
                best, counter = float(v), 0
            else:
                counter += 1
                stopped = stopped or counter >= patience
        state.update((best, counter, stopped))
        yield pd.DataFrame([(str(key[0]), best, counter, stopped)], columns=["run", "best_value", "counter", "stopped"])

    return stream.groupBy("run").applyInPandasWithState(update, "run string, best_value double, counter int, stopped boolean", "best double, counter int, stopped boolean", "update", "NoTimeout")
