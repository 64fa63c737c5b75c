"""Writers of curated sentences, prompts, metadata and splits. Each takes rows in their final order, with ``position`` from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("position").sortWithinPartitions("position")


def write_texts(df: DataFrame, path: str) -> None:
    _ordered(df).select("text").write.mode("overwrite").text(path)


def metadata_rows(df: DataFrame) -> DataFrame:
    """Eight columns; the id is the position in five digits, the score has one decimal."""
    return df.select(
        F.format_string("%05d", F.col("position").cast("long")).alias("id"), "text", "char_count", "word_count", "sentence_type", "style",
        F.format_string("%.1f", F.col("quality_score").cast("double")).alias("quality_score"), "source",
    )


def write_metadata_csv(df: DataFrame, path: str) -> None:
    metadata_rows(_ordered(df)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_training_json(df: DataFrame, path: str) -> None:
    cols = ["id", F.col("text").alias("sentence"), "char_count", "word_count", "sentence_type", "style", "quality_score", "has_conjuncts"]
    _ordered(df).select(*cols).write.mode("overwrite").json(path)


def write_recording_prompts(df: DataFrame, path: str) -> None:
    _ordered(df).select(F.format_string("%05d", F.col("position").cast("long")).alias("prompt_id"), "text", F.lit("pending").alias("status")).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_prompts(prompts: DataFrame, path: str) -> None:
    """The whole prompt table; an empty one leaves what is there."""
    if prompts.limit(1).count():
        prompts.select("prompt_id", "type", "text", "status").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def ljspeech_lines(rows: DataFrame) -> DataFrame:
    """name|text|phonemes, unquoted."""
    return rows.select(F.concat_ws("|", "wav", "text", "phonemes").alias("value"))


def write_ljspeech(rows: DataFrame, path: str) -> None:
    ljspeech_lines(rows).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """train, val and test below ``path``, of rows with ``split`` and ``value``; one pass over the rows each."""
    for s in ("train", "val", "test"):
        rows.where(F.col("split") == s).select("value").write.mode("overwrite").text(f"{path}/{s}")


def write_report(stats: dict[str, DataFrame], path: str) -> None:
    """The report's lines of ``operators.stats.report``."""
    stats["report"].orderBy("line").select(strip(F.col("text")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
