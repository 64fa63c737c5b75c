"""Readers. Every sentence source gives (id, text, original_text, source, style, pos); ``pos`` is the place in its source."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import BENGALI, Profile

SENTENCE = ["id", "text", "original_text", "source", "style", "pos"]
AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "webm")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of each file with their numbers from 1; a file is one record, as numbers need its start."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("p", "value")).select((F.col("p") + 1).alias("line"), "value")


def lines_of(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, text): the non-empty lines of a text column. Order by (key, pos)."""
    return docs.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "text")).where(F.length("text") > 0)


def numbered_sentences(spark: SparkSession, path: str, source: str = "12k", profile: Profile = BENGALI) -> DataFrame:
    """Lines "N,text", "N.text" or bare text; those that are valid and of three characters or more once normalized."""
    lines = numbered_lines(spark, path).select("line", T.strip(F.col("value")).alias("original_text")).where("original_text <> ''")
    rows = lines.withColumn("text", T.normalize_sentence(F.regexp_replace("original_text", r"(?U)^\d+[,.]?\s*", ""), profile))
    rows = rows.where(T.is_valid(F.col("text"), profile) & (F.length("text") >= 3))
    return rows.select(F.format_string(f"{source}_%05d", "line").alias("id"), "text", "original_text", F.lit(source).alias("source"), F.lit("literary").alias("style"), F.col("line").cast("long").alias("pos"))


def json_sentences(spark: SparkSession, path: str, source: str = "jsonl", profile: Profile = BENGALI) -> DataFrame:
    """JSON lines with id, sentence, style; malformed lines go, a missing style is "unknown", a missing id the line number."""
    lines = numbered_lines(spark, path).select("line", T.strip(F.col("value")).alias("original_text")).where("original_text <> ''")
    rows = lines.withColumn("j", F.from_json("original_text", "id string, sentence string, style string, _bad string", {"columnNameOfCorruptRecord": "_bad"})).where("j is not null and j._bad is null")
    rows = rows.withColumn("text", T.normalize_sentence(F.coalesce("j.sentence", F.lit("")), profile))
    rows = rows.where(T.is_valid(F.col("text"), profile) & (F.length("text") >= 3))
    return rows.select(F.coalesce("j.id", F.col("line").cast("string")).alias("id"), "text", "original_text", F.lit(source).alias("source"), F.coalesce("j.style", F.lit("unknown")).alias("style"), F.col("line").cast("long").alias("pos"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def prompt_sentences(spark: SparkSession, path: str, profile: Profile = BENGALI) -> DataFrame:
    """A prompt table as sentences; no least length."""
    rows = load_prompts(spark, path).withColumn("original_text", F.col("text"))
    rows = rows.withColumn("text", T.normalize_sentence(F.col("text"), profile)).where(T.is_valid(F.col("text"), profile))
    return rows.select(F.col("prompt_id").alias("id"), "text", "original_text", F.lit("prompts").alias("source"), F.concat(F.lit("phoneme_"), "type").alias("style"), F.expr("try_cast(prompt_id AS bigint)").alias("pos"))


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, type, text, status) as strings; a missing or null type is "sentence", a missing status "pending"."""
    rows = read_csv(spark, path)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)
    return rows.select(col("prompt_id", "").alias("prompt_id"), col("type", "sentence").alias("type"), col("text", "").alias("text"), col("status", "pending").alias("status"))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that exists, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources in a fixed order, with ``ord``, a struct of (source rank, position) that later keep-first rules go by."""
    ranked = [s.select(*SENTENCE, F.struct(F.lit(i).alias("rank"), F.coalesce("pos", F.lit(0)).alias("pos"), F.col("id").alias("id")).alias("ord")) for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out


METADATA = "speaker_id string, prompt_id string, text string, type string, filename string, duration double, sample_rate int, bits int, accepted boolean, timestamp string"


def recording_metadata(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All rows of ``lines``, repeats included, then the distinct rows of ``files`` that equal none of them, null-safe."""
    seen = lines.distinct()
    new = files.select(*lines.columns).distinct()
    same = [new[c].eqNullSafe(seen[c]) for c in lines.columns]
    on = same[0]
    for s in same[1:]:
        on &= s
    return lines.unionByName(new.join(seen, on, "left_anti"))


def load_metadata(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda glob: spark.read.schema(METADATA).option("pathGlobFilter", glob).option("multiLine", glob == "*.json").json(folder)
    return recording_metadata(read("*.jsonl"), read("*.json"))


def audio_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = AUDIO) -> DataFrame:
    """path, modificationTime, length, content of the files with these endings, in any case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(rf"\.({'|'.join(kinds)})$"))


INFO = "path string, channels int, sample_rate int, bits int, frames long, duration double"


def decode_wav(content: bytes):
    """(channels, rate, bits, frames, samples as mono floats), or None for what isn't PCM WAV of 8 or 16 bits."""
    import numpy as np

    try:
        with wave.open(io.BytesIO(content)) as w:
            n, width, rate, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
            raw = w.readframes(frames)
    except (wave.Error, EOFError, ValueError):
        return None
    if width == 2:
        x = np.frombuffer(raw, "<i2").astype(float) / 32767
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.zeros(0)
    return n, rate, 8 * width, frames, x[: len(x) // n * n].reshape(-1, n).mean(axis=1) if n else x


def audio_info(files: DataFrame) -> DataFrame:
    """(path, channels, sample_rate, bits, frames, duration); nulls for what can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                w = decode_wav(data)
                rows.append((path, *w[:4], w[3] / w[1] if w[1] else 0.0) if w else (path, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "channels", "sample_rate", "bits", "frames", "duration"]).astype({c: "Int64" for c in ("channels", "sample_rate", "bits", "frames")})

    return files.select("path", "content").mapInPandas(run, INFO)


def waveforms(files: DataFrame) -> DataFrame:
    """(path, sample_rate, samples): each file decoded once, for all metrics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, w[1], w[4].tolist()) if (w := decode_wav(c)) else (p, None, None) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"]).astype({"sample_rate": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<double>")


def load_config(text: str, defaults: dict) -> dict:
    """A nested configuration over its defaults; a key that these don't have raises."""

    def over(base: dict, new: dict, at: str) -> dict:
        if unknown := set(new) - set(base):
            raise TypeError(f"unknown configuration keys{at}: {sorted(unknown)}")
        return {k: over(v, new[k], f" of {k}") if isinstance(v, dict) and k in new else new.get(k, v) for k, v in base.items()}

    return over(defaults, json.loads(text), "")


def save_config(config: dict) -> str:
    return json.dumps(config, ensure_ascii=False, indent=2)
