"""Whole runs: curate a corpus, prepare training data, process recordings; and the SQL names of the functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import g2p, numbers
from ..functions.profiles import BENGALI, Profile
from ..operators import audio, corpus, stats
from ..sources import readers, writers


def curate(sources: list[DataFrame], path: str, k: int = 20_000, profile: Profile = BENGALI) -> DataFrame:
    """Sources in order, analyzed, deduplicated, selected; writes the five outputs below ``path`` and returns the selection."""
    rows = corpus.deduplicate(corpus.analyze(readers.union_sources(*sources), profile))
    best = corpus.select_with_fallback(rows, k, profile)
    number = F.row_number().over(W.orderBy(F.desc("quality_score"), F.asc("ord")))  # the k selected rows
    best = best.withColumn("position", number).cache()
    writers.write_texts(best, f"{path}/sentences")
    writers.write_metadata_csv(best, f"{path}/metadata")
    writers.write_training_json(best, f"{path}/training")
    writers.write_recording_prompts(best, f"{path}/prompts")
    writers.write_report(stats.report(best, profile), f"{path}/report")
    return best


def prepare(meta: DataFrame, files: DataFrame, folder: str, path: str, seed: int = 42) -> DataFrame:
    """Metadata matched to audio, phonemes, splits; writes the LJSpeech table and a file list for each split."""
    rows = corpus.ljspeech(meta, files, g2p.phonemes_of_raw)
    writers.write_ljspeech(rows, f"{path}/metadata")
    lines = corpus.split_sets(writers.ljspeech_lines(rows), "value", seed=seed)
    out = None
    for s in ("train", "val", "test"):
        part = corpus.filelist(lines.where(F.col("split") == s), files, folder).withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    writers.write_splits(out, f"{path}/filelists")
    return out


def check_recordings(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Metrics and verdicts of the WAV files of a folder, each decoded once."""
    return audio.verdicts(audio.metrics(readers.waveforms(readers.audio_files(spark, folder, ("wav",)))), strict)


def _over(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


def register_functions(spark: SparkSession) -> None:
    """SQL names of the text functions that need Python."""
    for name, f in (("bn_spoken", numbers.spoken_text), ("bn_phonemes", g2p.to_phonemes), ("bn_numbers", numbers.numbers), ("bn_dates", numbers.dates), ("bn_money", numbers.money)):
        spark.udf.register(name, F.pandas_udf(_over(f), "string"))


__all__ = ["curate", "prepare", "check_recordings", "register_functions"]
