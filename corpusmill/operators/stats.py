"""Statistics of a corpus and of its recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import BENGALI, Profile

BUCKETS = ("1-10", "11-20", "21-30", "31-50", "51-80", "80+")


def overview(df: DataFrame) -> DataFrame:
    """One row: sentences, characters, words, average length, and the hours of audio that a reading would take."""
    chars = F.coalesce(F.sum("char_count"), F.lit(0))
    return df.agg(
        F.count("*").alias("total_sentences"),
        chars.alias("total_characters"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("avg_sentence_length"),
        (chars / 5 / 3600).alias("estimated_hours"),
    )


def unit_counts(df: DataFrame) -> DataFrame:
    """(unit, sentences): the sentences that hold each inventory unit."""
    return df.select(F.explode("phoneme_coverage").alias("unit")).groupBy("unit").agg(F.count("*").alias("sentences"))


def conjunct_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("has_conjuncts").alias("conjunct")).groupBy("conjunct").agg(F.count("*").alias("sentences"))


def top_conjuncts(df: DataFrame, k: int = 20, order: str = "ord") -> DataFrame:
    """The k commonest conjuncts; ties by where they are seen first, then by inventory order inside a sentence."""
    rows = df.select(order, F.posexplode("has_conjuncts").alias("pos", "conjunct"))
    got = rows.groupBy("conjunct").agg(F.count("*").alias("sentences"), F.min(F.struct(order, "pos")).alias("first"))
    return got.orderBy(F.desc("sentences"), F.asc("first")).limit(k).select("conjunct", "sentences")


def type_shares(df: DataFrame) -> DataFrame:
    """(sentence_type, sentences, percent)."""
    counts = df.groupBy("sentence_type").agg(F.count("*").alias("sentences"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).select("sentence_type", "sentences", (F.col("sentences") * 100 / F.col("n")).alias("percent"))  # one row


def length_bucket(n: str = "char_count") -> Column:
    c = F.col(n)
    return F.when(c <= 10, "1-10").when(c <= 20, "11-20").when(c <= 30, "21-30").when(c <= 50, "31-50").when(c <= 80, "51-80").otherwise("80+")


def length_histogram(df: DataFrame) -> DataFrame:
    """(bucket, sentences) of all six buckets, zeros included."""
    counts = df.groupBy(length_bucket().alias("bucket")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return all_.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("sentences"))


def inventory_table(df: DataFrame, profile: Profile = BENGALI) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, f"{c}:{u}") for c, us in profile.units.items() for u in us], "category string, unit string")


def category_coverage(df: DataFrame, profile: Profile = BENGALI) -> DataFrame:
    """(category, covered, total, percent) over the inventory."""
    seen = unit_counts(df).select("unit", F.lit(1).alias("hit"))
    rows = inventory_table(df, profile).join(seen, "unit", "left").groupBy("category")
    return rows.agg(F.count("hit").alias("covered"), F.count("*").alias("total")).withColumn("percent", F.col("covered") * 100 / F.col("total"))


def missing_units(df: DataFrame, profile: Profile = BENGALI) -> DataFrame:
    """(category, unit) that no sentence holds."""
    return inventory_table(df, profile).join(unit_counts(df), "unit", "left_anti").select("category", "unit")


def prompt_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("type").agg(F.count("*").alias("prompts"))


def status_counts(prompts: DataFrame, status: str = "status") -> DataFrame:
    c = lambda s: F.count_if(F.col(status) == s).alias(s)
    return prompts.agg(F.count("*").alias("total_prompts"), c("pending"), c("done"), c("retry"))


def recording_stats(prompts: DataFrame, recordings: DataFrame) -> DataFrame:
    """Status counts beside the count and total duration of recordings (duration)."""
    total = F.coalesce(F.sum("duration"), F.lit(0.0))
    rec = recordings.agg(F.count("*").alias("recordings"), F.bround(total, 2).alias("total_duration_seconds"), F.bround(total / 60, 2).alias("total_duration_minutes"))
    return status_counts(prompts).crossJoin(rec)  # one row each


def report(df: DataFrame, profile: Profile = BENGALI) -> dict[str, DataFrame]:
    """The tables of a report, and "report" with its lines (line, text)."""
    tables = {"overview": overview(df), "types": type_shares(df), "lengths": length_histogram(df), "coverage": category_coverage(df, profile), "missing": missing_units(df, profile)}
    o = tables["overview"].select(F.lit("overview").alias("part"), F.lit("").alias("k"), F.format_string("Sentences: %d  Characters: %d  Words: %d  Average: %.1f  Hours: %.1f", "total_sentences", "total_characters", "total_words", "avg_sentence_length", "estimated_hours").alias("text"))
    t = tables["types"].select(F.lit("types").alias("part"), F.col("sentence_type").alias("k"), F.format_string("%s: %d (%.1f%%)", "sentence_type", "sentences", "percent").alias("text"))
    b = tables["lengths"].select(F.lit("lengths").alias("part"), F.col("bucket").alias("k"), F.format_string("%s: %d", "bucket", "sentences").alias("text"))
    c = tables["coverage"].select(F.lit("units").alias("part"), F.col("category").alias("k"), F.format_string("%s: %d/%d (%.1f%%)", "category", "covered", "total", "percent").alias("text"))
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(("overview", "types", "lengths", "units")) for x in (p, i)])
    lines = o.unionByName(t).unionByName(b).unionByName(c)
    from pyspark.sql import Window as W

    number = F.row_number().over(W.orderBy(rank[F.col("part")], "k"))  # a few dozen lines
    return tables | {"report": lines.select(number.alias("line"), "text")}
