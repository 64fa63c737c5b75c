"""Signal metrics and quality verdicts over sample arrays.

A signal is an array column with its sample rate. All metrics are JVM expressions over the array, so a file is decoded once
for all of them; ``frame_levels`` is the one that walks windows. Loudness normalization, transcoding and speed
changes need an external program; what runs them is planned here as manifests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------------
MIN_DURATION, MAX_DURATION, STRICT_DURATION = 0.5, 15.0, (0.8, 10.0)
CLIPPING, MIN_RMS_DB, MAX_RMS_DB, MIN_SNR_DB = 0.99, -35.0, -10.0, 20.0
SILENCE_DB, MIN_SILENCE, SILENT_SHARE, PADDING = -50.0, 0.3, 0.95, 0.15
# ---------------------------------------------------------------------------------------------------


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), F.lit(0.0))


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x)


def rms_db(x: Column) -> Column:
    """The level in dB; -100 for silence, null for no samples."""
    ms = mean_square(x)
    return F.when(F.size(x) > 0, F.when(ms > 0, 20 * F.log10(F.sqrt(ms))).otherwise(-100.0))


def frame_levels(x: Column, window: Column, hop: Column) -> Column:
    """Levels in dB of the windows that start every ``hop`` before size - window; silent windows are left out."""
    last = F.size(x) - window - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, hop)).otherwise(F.array().cast("array<int>"))
    ms = F.transform(starts, lambda i: mean_square(F.slice(x, i + 1, window)))
    return F.transform(F.filter(ms, lambda v: v > 0), lambda v: 20 * F.log10(F.sqrt(v)))


def quantile(sorted_values: Column, q: float) -> Column:
    """The quantile of a sorted array by linear interpolation; null if empty."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    low = F.try_element_at(sorted_values, lo + 1)
    high = F.coalesce(F.try_element_at(sorted_values, lo + 2), low)
    return F.when(F.size(sorted_values) > 0, low + (high - low) * (at - lo))


def snr_db(x: Column, rate: Column) -> Column:
    """90th less 10th percentile of the levels of 25 ms windows every 10 ms; null if there are none."""
    window, hop = F.floor(rate * 0.025).cast("int"), F.greatest(F.floor(rate * 0.010).cast("int"), F.lit(1))
    levels = F.array_sort(frame_levels(x, window, hop))
    return quantile(levels, 0.9) - quantile(levels, 0.1)


def silence_regions(x: Column, rate: Column, threshold_db: float = SILENCE_DB, shortest: float = MIN_SILENCE) -> Column:
    """[start, end) in seconds of the runs of samples under the threshold that last long enough."""
    floor = 10 ** (threshold_db / 20)
    n = F.size(x)
    loud = F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > floor, i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), loud, F.array(n))
    runs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(((a + 1) / rate).alias("start"), (b / rate).alias("end")))
    return F.filter(runs, lambda r: r["end"] - r["start"] >= shortest)


def silent_share(regions: Column, duration: Column) -> Column:
    """The share of silence; 1 for no duration."""
    total = F.aggregate(regions, F.lit(0.0), lambda a, r: a + r["end"] - r["start"])
    return F.when(duration > 0, total / duration).otherwise(1.0)


def metrics(df: DataFrame, samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    x, r = F.col(samples), F.col(rate)
    df = df.withColumn("duration", F.when(r > 0, F.size(x) / r))
    return df.withColumns({"peak": peak(x), "rms_db": rms_db(x), "snr_db": snr_db(x, r), "silent_share": silent_share(silence_regions(x, r), F.col("duration"))})


def verdicts(df: DataFrame, strict: bool = False) -> DataFrame:
    """``checks`` (name to valid, value, unit), ``issues`` and ``passed`` over the columns of ``metrics``.

    A file without duration is missing: no checks, no verdict, one issue. Levels that can't be told fail without an issue.
    """
    shortest, longest = STRICT_DURATION if strict else (MIN_DURATION, MAX_DURATION)
    d, pk, rms, snr, quiet = (F.col(c) for c in ("duration", "peak", "rms_db", "snr_db", "silent_share"))
    ok = {
        "duration": d.between(shortest, longest),
        "clipping": pk < CLIPPING,
        "rms": F.coalesce(rms.between(MIN_RMS_DB, MAX_RMS_DB), F.lit(False)),
        "snr": F.coalesce(snr >= MIN_SNR_DB, F.lit(False)),
        "silence_only": quiet < SILENT_SHARE,
    }
    value = {"duration": (d, "seconds"), "clipping": (pk, "peak_ratio"), "rms": (rms, "dB"), "snr": (snr, "dB"), "silence_only": (quiet, "ratio")}
    checks = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ok]),
        F.array(*[F.struct(v.alias("valid"), value[k][0].cast("double").alias("value"), F.lit(value[k][1]).alias("unit")) for k, v in ok.items()]),
    )
    issues = F.array(
        F.when(d < shortest, F.format_string(f"Too short (%.2fs < {shortest}s)", d)).when(d > longest, F.format_string(f"Too long (%.2fs > {longest}s)", d)),
        F.when(~ok["clipping"], F.format_string("Audio is clipping (peak=%.3f)", pk)),
        F.when(rms < MIN_RMS_DB, F.format_string("Volume too low (RMS=%.1fdB)", rms)).when(rms > MAX_RMS_DB, F.format_string("Volume too high (RMS=%.1fdB)", rms)),
        F.when(snr < MIN_SNR_DB, F.format_string("Too much background noise (SNR=%.1fdB)", snr)),
        F.when(~ok["silence_only"], F.lit("Recording is mostly silence")),
    )
    there = d.isNotNull()
    passed = ok["duration"]
    for k in ("clipping", "rms", "snr", "silence_only"):
        passed = passed & ok[k]
    return df.withColumns(
        {
            "exists": there,
            "checks": F.when(there, checks),
            "issues": F.when(there, F.filter(issues, lambda i: i.isNotNull())).otherwise(F.array(F.lit("File does not exist"))),
            "passed": F.when(there, passed),
        }
    )


def live_verdict(df: DataFrame, samples: str = "samples", duration: str = "duration") -> DataFrame:
    """(issues, quality_score, passed) of a recording just made, over 16-bit integer samples: 100 less penalties, 0 at least."""
    x, d = F.col(samples), F.col(duration)
    rms = F.when(F.size(x) > 0, F.sqrt(mean_square(x)) / 32767.0).otherwise(0.0)
    heard = d > 0
    found = [
        (F.when(d.isNull(), "Could not read audio file"), F.when(d.isNull(), 50)),
        (F.when(d < 0.3, "Recording too short (< 0.3s)").when(d > 30, "Recording too long (> 30s)"), F.when(d < 0.3, 30).when(d > 30, 10)),
        (F.when(heard & (rms < 0.01), "Recording appears to be silence only").when(heard & (rms < 0.03), "Volume is very low"), F.when(heard & (rms < 0.01), 40).when(heard & (rms < 0.03), 20)),
        (F.when(heard & (peak(x) >= 32700), "Audio is clipping (too loud)"), F.when(heard & (peak(x) >= 32700), 25)),
    ]
    score = F.lit(100)
    for _, penalty in found:
        score = score - F.coalesce(penalty, F.lit(0))
    issues = F.filter(F.array(*[i for i, _ in found]), lambda i: i.isNotNull())
    return df.withColumn("issues", issues).withColumn("quality_score", F.greatest(score, F.lit(0))).withColumn("passed", F.size("issues") == 0)


def split_by_verdict(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that passed, and those that didn't."""
    good = F.coalesce("passed", F.lit(False))
    return df.where(good), df.where(~good)


def rejected_summary(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(good, bad) counts, and the first k rejected paths."""
    bad = ~F.coalesce("passed", F.lit(False))
    return df.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad")), df.where(bad).select("path", "issues").orderBy("path").limit(k)


def duplicate_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(hash, n, paths) of contents that several files share. Unique contents are dropped on counts before paths are gathered."""
    rows = files.select(F.md5(content).alias("hash"), F.col(path).alias("path"))
    several = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "hash").groupBy("hash", "n").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def change_volume(x: Column, factor: float) -> Column:
    return F.transform(x, lambda v: v * factor)


def augmentation_plan(files: DataFrame, speeds=(0.95, 1.05), volumes=(0.9, 1.1)) -> DataFrame:
    """(path, kind, factor, output): each .wav file itself and with each factor but 1."""
    steps = [("original", 1.0, "")] + [("speed", f, f"_speed{f:.2f}") for f in speeds if f != 1.0] + [("volume", f, f"_vol{f:.2f}") for f in volumes if f != 1.0]
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(f)).alias("factor"), F.lit(s).alias("suffix")) for k, f, s in steps]))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.where(F.lower("path").rlike(r"\.wav$")).select("path", name.alias("name"), made.alias("m"))
    out = F.when(F.col("m.suffix") == "", F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), "m.suffix", F.lit(".wav")))
    return rows.select("path", "m.kind", "m.factor", out.alias("output"))


def augmentation_stats(plan: DataFrame) -> DataFrame:
    c = lambda k, n: F.count_if(F.col("kind") == k).alias(n)
    return plan.agg(c("original", "original_files"), c("speed", "speed_augmented"), c("volume", "volume_augmented"), F.count("*").alias("total_output"))


def processing_plan(files: DataFrame, folder: str, sample_rate: int = 16_000, trim: bool = True, normalize: bool = True) -> DataFrame:
    """(input, output, steps, arguments) of a directory run: what the external program does to each file, in order."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    steps = ["convert"] + ["trim"] * trim + ["normalize"] * normalize
    args = F.create_map(F.lit("sample_rate"), F.lit(str(sample_rate)), F.lit("trim_db"), F.lit(str(min(SILENCE_DB, -55.0))), F.lit("trim_seconds"), F.lit(str(max(MIN_SILENCE, 0.5))), F.lit("padding"), F.lit(str(PADDING)), F.lit("lufs"), F.lit("-14.0"))
    return files.select(F.col("path").alias("input"), F.concat(F.lit(folder.rstrip("/") + "/"), stem, F.lit(".wav")).alias("output"), F.array(*[F.lit(s) for s in steps]).alias("steps"), args.alias("arguments"))


def keep_trim(original: Column, trimmed: Column) -> Column:
    """Whether a trimmed file stands: no more than 30 percent of the duration went."""
    return trimmed >= original * 0.7


def read_loudness(log: Column) -> Column:
    """The loudness in a program's log: JSON between its last "{" and last "}"."""
    body = F.regexp_extract(log, r"(?s).*(\{[^{}]*\})", 1)
    return F.try_to_number(F.get_json_object(body, "$.input_i"), F.lit("S999.99")).cast("double")


def validate_entries(meta: DataFrame, files: DataFrame, form) -> DataFrame:
    """Metadata rows (filename, text) with valid, issues, actual_duration (of ``files``: name, duration) and normalized_text."""
    j = meta.join(files.select(F.col("name").alias("_name"), F.col("duration").alias("actual_duration")), F.col("filename") == F.col("_name"), "left")
    named, empty = F.coalesce("filename", F.lit("")) != "", F.coalesce("text", F.lit("")) == ""
    lost = named & F.col("_name").isNull()
    normal = form(F.col("text"))
    odd = ~empty & (normal != F.col("text"))
    issues = F.array(F.when(lost, F.concat(F.lit("Audio file not found: "), "filename")), F.when(empty, F.lit("Empty text")), F.when(odd, F.lit("Text needs UTF-8 normalization")))
    return j.withColumns({"valid": ~(lost | empty), "issues": F.filter(issues, lambda i: i.isNotNull()), "normalized_text": F.when(odd, normal)}).drop("_name")
