"""Curation: features, scores, dedup, coverage, balance, selection, prompts and splits.

Order is data here: ``ord`` (any orderable column) is the place of a row in its list, and every sort by score breaks ties by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import BENGALI, Profile
from .ranking import global_rank, shared_table


def analyze(df: DataFrame, profile: Profile = BENGALI) -> DataFrame:
    """char_count, word_count, phoneme_coverage, has_conjuncts, sentence_type of ``text``."""
    t = F.col("text")
    return df.withColumns(
        {
            "char_count": F.length(t),
            "word_count": T.word_count(t),
            "phoneme_coverage": T.unit_list(t, profile),
            "has_conjuncts": T.conjunct_list(t, profile),
            "sentence_type": T.sentence_type(t),
        }
    )


def quality_score(profile: Profile = BENGALI) -> Column:
    """10 to 100 from length, units, clusters, completeness and type; over the columns of ``analyze``."""
    n = F.col("char_count")
    length = F.when(n.between(15, 50), 30).when(n.between(10, 60), 20).when(n.between(5, 80), 10).otherwise(5)
    units = F.least(F.size("phoneme_coverage") * 1.5, F.lit(30.0))
    conjuncts = F.least(F.size("has_conjuncts") * 3, F.lit(15))
    ends = F.when(F.substring("text", -1, 1).rlike(f"[{profile.terminators}]"), 10).otherwise(0)
    starts = F.when(F.col("text").rlike(f"^[{profile.letters}]"), 5).otherwise(0)
    kind = F.when(F.col("sentence_type") == "question", 10).when(F.col("sentence_type") == "exclamation", 8).otherwise(5)
    return (length + units + conjuncts + ends + starts + kind).cast("double")


def score(df: DataFrame, profile: Profile = BENGALI) -> DataFrame:
    """``df`` with ``quality_score``; from an array of one, so that a filter on it doesn't repeat the whole score."""
    return df.withColumn("quality_score", F.explode(F.array(quality_score(profile))))


def has_length(shortest: int = 3, longest: int = 150) -> Column:
    return F.col("char_count").between(shortest, longest)


def has_quality(least: float = 20.0) -> Column:
    return F.col("quality_score") >= least


def filter_length(df: DataFrame, shortest: int = 3, longest: int = 150) -> DataFrame:
    return df.where(has_length(shortest, longest))


def filter_quality(df: DataFrame, least: float = 20.0) -> DataFrame:
    return df.where(has_quality(least))


def deduplicate(df: DataFrame, order: str = "ord") -> DataFrame:
    """The first row, by order, of each text that is equal but for case and white space; partial minima before the shuffle."""
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(order)).alias("r")
    return df.groupBy(T.dedup_key(F.col("text")).alias("_key")).agg(best).select("r.*")


#: The most rows that ``top`` lets single tasks hold.
HELD = 100_000


def top(df: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """The k best by score, then order. Up to ``HELD`` rows meet in one task; more are ranked in ranges."""
    by = [F.desc("quality_score"), F.asc(order)]
    if k <= HELD:
        return df.orderBy(*by).limit(k)
    return global_rank(shared_table(df), by, "_r").where(F.col("_r") <= k).orderBy("_r").drop("_r")


#: Units in one number of a row's bits.
BITS = 62


def _sort_key(v):
    """A value as Python compares it in Spark's ascending order: nulls first."""
    return tuple(_sort_key(x) for x in v) if isinstance(v, tuple) else (v is not None, v)


def coverage_rank(df: DataFrame, target: int = 10, order: str = "ord", pool: int = 5000) -> DataFrame:
    """``df`` with ``coverage_rank`` from 1: greedy multi-cover, then the rest by score. Every row stays.

    A row's gain, the units it has that are still under ``target``, changes only when a unit gets there, and then only falls. So the
    first rows by gain and order go to the driver, as many as picks can follow, ``pool`` at most; it picks among them while the best
    of them comes before the last that was fetched; then the next are fetched. With u units there are at most u*target picks, and u
    fetches if ``pool`` is not less than that. One task brings a fetch together, so the driver gets its rows and no more.
    """
    spark = df.sparkSession
    table = shared_table(df)  # each round reads a table, none computes the rows again
    kind = table.schema[order].dataType.simpleString()
    units = sorted(r[0] for r in table.select(F.explode("phoneme_coverage").alias("u")).where("u is not null").distinct().collect())  # the inventory
    parts = [units[i : i + BITS] for i in range(0, len(units), BITS)]
    value = lambda part, u: F.element_at(F.lit([0] + [1 << j for j in range(len(part))]).cast("array<long>"), (F.array_position(F.lit(part), u) + 1).cast("int"))
    bit = lambda part: lambda m, u: m.bitwiseOR(F.coalesce(value(part, u), F.lit(0).cast("long")))
    bits = [F.aggregate("phoneme_coverage", F.lit(0).cast("long"), bit(p)).alias(f"m{i}") for i, p in enumerate(parts)]
    base = shared_table(table.select(F.col(order).alias("o"), *bits)) if units else None
    have = [0] * len(units)
    still = (1 << len(units)) - 1 if target > 0 else 0  # the units under target, as bits
    whole = lambda r: sum(r[f"m{i}"] << i * BITS for i in range(len(parts)))
    picks: list = []
    while still:
        gain = F.lit(0)
        for i in range(len(parts)):
            gain = gain + F.bit_count(F.col(f"m{i}").bitwiseAND(F.lit(still >> i * BITS & (1 << BITS) - 1).cast("long")))
        rows = base.withColumn("gain", gain).where("gain > 0")
        if picks:
            rows = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in picks], f"o {kind}")), "o", "left_anti")
        most = min(pool, sum(target - n for n in have if n < target))
        rows = rows.orderBy(F.desc("gain"), "o").limit(most).agg(F.collect_list(F.struct("o", *[f"m{i}" for i in range(len(parts))])).alias("rows")).first()[0]
        held = [(_sort_key(r.o), whole(r), r.o) for r in rows]
        if not held:
            break
        by = lambda h: (-(h[1] & still).bit_count(), h[0])  # noqa: B023, E731
        last = max(map(by, held)) if len(held) == most else None
        while held:
            best = min(held, key=by)
            gained = best[1] & still
            if not gained or last and by(best) > last:
                break
            held.remove(best)
            picks.append(best[2])
            for i in range(len(units)):
                if gained >> i & 1:
                    have[i] += 1
                    if have[i] >= target:
                        still &= ~(1 << i)
    chosen = spark.createDataFrame([(p, i) for i, p in enumerate(picks, 1)], f"_o {kind}, _pick int")
    rows = table.join(F.broadcast(chosen), F.col(order) == F.col("_o"), "left").drop("_o")  # units * target rows at most
    rest = global_rank(rows.where("_pick is null"), [F.desc("quality_score"), F.asc(order)], "_r")
    first = rows.where("_pick is not null").withColumn("coverage_rank", F.col("_pick").cast("long"))
    return first.unionByName(rest.withColumn("coverage_rank", F.col("_r") + len(picks)).drop("_r")).drop("_pick")


def balanced_rank(df: DataFrame, group: Column, shares: dict[str, float], name: str, order: str = "ord") -> DataFrame:
    """``df`` with a rank column: each group's best up to its share of all rows, group by group, then the rest by score.

    Groups are three or so, so their places come from one ``global_rank`` and counts, not from a window over each.
    """
    rows = shared_table(df.withColumn("_g", group))  # counted, ranked and dealt from one table
    counts = {r._g: r.n for r in rows.groupBy("_g").agg(F.count("*").alias("n")).collect()}  # one row for each group
    total = sum(counts.values())
    quota = {g: min(int(total * s), counts.get(g, 0)) for g, s in shares.items()}
    start, ahead, place, at, seen = {}, {}, {}, 0, 0
    for i, g in enumerate(shares):
        start[g], ahead[g], place[g] = at, seen, i
        at += quota[g]
        seen += counts.get(g, 0)
    case = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("_g")]
    rows = global_rank(rows.withColumn("_p", case(place)), [F.asc("_p"), F.desc("quality_score"), F.asc(order)], "_r").withColumn("_r", F.col("_r") - case(ahead))
    late = F.col("_r") > case(quota)
    # the late rows of one group and score stand together, so their places follow from counts; one row for each group and score
    runs = rows.where(late).groupBy("_p", "quality_score").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("quality_score"), F.asc("_p")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = shared_table(runs.select(F.col("_p").alias("_q"), F.col("quality_score").alias("_s"), "_first", before.alias("_before")))
    rows = rows.join(runs, late & (F.col("_p") == F.col("_q")) & F.col("quality_score").eqNullSafe(F.col("_s")), "left")
    place_of = F.when(late, at + F.col("_before") + F.col("_r") - F.col("_first") + 1).otherwise(case(start) + F.col("_r"))
    return rows.withColumn(name, place_of.cast("long")).drop("_g", "_p", "_r", "_q", "_s", "_first", "_before")


def balance_types(df: DataFrame, order: str = "ord") -> DataFrame:
    return balanced_rank(df, F.col("sentence_type"), {"statement": 0.60, "question": 0.25, "exclamation": 0.15}, "type_rank", order)


def length_band(n: str = "char_count") -> Column:
    return F.when(F.col(n) <= 20, "short").when(F.col(n) <= 50, "medium").otherwise("long")


def balance_lengths(df: DataFrame, order: str = "ord") -> DataFrame:
    return balanced_rank(df, length_band(), {"short": 0.25, "medium": 0.50, "long": 0.25}, "length_rank", order)


def select_best(df: DataFrame, k: int = 20_000, profile: Profile = BENGALI, mode: str = "score", order: str = "ord") -> DataFrame:
    """Length 3 to 200, score of 5 or more, then the k best.

    "score": ties by order; no iteration. "exact": ties as coverage, then type balance, then length
    balance leave them.
    """
    rows = filter_quality(score(filter_length(df, 3, 200), profile), 5.0)
    if mode == "score":
        return top(rows, k, order)
    rows = shared_table(rows.withColumn("_row", F.monotonically_increasing_id()))
    # what the ranks sort and write is narrow; the chosen rows meet their texts at the end
    ranked = coverage_rank(rows.select("_row", order, "phoneme_coverage", "char_count", "sentence_type", "quality_score"), 25, order).drop("phoneme_coverage")
    ranked = balance_lengths(balance_types(ranked, "coverage_rank"), "type_rank")
    best = top(ranked.select("_row", "quality_score", "length_rank"), k, "length_rank").select("_row", "length_rank")
    return rows.join(shared_table(best), "_row").orderBy(F.desc("quality_score"), F.asc("length_rank")).drop("_row", "length_rank")


def select_with_fallback(df: DataFrame, k: int = 20_000, profile: Profile = BENGALI, order: str = "ord") -> DataFrame:
    """``select_best``; if that has fewer than k rows, the k best of all with a score of 15 or more, of any length.

    Rows are scored once into a table, and counts decide.
    """
    rows = shared_table(score(df, profile))
    best, all_ = has_length(3, 200) & has_quality(5.0), has_quality(15.0)
    n = rows.agg(F.count_if(best), F.count_if(all_)).first()
    rule, held = (best, n[0]) if n[0] >= k else (all_, n[1])
    rows = rows.where(rule)
    return rows.orderBy(F.desc("quality_score"), F.asc(order)) if held <= k else top(rows, k, order)


def fill_templates(templates: DataFrame, words: DataFrame) -> DataFrame:
    """(text) of every template (template, slots array) with words (slot, word) in its slots, distinct.

    One equi-join on the slot name for each place, so only fitting words meet a template.
    """
    rows = templates.select("template", "slots").distinct()
    most = rows.agg(F.max(F.size("slots"))).first()[0] or 0
    rows = rows.withColumn("text", F.col("template"))
    for i in range(most):
        place = F.try_element_at("slots", F.lit(i + 1))
        got = rows.withColumn("slot", place).join(words.select("slot", "word").distinct(), "slot", "left")
        filled = F.when(F.col("slot").isNull(), F.col("text")).otherwise(F.replace("text", F.concat(F.lit("{"), "slot", F.lit("}")), F.col("word")))
        rows = got.where("slot is null or word is not null").select("template", "slots", filled.alias("text"))
    return rows.select("text").distinct()


def prompt_catalogue(spark: SparkSession, lists: dict[str, list[str]], carrier_words: int = 20, carriers: int = 3) -> DataFrame:
    """(prompt_id, type, text, status) in order: vowels, consonants, consonants by matras, conjuncts, words, sentences, words in carriers ("{}" is the place)."""
    names = ["vowel", "consonant", "matra", "conjunct", "word", "sentence", "carrier"]
    rows = [(k, i, t) for k in names for i, t in enumerate(lists.get(k, []))]
    base = spark.createDataFrame(rows, "type string, i int, text string")
    one = lambda k: base.where(F.col("type") == k).select("i", "text")
    pick = lambda df, rank, kind: df.select(F.lit(rank).alias("rank"), "i", F.lit(kind).alias("type"), "text")
    # catalogue lists, a few hundred entries each
    grid = one("consonant").alias("a").crossJoin(one("matra").alias("b")).select((F.col("a.i") * 10_000 + F.col("b.i")).alias("i"), F.concat("a.text", "b.text").alias("text"))
    carried = one("word").where(F.col("i") < carrier_words).alias("a").crossJoin(one("carrier").where(F.col("i") < carriers).alias("b"))
    carried = carried.select((F.col("a.i") * 10_000 + F.col("b.i")).alias("i"), F.replace("b.text", F.lit("{}"), F.col("a.text")).alias("text"))
    parts = [(one("vowel"), "vowel"), (one("consonant"), "consonant"), (grid, "consonant_matra"), (one("conjunct"), "conjunct"), (one("word"), "word"), (one("sentence"), "sentence"), (carried, "carrier")]
    out = None
    for rank, (df, kind) in enumerate(parts):
        part = pick(df, rank, kind)
        out = part if out is None else out.unionByName(part)
    number = F.row_number().over(W.orderBy("rank", "i"))
    return out.select(F.format_string("%05d", number).alias("prompt_id"), "type", "text", F.lit("pending").alias("status"))


def split_sets(df: DataFrame, key: str, train: float = 0.90, val: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: int(train*n) rows, int(val*n), the rest test, in an order by hash of the key.

    The two borders are order statistics of the hash, found from its distribution; no row is numbered.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    rows = df.withColumn("_h", h)
    n = rows.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    low, high = _kth(rows, key, a), _kth(rows, key, b)
    before = lambda m: F.lit(False) if m is None else F.struct("_h", F.col(key).cast("string").alias("k")) < F.struct(F.lit(m[0]).alias("_h"), F.lit(m[1]).alias("k"))
    rows = rows.withColumn("split", F.when(F.lit(a >= n) | before(low), "train").when(F.lit(b >= n) | before(high), "val").otherwise("test"))
    return rows.drop("_h")


def _kth(rows: DataFrame, key: str, k: int):
    """The (hash, key) at position k of the order, from counts by the hash's leading bits and one small bucket."""
    bucket = F.shiftright("_h", 44)
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = run.where(F.col("upto") > k).orderBy("b").first()
    if at is None:
        return None
    inside = rows.where(bucket == at.b).select("_h", F.col(key).cast("string").alias("k")).orderBy("_h", "k").limit(k - (at.upto - at.n) + 1)
    return tuple(inside.orderBy(F.desc("_h"), F.desc("k")).first())


def match_audio(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows with ``wav``, the stem of their audio file: the named one, else stem.wav, else stem_temp.webm; others go.

    ``files`` has (name). Rows without a filename or text go too.
    """
    rows = meta.where("coalesce(filename, '') <> '' AND coalesce(text, '') <> ''").withColumn("_stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    names = files.select("name").distinct()
    tried = [F.col("filename"), F.concat("_stem", F.lit(".wav")), F.concat("_stem", F.lit("_temp.webm"))]
    for i, t in enumerate(tried):
        rows = rows.withColumn(f"_t{i}", t).join(names.select(F.col("name").alias(f"_n{i}")), F.col(f"_t{i}") == F.col(f"_n{i}"), "left")
    found = F.coalesce("_n0", "_n1", "_n2")
    return rows.where(found.isNotNull()).withColumn("audio", found).withColumn("wav", F.regexp_replace(found, r"\.[^.]*$", "")).drop("_stem", *[f"_{a}{i}" for a in "tn" for i in range(3)])


def ljspeech(meta: DataFrame, files: DataFrame, phonemes=None) -> DataFrame:
    """(wav, text, phonemes) of matched rows; without a phoneme function the text stands for itself."""
    rows = match_audio(meta, files)
    return rows.select("wav", "text", (phonemes(F.col("text")) if phonemes else F.col("text")).alias("phonemes"))


def filelist(lines: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(value): folder/name.wav|text|phonemes of lines with two fields or more whose file exists."""
    parts = lines.withColumn("p", F.split("value", r"\|", -1)).where(F.size("p") >= 2)
    rows = parts.withColumn("name", F.concat(F.col("p")[0], F.lit(".wav"))).join(files.select("name").distinct(), "name", "left_semi")
    last = F.coalesce(F.try_element_at("p", F.lit(3)), F.col("p")[1])
    return rows.select(F.concat_ws("|", F.concat(F.lit(folder.rstrip("/") + "/"), "name"), F.col("p")[1], last).alias("value"))


def update_status(prompts: DataFrame, updates: DataFrame) -> DataFrame:
    """Prompts with the status of ``updates`` (prompt_id, status) where there is one; of several the last in name order."""
    new = updates.groupBy("prompt_id").agg(F.max("status").alias("_new"))
    return prompts.join(new, "prompt_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new").select(*prompts.columns)


def newest_recordings(prompts: DataFrame, files: DataFrame) -> DataFrame:
    """(prompt_id, path) of the newest file (name, path, time) of each prompt."""
    got = files.withColumn("prompt_id", T.prompt_of(F.col("name"))).groupBy("prompt_id").agg(F.max_by("path", "time").alias("path"))
    return prompts.join(got, "prompt_id", "left").select("prompt_id", "path")
