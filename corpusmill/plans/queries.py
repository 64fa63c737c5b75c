"""The registered queries over the core operators, and their DuckDB counterparts (in ``oracle``).

The driver tables stand in for the operators' inputs: lines of ``documents`` for sentences (Latin profile), ``events`` for
prompts, recordings and training runs, ``embeddings`` for waveforms, ``conversations`` for spoken words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import g2p, numbers
from ..functions import text as T
from ..functions.profiles import BENGALI, LATIN
from ..operators import alignment, audio, corpus, stats, training
from ..sources import readers
from . import oracle

QUERIES: dict = {}
ORACLE = oracle.ORACLE


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _plain(c):
    return c


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.lines_of(_table(spark, d, "documents"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    """Normalized lines with ``ord`` = (doc_id, pos)."""
    # one element or none, so that the filter doesn't repeat the whole chain
    kept = F.filter(F.array(T.normalize_sentence(F.col("text"), LATIN, _plain)), lambda x: x != "")
    return _lines(spark, d).withColumn("text", F.explode(kept)).withColumn("ord", F.struct("doc_id", "pos"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Normalized lines, analyzed."""
    return corpus.analyze(_normalized(spark, d), LATIN)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return corpus.score(_sentences(spark, d), LATIN)


def _ranked_by(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Scored lines with only what a rank needs, as ranks write what they sort."""
    return _scored(spark, d).select("doc_id", "pos", "ord", "quality_score", *columns)


@query
def curate_lines(spark, d):
    """Lines, normalize, dedup, score, the 500 best."""
    best = corpus.top(corpus.score(corpus.analyze(corpus.deduplicate(_normalized(spark, d)), LATIN), LATIN), 500)
    return best.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "quality_score")


@query
def normalize_lines(spark, d):
    return _lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalize_sentence(F.col("text"), LATIN, _plain).alias("text"))


@query
def text_projections(spark, d):
    """Per line: key, words, type, script share, validity, text without Latin words, comparison form, cleaned or null."""
    t = F.col("text")
    return _lines(spark, d).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), T.dedup_key(t).alias("dedup_key"), T.word_count(t).cast("long").alias("words"), T.sentence_type(t).alias("kind"),
        F.round(T.script_share(t, LATIN), 6).alias("share"), T.is_valid(t, LATIN).alias("valid"), T.remove_latin(t).alias("rest"), T.compare_form(t, _plain).alias("form"),
        T.clean_or_null(t, 2, 500, LATIN).alias("clean"), T.collapse_marks(t).alias("marks"),
    )


@query
def digit_values(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", T.digits_to_int(F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"))).cast("long").alias("value"))


@query
def recording_names(spark, d):
    o = _table(spark, d, "orders")
    name = T.recording_name(F.concat(F.lit("sp"), "o_custkey"), F.col("o_orderdate"), F.format_string("%05d", "o_orderkey"))
    return o.select("o_orderkey", name.alias("name"), T.prompt_of(name).alias("prompt_id"), T.is_safe_name(name).alias("safe"), T.is_within(F.concat(F.lit("/data/rec/"), name), "/data/rec").alias("inside"))


@query
def dedup_documents(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("ord"))
    return corpus.deduplicate(rows).select("doc_id", T.dedup_key(F.col("text")).alias("dedup_key"))


@query
def analyze_lines(spark, d):
    return _sentences(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"), F.size("phoneme_coverage").cast("long").alias("units"), F.size("has_conjuncts").cast("long").alias("conjuncts"), "sentence_type")


@query
def quality_scores(spark, d):
    return _scored(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "quality_score")


@query
def filtered_counts(spark, d):
    n = _scored(spark, d).agg(F.count_if(corpus.has_length()).alias("length"), F.count_if(corpus.has_quality(60.0)).alias("quality"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in ("length", "quality")])).alias("r")).select("r.*")


@query
def corpus_overview(spark, d):
    o = stats.overview(_sentences(spark, d))
    return o.select("total_sentences", "total_characters", "total_words", F.round("avg_sentence_length", 6).alias("avg_sentence_length"), F.round("estimated_hours", 6).alias("estimated_hours"))


@query
def unit_counts(spark, d):
    return stats.unit_counts(_sentences(spark, d))


@query
def conjunct_counts(spark, d):
    return stats.conjunct_counts(_sentences(spark, d))


@query
def top_conjuncts(spark, d):
    return stats.top_conjuncts(_sentences(spark, d), 20)


@query
def type_shares(spark, d):
    return stats.type_shares(_sentences(spark, d)).withColumn("percent", F.round("percent", 6))


@query
def length_histogram(spark, d):
    return stats.length_histogram(_sentences(spark, d))


@query
def category_coverage(spark, d):
    return stats.category_coverage(_sentences(spark, d), LATIN).withColumn("percent", F.round("percent", 6))


@query
def missing_units(spark, d):
    """Inventory units that no line holds."""
    return stats.missing_units(_sentences(spark, d), LATIN)


@query
def balance_types(spark, d):
    return corpus.balance_types(_ranked_by(spark, d, "sentence_type")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("type_rank").cast("long").alias("type_rank"))


@query
def balance_lengths(spark, d):
    return corpus.balance_lengths(_ranked_by(spark, d, "char_count")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("length_rank").cast("long").alias("length_rank"))


@query
def select_best(spark, d):
    return corpus.select_best(_sentences(spark, d), 2000, LATIN).select("doc_id", F.col("pos").cast("long").alias("pos"), "quality_score")


@query
def select_fallback(spark, d):
    return corpus.select_with_fallback(_sentences(spark, d), 10_000_000, LATIN).agg(F.count("*").alias("n"), F.sum("quality_score").alias("total"))


@query
def coverage_order(spark, d):
    rows = corpus.filter_length(_ranked_by(spark, d, "char_count", "phoneme_coverage"), 3, 200)
    return corpus.coverage_rank(rows, 25).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("coverage_rank").cast("long").alias("coverage_rank"))


@query
def select_exact(spark, d):
    return corpus.select_best(_sentences(spark, d), 2000, LATIN, mode="exact").select("doc_id", F.col("pos").cast("long").alias("pos"), "quality_score")


@query
def split_sizes(spark, d):
    return corpus.split_sets(_table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query
def fill_templates(spark, d):
    """Two-slot templates over nations and regions."""
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    words = nation.select(F.lit("place").alias("slot"), F.col("n_name").alias("word")).unionByName(region.select(F.lit("part").alias("slot"), F.col("r_name").alias("word")))
    forms = spark.createDataFrame([("{place} lies in {part}.", ["place", "part"]), ("Where is {place}?", ["place"]), ("All of it.", [])], "template string, slots array<string>")
    return corpus.fill_templates(forms, words)


@query
def prompt_catalogue(spark, d):
    u = BENGALI.units
    return corpus.prompt_catalogue(spark, {"vowel": u["vowel"], "consonant": u["consonant"], "matra": u["matra"], "conjunct": u["conjunct"], "word": ["আমি", "তুমি"], "sentence": ["আমি যাই।"], "carrier": ["বলো {} এখন", "{} লেখো"]})


@query
def prompt_type_counts(spark, d):
    return stats.prompt_counts(prompt_catalogue(spark, d))


def _prompts(spark, d) -> DataFrame:
    e = _table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "retry").otherwise("pending")
    return e.select(F.col("event_id").alias("idx"), F.format_string("%07d", "event_id").alias("prompt_id"), status.alias("status"))


@query
def recording_stats(spark, d):
    return stats.recording_stats(_prompts(spark, d), _table(spark, d, "events").where("event_type = 'purchase'").select(F.floor("value").cast("double").alias("duration")))


@query
def navigate_prompts(spark, d):
    p = _prompts(spark, d)
    out = None
    for action, current, target in (("next", 10, 0), ("prev", 0, 0), ("goto", 3, 10**9), ("next_pending", 41, 0), ("next_pending", 10**8, 0), ("stay", 7, 0)):
        one = training.navigate(p, action, current, target).select(F.lit(f"{action} {current}").alias("move"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def status_update(spark, d):
    done = _prompts(spark, d).where("idx % 7 = 0").select("prompt_id", F.lit("done").alias("status"))
    return corpus.update_status(_prompts(spark, d), done)


@query
def newest_recordings(spark, d):
    e = _table(spark, d, "events")
    files = e.select(F.concat(F.lit("sp_20240101T000000Z_"), "user_id", F.lit(".wav")).alias("name"), F.concat(F.lit("/r/"), "event_id").alias("path"), F.struct("ts", "event_id").alias("time"))
    prompts = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("prompt_id"))
    return corpus.newest_recordings(prompts, files)


def _meta(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".wav")).alias("filename"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("text "), "doc_id")).otherwise("").alias("text"))


def _files(spark, d) -> DataFrame:
    l = _table(spark, d, "labels")
    return l.select(F.concat("doc_id", F.when(F.col("quality") == 1, ".wav").otherwise("_temp.webm")).alias("name"), F.col("doc_id").cast("double").alias("duration"))


@query
def match_audio(spark, d):
    return corpus.match_audio(_meta(spark, d), _files(spark, d)).select("doc_id", "audio", "wav")


@query
def ljspeech_filelist(spark, d):
    lines = corpus.ljspeech(_meta(spark, d), _files(spark, d)).select(F.concat_ws("|", "wav", "text", "phonemes").alias("value"))
    return corpus.filelist(lines, _files(spark, d), "/data/wav/")


@query
def recording_metadata(spark, d):
    """Two overlapping sources that together hold every event."""
    e = _table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 5 > 0, F.floor("value")).alias("v"))
    return readers.recording_metadata(e.where("user_id % 2 = 0"), e.where("NOT user_id % 2 <=> 0 OR user_id % 3 = 0")).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def validate_entries(spark, d):
    got = audio.validate_entries(_meta(spark, d), _files(spark, d), _plain)
    return got.select("doc_id", "valid", F.size("issues").cast("long").alias("n_issues"), "actual_duration")


def _signals(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("samples"), F.lit(1000).alias("sample_rate"))


@query
def signal_metrics(spark, d):
    m = audio.metrics(_signals(spark, d))
    return m.select("vec_id", *[F.round(c, 6).alias(c) for c in ("duration", "peak", "rms_db", "snr_db", "silent_share")])


@query
def audio_verdicts(spark, d):
    """Four signals in a row make one of 0.256 s at 1 kHz, so shorter limits are reached at 100 Hz."""
    m = audio.verdicts(audio.metrics(_signals(spark, d).withColumn("sample_rate", F.lit(100))))
    valid = lambda k: F.col("checks")[k]["valid"].alias(k)
    return m.select("vec_id", *[valid(k) for k in ("duration", "clipping", "rms", "snr", "silence_only")], F.size("issues").cast("long").alias("n_issues"), "passed")


@query
def live_verdicts(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 100_000)).alias("samples"), (F.col("vec_id") % 40).cast("double").alias("duration"))
    return audio.live_verdict(e).select("vec_id", F.size("issues").cast("long").alias("n_issues"), F.col("quality_score").cast("long").alias("quality_score"), "passed")


@query
def rejected_audio(spark, d):
    m = audio.verdicts(audio.metrics(_signals(spark, d).withColumn("sample_rate", F.lit(100)))).withColumn("path", F.format_string("%06d", "vec_id"))
    return audio.rejected_summary(m)[0]


@query
def duplicate_texts(spark, d):
    got = audio.duplicate_files(_table(spark, d, "documents").select(F.format_string("%09d", "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    return got.select("hash", "n", F.element_at("paths", 1).alias("first_path"), F.element_at("paths", -1).alias("last_path"))


@query
def augmentation_plan(spark, d):
    files = _table(spark, d, "part").select(F.concat(F.lit("/in/"), "p_partkey", F.when(F.col("p_size") > 25, ".WAV").otherwise(".mp3")).alias("path"))
    return audio.augmentation_plan(files)


@query
def augmentation_stats(spark, d):
    return audio.augmentation_stats(augmentation_plan(spark, d))


@query
def processing_plan(spark, d):
    files = _table(spark, d, "part").select(F.concat(F.lit("/in/p."), "p_partkey", F.lit(".webm")).alias("path"))
    return audio.processing_plan(files, "/out", 22_050, normalize=False).select("input", "output", F.array_join("steps", ">").alias("steps"), F.col("arguments")["sample_rate"].alias("sample_rate"))


@query
def volume_change(spark, d):
    return _signals(spark, d).select("vec_id", F.round(audio.rms_db(audio.change_volume(F.col("samples"), 0.5)), 6).alias("rms_db"))


@query
def diagonal_scores(spark, d):
    """Each vector as an 8 by 8 attention matrix of absolute values."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("samples", i * 8 + 1, F.lit(8)), lambda v: F.abs(v)))
    return _signals(spark, d).select("vec_id", F.round(training.diagonal_score(m), 6).alias("score"))


def _runs(spark, d) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("step"), "value", (F.floor(F.col("value")) % 100 / 100).alias("score"), F.concat(F.lit("ck_"), "event_id").alias("path"))


@query
def lr_schedule(spark, d):
    s = F.col("event_id")
    return _table(spark, d, "events").select("event_id", F.round(training.lr_factor(s, 1000, 8000, 0.05), 9).alias("factor"), training.may_augment(s, F.lit(10_000)).alias("augment"))


@query
def early_stopping(spark, d):
    return training.early_stopping(_runs(spark, d), ["run"], ["ts", "step"], "value", 10, 0.001)


@query
def alignment_collapse(spark, d):
    got = training.collapse(_runs(spark, d), ["run"], ["ts", "step"], "score")
    return got.select("run", "step", F.round("recent_avg", 6).alias("recent_avg"), F.round("older_avg", 6).alias("older_avg"), "collapsed")


@query
def checkpoints_kept(spark, d):
    return training.retained(_runs(spark, d), ["run"], ["ts", "step"]).select("run", "step")


@query
def latest_checkpoints(spark, d):
    return training.latest(_runs(spark, d), ["run"], ["ts", "step"])


@query
def rollback_choice(spark, d):
    return training.rollback(_runs(spark, d), ["run"], ["ts", "step"], "score", F.lit(0.35))


@query
def best_so_far(spark, d):
    return training.best_so_far(_runs(spark, d), ["run"], ["ts", "step"], "value").select("run", "step", "is_best")


@query
def stop_decisions(spark, d):
    runs = _runs(spark, d)
    last = runs.groupBy("run").agg(F.max_by("score", F.struct("ts", "step")).alias("score"))
    return training.should_stop(training.early_stopping(runs, ["run"], ["ts", "step"], "value"), last, ["run"], "score")


@query
def collapse_actions(spark, d):
    runs = _runs(spark, d)
    c = training.collapse(runs, ["run"], ["ts", "step"], "score").groupBy("run").agg(F.max_by("collapsed", F.struct("ts", "step")).alias("collapsed"))
    return training.on_collapse(c, training.rollback(runs, ["run"], ["ts", "step"], "score", F.lit(0.35)), ["run"])


@query
def mean_values(spark, d):
    return _runs(spark, d).agg(F.round(training.mean_or_zero("value"), 6).alias("mean"))


@query
def word_similarity(spark, d):
    p = _table(spark, d, "part")
    a, b = F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1])
    return p.select("p_partkey", F.round(alignment.word_similarity(a, b, lambda c: T.compare_form(c, _plain)), 6).alias("similarity"), F.round(alignment.char_overlap(a, b), 6).alias("overlap"))


@query
def align_turns(spark, d):
    """Each turn's words against the next turn's."""
    c = _table(spark, d, "conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    r = alignment.align_arrow(T.words(F.coalesce("a.text", F.lit(""))), T.words(F.coalesce("b.text", F.lit(""))))
    got = pairs.select("a.conv_id", "a.turn", r.alias("r"))
    count = lambda s: F.size(F.filter("r", lambda x: x["status"] == s)).cast("long").alias(s)
    return got.select("conv_id", "turn", count("correct"), count("warning"), count("error"), alignment.overall(F.col("r")).alias("score"))


@query
def number_words(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", numbers.number_words(F.col("o_orderkey") * 7919).alias("words"))


BN_TEXTS = [
    "আমার বয়স ২৫", "৳৫০০ টাকা", "২৫/১২/২০২৩", "01712345678", "৳5.50", "3.14", "12345678", "Hello", "1,000", "2024-13-01", "বাংলাদেশ আমার দেশ", "ক্ষমা জ্ঞান চাঁদ",
]


@query
def spoken_bengali(spark, d):
    rows = spark.createDataFrame(list(enumerate(BN_TEXTS)), "id int, text string")
    return rows.select("id", numbers.spoken(F.col("text")).alias("spoken"), g2p.phonemes_of_raw(F.col("text")).alias("phonemes"))


@query
def phonemes_native(spark, d):
    """Phonemes of normalized texts by JVM expressions alone."""
    rows = spark.createDataFrame([(i, numbers.spoken_text(t)) for i, t in enumerate(BN_TEXTS)], "id int, text string")
    return rows.select("id", g2p.phonemes(F.col("text")).alias("phonemes"))


@query
def phoneme_inventory(spark, d):
    return g2p.inventory(spark).groupBy("category").agg(F.count("*").alias("phonemes"))
