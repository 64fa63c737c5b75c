import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.profiles import BENGALI, LATIN
from corpusmill.operators import alignment, audio, corpus, stats, training
from corpusmill.plans.queries import QUERIES

BN = "আমি যাই।|তুমি কি যাও?|বাহ!|মন্ত্র পড়ি।|আমি  যাই।|ক|" + "ক্ত " * 30


def sentences(spark, texts=None):
    rows = [(i, t) for i, t in enumerate(texts or BN.split("|"))]
    return corpus.score(corpus.analyze(spark.createDataFrame(rows, "ord long, text string"), BENGALI))


def greedy(rows, target):
    """rows: (ord, units, score) in list order; the picked order."""
    have, left, out = {}, list(rows), []
    while left:
        best = max(left, key=lambda r: (sum(have.get(u, 0) < target for u in r[1]), -r[0]))
        if not any(have.get(u, 0) < target for u in best[1]):
            break
        left.remove(best)
        out.append(best[0])
        for u in best[1]:
            have[u] = have.get(u, 0) + 1
    return out + [r[0] for r in sorted(left, key=lambda r: (-r[2], r[0]))]


def test_scores_stay_in_range(spark):
    s = [r.quality_score for r in sentences(spark).collect()]
    assert all(10 <= x <= 100 for x in s)
    (one,) = sentences(spark, ["আমি যাই কি?"]).collect()
    assert one.quality_score == 20 + min(1.5 * len(one.phoneme_coverage), 30) + 10 + 5 + 10


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    once = corpus.deduplicate(sentences(spark))
    assert sorted(r.ord for r in once.collect()) == [0, 1, 2, 3, 5, 6]
    assert once.count() == corpus.deduplicate(once).count()


@pytest.mark.parametrize("target", [1, 2, 10])
def test_coverage_rank_is_the_greedy_order(spark, target):
    rnd = random.Random(target)
    texts = ["".join(rnd.choice("কখগঘঙচছজআইউ ") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    df = sentences(spark, texts)
    rows = [(r.ord, r.phoneme_coverage, r.quality_score) for r in df.collect()]
    for pool in (5000, 7):
        got = [r.ord for r in corpus.coverage_rank(df, target, pool=pool).orderBy("coverage_rank").collect()]
        assert got == greedy(sorted(rows), target)


def test_balances_are_permutations(spark):
    df = sentences(spark)
    for f, name in ((corpus.balance_types, "type_rank"), (corpus.balance_lengths, "length_rank")):
        assert sorted(r[name] for r in f(df).collect()) == list(range(1, df.count() + 1))
    exact, plain = (sorted(r.quality_score for r in corpus.select_best(df, 4, mode=m).collect()) for m in ("exact", "score"))
    assert exact == plain
    assert corpus.select_with_fallback(df, 3).count() == 3
    assert corpus.balance_types(df.limit(0)).count() == corpus.select_best(df.limit(0), 3, mode="exact").count() == 0


def test_scores_are_computed_once(spark):
    df = corpus.filter_quality(corpus.score(corpus.analyze(spark.createDataFrame([(0, "ক")], "ord long, text string").repartition(1))), 5.0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Filter (quality_score#") and plan.count("Filter") == 1
    counts = QUERIES["filtered_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count("Relation [") == 1


def test_balance_sorts_once_and_takes_turns(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["statement"] * 3 + ["question", "exclamation"]), float(rnd.choice([10, 10.5, 30]))) for i in range(200)]
    calls = []
    rank = corpus.global_rank
    monkeypatch.setattr(corpus, "global_rank", lambda *a: calls.append(1) or rank(*a))
    got = corpus.balance_types(spark.createDataFrame(rows, "ord long, sentence_type string, quality_score double").repartition(5))
    kinds, first, late = {"statement": 0.6, "question": 0.25, "exclamation": 0.15}, [], []
    for k, share in kinds.items():
        group = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))
        first += group[: int(len(rows) * share)]
        late += group[int(len(rows) * share) :]
    want = first + sorted(late, key=lambda r: -r[2])
    assert late and {r.ord: r.type_rank for r in got.collect()} == {r[0]: i for i, r in enumerate(want, 1)}
    assert len(calls) == 1


def test_equal_gains_are_picked_in_one_fetch(spark, monkeypatch):
    df = sentences(spark, ["কখ"] * 40)
    calls, mark = [], F.broadcast
    monkeypatch.setattr(corpus.F, "broadcast", lambda d: calls.append(1) or mark(d))
    got = [r.ord for r in corpus.coverage_rank(df, 10, pool=5).orderBy("coverage_rank").collect()]
    assert got == list(range(40)) and len(calls) <= 4  # one for each fetch of five but the first, one for the ranks


def test_exact_selection_ranks_without_texts(spark, monkeypatch):
    seen, rank = [], corpus.global_rank
    monkeypatch.setattr(corpus, "global_rank", lambda df, *a: seen.append(set(df.columns)) or rank(df, *a))
    assert corpus.select_best(sentences(spark).drop("quality_score"), 3, mode="exact").count() == 3
    assert len(seen) == 3 and not any("text" in x for x in seen)


def test_large_selections_meet_in_no_task(spark, monkeypatch):
    df = sentences(spark)
    best = [r.ord for r in corpus.top(df, 4).collect()]
    monkeypatch.setattr(corpus, "HELD", 2, raising=False)
    for got in (corpus.top(df, 4), corpus.select_with_fallback(df, 10_000_000)):
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ord for r in corpus.top(df, 4).collect()] == best


@pytest.mark.parametrize("n", [0, 1, 7, 19, 20, 137])
def test_split_sizes(spark, n):
    rows = corpus.split_sets(spark.range(n), "id").groupBy("split").count().collect()
    got = {r[0]: r[1] for r in rows}
    a, b = int(n * 0.9), int(n * 0.05)
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == (a, b, n - a - b)


def test_audio_matching(spark):
    meta = spark.createDataFrame([("a.wav", "t"), ("b.flac", "t"), ("c.wav", "t"), ("d.wav", ""), (None, "t"), ("e.wav", "t")], "filename string, text string")
    files = spark.createDataFrame([("a.wav",), ("b.wav",), ("c_temp.webm",), ("d.wav",), ("a.wav",)], "name string")
    assert sorted((r.filename, r.audio) for r in corpus.match_audio(meta, files).collect()) == [("a.wav", "a.wav"), ("b.flac", "b.wav"), ("c.wav", "c_temp.webm")]


def test_statistics_of_nothing(spark):
    df = sentences(spark).limit(0)
    assert tuple(stats.overview(df).first()) == (0, 0, 0, 0.0, 0.0)
    assert [r.sentences for r in stats.length_histogram(df).collect()] == [0] * 6
    assert stats.missing_units(df).count() == 116
    assert stats.report(sentences(spark))["report"].count() > 10


def test_missing_units_looks_at_every_line(spark, tmp_path):
    texts = ["Ab cd.\nThe quick brown fox jumps over the lazy dog, which is longer than six letters.", "nation", None, "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.unit for r in QUERIES["missing_units"](spark, str(tmp_path)).collect())
    assert got == sorted(u for u in LATIN.labelled() if not any(u.split(":")[1] in (t or "") for t in texts)) and got
    docs = [t or "" for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = sorted(r.unit for r in QUERIES["missing_units"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(u for u in LATIN.labelled() if not any(u.split(":")[1] in t for t in docs))


def test_recording_metadata_holds_every_event(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "value").collect()
    rows = [(u, e, math.floor(v) if i % 5 else None) for u, e, i, v in rows]
    want = Counter(u for u, _, _ in rows if u % 2 == 0) + Counter(u for u, _, _ in {r for r in rows if r[0] % 2})
    assert {r.user_id: r.n for r in QUERIES["recording_metadata"](spark, d).collect()} == want
    assert set(want) == {u for u, _, _ in rows}


def tone(n, rate, amp, freq=100):
    return [amp * math.sin(2 * math.pi * freq * i / rate) for i in range(n)]


def test_signal_metrics(spark):
    rate = 1000
    rows = [(0, [0.0] * 600, rate), (1, tone(1000, rate, 0.5), rate), (2, [0.0] * 400 + tone(600, rate, 0.3), rate), (3, [1.0] * 700, rate), (4, [], rate), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, samples array<double>, sample_rate int")
    m = {r.id: r for r in audio.verdicts(audio.metrics(df)).collect()}
    assert m[0].rms_db == -100 and m[0].silent_share == 1 and m[0].snr_db is None and "Recording is mostly silence" in m[0].issues
    assert m[1].rms_db == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=1e-6) and m[1].peak <= 0.5
    assert m[2].silent_share == pytest.approx(0.401, abs=2e-3)
    assert not m[3].checks["clipping"].valid and not m[3].passed
    assert m[4].rms_db is None and m[5].passed is None and m[5].issues == ["File does not exist"]
    x = [v * v for v in rows[2][1]]
    levels = sorted(20 * math.log10(math.sqrt(s / 25)) for i in range(0, 1000 - 25, 10) if (s := sum(x[i : i + 25])) > 0)
    q = lambda p: (lambda a: levels[int(a)] + (levels[min(int(a) + 1, len(levels) - 1)] - levels[int(a)]) * (a - int(a)))((len(levels) - 1) * p)
    assert m[2].snr_db == pytest.approx(q(0.9) - q(0.1), abs=1e-6)


def test_alignment(spark):
    cases = [("a b c", "a b c", 100), ("alpha beta", "", 0), ("alpha beta gamma", "alpha gamma", 66), ("hello world", "hxllo world", 100), ("one two", "x x x x x two", 0), ("- ! word", "word", 100), ("", "x", 0), ("kitten", "sitten", 50)]
    df = spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b, _) in enumerate(cases)], "i int, e array<string>, s array<string>")
    got = df.orderBy("i").select(alignment.align(F.col("e"), F.col("s")).alias("a"), alignment.align_arrow(F.col("e"), F.col("s")).alias("b"))
    rows = got.select("a", "b", alignment.overall(F.col("a")).alias("o")).collect()
    for (e, s, want), r in zip(cases, rows):
        assert r.a == r.b, (e, s)
        if s != "hxllo world" and e != "kitten":
            assert r.o == want, (e, s)


def test_alignment_holds_few_rows_as_objects(spark):
    words = [[f"word{i}x{j}" for j in range(60)] for i in range(600)]
    a = pa.array(words)
    tracemalloc.start()
    got = alignment._align_batch(a, a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 600 and {w["status"] for w in got[599].as_py()} == {"correct"}
    assert peak < 5 << 20  # all rows as objects take far more
    rows = spark.createDataFrame([(1, ["a"] * 3), (2, None)], "i int, w array<string>").select("i", alignment.align_arrow(F.col("w"), F.col("w")).alias("r")).orderBy("i").collect()
    assert len(rows[0].r) == 3 and rows[1].r is None
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= alignment.BATCH_BYTES


def test_early_stopping_fold(spark):
    rnd = random.Random(0)
    series = {k: [rnd.choice([1.0, 0.9995, 0.5, 0.4999, 0.2]) for _ in range(rnd.randint(1, 40))] for k in range(20)}
    df = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in enumerate(s)], "run int, step int, v double")
    for r in training.early_stopping(df, ["run"], ["step"], "v", patience=5).collect():
        best, n, at = math.inf, 0, None
        for i, v in enumerate(series[r.run], 1):
            if v < best - 0.001:
                best, n = v, 0
            else:
                n += 1
                at = at or (i if n >= 5 else None)
        assert (r.best_value, r.counter, r.stopped, r.stopped_at) == (best, n, at is not None, at)


def test_collapse_needs_twenty_points(spark):
    for n in (9, 10, 19, 20):
        rows = [(0, i, 0.9 if i < n - 10 else 0.5) for i in range(n)]
        last = training.collapse(spark.createDataFrame(rows, "run int, step int, s double"), ["run"], ["step"], "s").orderBy("step").collect()[-1]
        assert last.collapsed == (n == 20)


def test_mean_values_are_of_all_events(spark):
    d = "/root/testdata/sf0.001"
    values = [v for (v,) in spark.read.parquet(f"{d}/events.parquet").select("value").collect()]
    assert [r["mean"] for r in QUERIES["mean_values"](spark, d).collect()] == [pytest.approx(math.fsum(values) / len(values), abs=1e-6)]
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert [x.agg(training.mean_or_zero("v")).first()[0] for x in (df, df.limit(0))] == [2.5, 0.0]


def test_learning_rate_rises_again(spark):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (0, 5, 10, 60, 110, 160)], "s int").select(training.lr_factor(F.col("s"), 10, 110)).collect()]
    assert got[:3] == [0.0, 0.5, 1.0] and got[3] == pytest.approx(0.5) and got[4] == pytest.approx(0.0) and got[5] == pytest.approx(0.5)


def test_navigation(spark):
    p = spark.createDataFrame([(i, f"{i:05d}", "pending" if i in (1, 4) else "done") for i in range(6)], "idx int, prompt_id string, status string")
    go = lambda *a: training.navigate(p, *a).first()
    assert go("next", 5)["index"] == 5 and go("prev", 0)["index"] == 0 and go("goto", 0, 99)["index"] == 5
    assert go("next_pending", 1)["index"] == 4 and go("next_pending", 4)["index"] == 1 and go("next_pending", 5).previous == "00000"
    assert training.navigate(p.limit(0), "next", 0).count() == 0
