import random
import re

import numpy as np

from corpusmill.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rnd = random.Random(1)
    out = [None, "", " \n\t", "a", "a " * 8, "a " * 9, "x\x1cy\xa0z\x85 q", "w" * 100_000, "\n\nx\nx\n x\nx"]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "c d e f g h i j ", " ", "\n", "#", "%%", "é", "<", "\x0b", " ", "!!"]) for _ in range(rnd.randint(1, 80))))
    return out


def test_counts_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, s int")
    got = {r.row.doc_id: r for r in q.judge(df, q.RuleList()).collect()}
    for i, t in rows:
        want = brute(t)
        assert tuple(got[i].s)[:5] == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and got[i].kept != got[i].base_failed


def test_covering_finds_planted_rules(spark):
    rnd = np.random.default_rng(0)
    x = {"symbols_per_word": rnd.random(6000), "upper_share": rnd.random(6000), "repeated_share": rnd.random(6000)}
    y = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.6) & (x["repeated_share"] <= 0.3))
    rules = q.cover(x, y, rnd.random(6000) < 0.67)
    other = {f: rnd.random(4000) for f in x}
    truth = (other["symbols_per_word"] > 0.8) | ((other["upper_share"] > 0.6) & (other["repeated_share"] <= 0.3))
    said = np.zeros(4000, bool)
    for r in rules.rules:
        said |= r.mask(other)
    assert (said == truth).mean() > 0.97 and len(rules.rules) <= 6
    # the Spark expression is the list
    import pandas as pd
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pd.DataFrame(other)).select("*", rules.column({f: F.col(f) for f in other}).alias("fired")).toPandas()
    assert ((df["fired"] > 0).to_numpy() == said).all()


def test_noise_teaches_nothing():
    rnd = np.random.default_rng(1)
    assert q.cover({"a": rnd.random(2000)}, rnd.random(2000) < 0.2, rnd.random(2000) < 0.67).rules == []


def test_learning_and_held_out_precision(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = q.learn(docs, labels.where("doc_id % 2 = 0"))
    judged = q.judge(docs, rules).where("not base_failed").selectExpr("row.doc_id as doc_id", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    rejected = judged[~judged["kept"]]
    assert len(rejected) > 5 and (rejected["quality"] == 0).mean() > 0.85
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.97
    assert q.learn(docs, labels.limit(0)).rules == [] and q.learn(docs.limit(0), labels).rules == []
    assert q.judge(docs.limit(0), rules).collect() == []


def test_repeated_documents_are_bounded_too(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "cover", lambda x, y, *a: seen.append(len(y)) or q.RuleList())
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)], "doc_id long, text string")
    q.learn(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality long"), fit_rows=50)
    assert seen == [50]
