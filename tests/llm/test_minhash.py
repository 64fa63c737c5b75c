import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, minhash
from corpusmill.llm.components import components


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted(((d, len(shingles(t, k)), None if d is None else top(d), d is None or top(d) == d) for d, t in rows), key=str)


def sample(n=260, seed=1):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)] + ["é", "É", "a\xa0b", "x\x1fy"]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    rows = [(None, "a b c"), (None, None), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "z " * 60_000)]
    for d in rnd.sample(range(1, 4000), n):
        w = list(rnd.choice(base)) if rnd.random() < 0.9 else [rnd.choice(vocab) for _ in range(40)]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((d, rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows


def run(spark, rows, k, percent):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    return sorted(map(tuple, minhash.near_duplicates(df, k, percent).collect()), key=str)


def test_matches_brute_force(spark):
    rows = sample()
    for k, percent in ((3, 85), (5, 80)):
        assert run(spark, rows, k, percent) == brute(rows, k, percent)


@pytest.mark.parametrize("rounds", [0, 1])
def test_blocks_lose_no_link(spark, monkeypatch, rounds):
    rows = sample(150, 2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    assert run(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_blocks_of_one_component_never_meet(spark):
    rows = [("g", 1, i, 5) for i in range(40)] + [("g", c, 100 + c, 5) for c in range(2, 8)] + [("h", 9, 200 + i, 5) for i in range(30)] + [("k", 3, 300, 1), ("k", 4, 301, 1)]
    df = spark.createDataFrame(rows, "gid string, c long, cid long, w long")
    got = [tuple(r) for r in minhash.dealt(df, "gid", F.col("w"), 20).select("gid", "_i", "_j", "c", "cid").collect()]
    met, blocks = set(), {}
    for g, i, j, c, v in got:
        blocks.setdefault((g, i, j), []).append((c, v))
    for (g, i, j), members in blocks.items():
        assert len(members) < 30
        assert len({c for c, _ in members}) > 1 or len(members) < 8
        met |= {(g, x, y) for c, x in members for d, y in members if c != d}
    assert met == {(g, x, y) for g, c, x, _ in rows for h, d, y, _ in rows if g == h and c != d}
    assert not any(g == "h" for g, _, _ in blocks)


def test_empty(spark):
    assert run(spark, [], 3, 85) == []
    assert run(spark, [(2, "a b c d"), (1, "a b c d")], 3, 85) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_components_of_paths_and_stars(spark, tmp_path):
    keep = lambda df, n=iter(range(99)): common.write_table(df, f"{tmp_path}/{next(n)}")
    rnd = random.Random(3)
    chain = list(range(0, 300, 3))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1, x) for x in range(1, 200, 3)] + [(2, 5), (5, 2), (8, 8)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), keep).collect()))
    assert all(got[x] == 0 for x in chain) and all(got[x] == 1 for x in range(1, 200, 3)) and got[5] == got[2] == 2
