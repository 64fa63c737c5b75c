import random

from corpusmill.llm import decontam as d

ITEMS = [(0, "The quick brown fox jumps over the lazy dog and runs off into the dark old wood."), (1, "tiny"), (2, None), (3, "  "), (4, "Étude première: où l'on voit ce qui fut, et ce qui ne fut pas, dans la ville."), (5, "THE quick brown fox jumps over the lazy dog and runs off into the dark\nold wood.")]


def levenshtein_part(p, t):
    """Least edit distance of p to any part of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def brute(text, rate=d.RATE):
    t, out = d.normalize(text), {}
    for i, item in ITEMS:
        p = d.normalize(item)
        if p:
            k = int(rate * len(p))
            if k == 0:
                words = "".join(c if c.isalnum() else " " for c in t).split()
                if p in words:
                    out[i] = 0
            elif (n := levenshtein_part(p, t)) <= k:
                out[i] = n
    return out


def texts():
    rnd = random.Random(1)
    out = [None, "", "a tiny thing", "tinytiny", "the the " * 50, "x" * 20_000]
    for _ in range(60):
        t = list(rnd.choice([ITEMS[0][1], ITEMS[4][1]]))
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6])):
            i = rnd.randrange(len(t))
            rnd.choice([lambda: t.pop(i), lambda: t.insert(i, "q"), lambda: t.__setitem__(i, "zz"), lambda: t.__setitem__(i, t[i].upper())])()
        out.append(rnd.choice(["", "some words. ", "The quick brown "]) + "".join(t).replace(" ", rnd.choice([" ", "\n ", "  "])) + rnd.choice(["", " tiny", " end the quick brown fox"]))
    return out


def test_myers():
    rnd = random.Random(2)
    for _ in range(400):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (70, 90))
        assert d.least_distance(p, d.masks(p), t)[0] == levenshtein_part(p, t)


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hits string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.row.doc_id: {h.item_id: h.distance for h in r.hits} for r in d.match_items(docs, items).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(map(len, got.values())) > 40


def test_blocks_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(str, d.match_items(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 10)
    assert sorted(map(str, d.match_items(docs, items).collect())) == one
    assert all(r.hits == [] for r in d.match_items(docs, items.limit(0)).collect())
    assert d.match_items(docs.limit(0), items).collect() == []
