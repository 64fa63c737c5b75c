import random

from corpusmill.llm import line_dedup
from corpusmill.llm.line_dedup import Cuckoo, LineIndex, dedup_lines

LONG = "This line is Long enough to be counted as a key %d"


def brute(rows, min_docs=5):
    holders = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    low = -(2**63)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(low if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(h := holders[key(x)]) < min_docs or max(h) == (low if d is None else d)]
        out.append((d, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def sample(n=200):
    rnd = random.Random(5)
    rows = [(None, LONG % 1), (7, None), (8, ""), (9, "\n\n"), (10, "x" * 200_000), (11, LONG % 1), (11, LONG % 1)]
    for d in range(20, 20 + n):
        lines = [rnd.choice([LONG % rnd.randint(0, 15), "  " + (LONG % 1).upper() + "\t\r", "short", "", "É" * 39, "é" * 40, "  " + LONG % 2]) for _ in range(rnd.randint(1, 9))]
        rows.append((d, "\n".join(lines)))
    return rows


def got(df):
    return sorted(((r.row.doc_id, r.row.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, 1, 2, "k", 3, None) for d, t in rows], "doc_id long, text string, lost int, row int, key string, n_lines long, cut string")
    out = dedup_lines(df)
    assert got(out) == brute(rows)
    assert out.schema["row"].dataType.names == df.columns
    assert dedup_lines(df.limit(0)).collect() == []


def test_counts_come_through_the_filters(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    build = LineIndex._build
    monkeypatch.setattr(LineIndex, "_build", lambda self, counts: build(self, counts.limit(0)))  # filters are left empty
    assert got(dedup_lines(df)) != brute(rows)


def test_shards_grow_with_the_index(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        frame = lambda lo, hi: spark.createDataFrame([(i, LONG % i + "\n" + LONG % 0) for i in range(lo, hi)], "doc_id long, text string")
        index = LineIndex(spark).insert(frame(0, 8))
        more = index.insert(frame(8, 60))
        assert index.shards < more.shards == LineIndex(spark, more.path).shards and more.shards * 4 >= 60
        assert more._ask(more.table("counts")).where("not known").count() == 0
        last = {r.row.doc_id: r.n_dropped for r in more.drop_lines(frame(0, 60)).collect()}
        assert last == {i: int(1 <= i < 59) or (i == 0) * 2 for i in range(60)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_insert_and_delete_are_reversible(spark):
    rows = [r for r in sample(150) if r[0] != 11]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    a, b = rows[:90], rows[90:]
    first = LineIndex(spark).insert(frame(a))
    both = first.insert(frame(b))
    whole = LineIndex(spark).insert(frame(rows))
    same = lambda x, y: [sorted(map(tuple, i.table(t).collect()), key=str) for i in (x, y) for t in ("refs", "counts")]
    one = same(both, whole)
    assert one[:2] == one[2:]
    assert got(both.drop_lines(frame(rows))) == brute(rows)
    back = both.delete(frame(b))
    two = same(back, first)
    assert two[:2] == two[2:]
    # every key of every version is known to its filter
    for index in (first, both, back):
        assert index._ask(index.table("counts")).where("not known").count() == 0
    again = both.insert(frame([(d, "new") for d, _ in b]))
    assert again.table("counts").count() == first.table("counts").count()


def test_cuckoo():
    rnd = random.Random(1)
    keys = [rnd.randbytes(32) for _ in range(5000)]
    f = Cuckoo(5000)
    f.insert(keys[:2500])
    f.insert(keys[2500:])
    f = Cuckoo.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains([rnd.randbytes(32) for _ in range(20000)]).mean() < 0.002
    same = [keys[0][:10] + bytes([i]) * 22 for i in range(20)]
    g = Cuckoo(200)
    g.insert(same)
    assert g.over and g.contains(same).all()
    g.delete(same)
    assert not g.contains(same).any() and not g.over and g.n == 0
    f.delete(keys[:4000])
    assert f.contains(keys[4000:]).all() and f.contains(keys[:4000]).mean() < 0.02
