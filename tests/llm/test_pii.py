import hashlib
import itertools
import random
import re

import numpy as np

from corpusmill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_patterns_match_brute_force():
    rnd = random.Random(0)
    bits = ["a", "b.c", "@", "@x.org", ".", "-", "_", "1", "255", "256", "10.", "+", "+1 (", ") ", " ", "4111111111111111", "4111 1111-1111 1111", "é", "٣", "\n", "00", "x@y.z@w.v"]
    for _ in range(6000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "@" * 100_000, "1 " * 100_000):
        pii.base_spans(t)


def test_decoding_is_exact():
    f, rnd = pii.trained(), random.Random(1)
    words = [w for s, _ in pii.parse(pii.LABELLED) for w in s]
    texts = [[rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 40]))] for _ in range(300)]
    got = [[0] * len(t) for t in texts]
    for t, i, x in f.decode(texts):
        got[t][i] = x
    k = len(pii.LABELS)
    for t, labels in zip(texts, got):
        if not t:
            continue
        ids = [0, *f.numbers(t), 0]
        e = np.array([f.rows[ids[i]][0] + f.rows[ids[i - 1]][1] + f.rows[ids[i + 1]][2] for i in range(1, len(ids) - 1)])
        score, back = f.t[k, :k] + e[0], []
        for x in e[1:]:
            c = score[:, None] + f.t[:k, :k]
            back.append(c.argmax(0))
            score = c.max(0) + x
        path = [int((score + f.t[:k, k]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert labels == path[::-1]


HELD_OUT = [
    ("you can send it to [email maria.k@post.example.net] or call", 1),
    ("her line is [phone +1 (212) 555-0143] and his [phone (646) 555-0199]", 2),
    ("charged to [card 6011000990139424] on friday", 1),
    ("the old card [card 1234567890123456] is void", 1),
    ("pings from [ip 10.20.30.40] and [ip 172.31.255.1] stopped", 2),
    ("In 2020 we sold 1500 units at 20% off.", 0),
    ("Thndou erhaha eaernd ertible, erheble. Eronin eredble aninou!!", 0),
    ("Ungbege | enüungau | keitung | enchbe | enkeit | äverch", 0),
]


def test_held_out_accuracy():
    f = pii.trained()
    right = total = 0
    for words, labels in pii.parse("\n".join(x for x, _ in HELD_OUT)):
        got = [0] * len(words)
        for _, i, x in f.decode([words]):
            got[i] = x
        right += sum(a == b for a, b in zip(got, labels))
        total += len(words)
    assert right / total >= 0.97


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.find_personal_data(df).collect():
        base = brute(texts[r.doc_id])
        name = lambda s: ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in s)
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, name(base).split(","))) <= set(r.spans.split(","))
        if not re.search("[0-9@]", texts[r.doc_id]):
            assert r.spans == ""


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a@b.c", 2), (None, "a@b.c", 2), (3, "", 3)], "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 0, r.spans) for r in pii.find_personal_data(df).collect()))
    assert got == [(0, "email:0:5"), (0, "email:0:5"), (1, ""), (3, "")]
    assert pii.find_personal_data(df.limit(0)).collect() == []
