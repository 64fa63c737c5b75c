import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpusmill.llm import token_store
from corpusmill.llm.token_store import Shard, WordEncoder, store_and_read

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(2)
    bits = ["The", "word's", "don't", " ", "  ", "\n", "é", "é", "İ", "ß", "%%%", "!!", "12", "³", "ﬁ", "中文", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "🙂", ".", "'S", "Σ", "́", "ª", "a‍b"]
    return [None, "", " ", "x" * 50_000, "word " * 30_000] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(400)]


def ids(lib, t):
    return lib.encode(t or "", add_special_tokens=False).ids


def test_encoder_is_the_library():
    e = WordEncoder(PATH)
    t = [x or "" for x in texts()]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(t)] == [ids(e.lib, x) for x in t]


def test_codes_give_random_access():
    rnd = np.random.default_rng(0)
    for top in (1, 255, 256, 49_408, 2**24, 2**32 - 1):
        parts = [rnd.integers(0, top, n, dtype=np.uint32, endpoint=True) for n in (0, 1, 7, 5000, 0)]
        s = Shard.from_bytes(Shard.build([3, -1, 5, 6, 9], parts).to_bytes())
        flat = np.concatenate(parts)
        assert (s.all() == flat).all() and s.starts.tolist() == [0, 0, 1, 8, 5008]
        assert [s[i] for i in range(0, len(flat), 37)] == flat[::37].tolist()
        with pytest.raises(IndexError):
            s[len(flat)]
    assert Shard.from_bytes(Shard.build([], []).to_bytes()).all().tolist() == []


def test_store_and_read(spark, monkeypatch):
    lib = WordEncoder(PATH).lib
    rows = [(d, t) for d, t in zip(random.Random(4).sample(range(-500, 5000), 405), texts())] + [(77777, "one"), (77777, "one two"), (77777, None), (None, "first")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    monkeypatch.setattr(token_store, "SHARD_IDS", 3000)
    got = sorted(map(tuple, store_and_read(df, PATH).collect()), key=str)
    at, want = 0, []
    for d, x in sorted((-(2**63) if d is None else d, np.asarray([*ids(lib, t), 1], "<u4").tobytes()) for d, t in rows):
        want.append((None if d == -(2**63) else d, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert got == sorted(want, key=str)
    assert store_and_read(df.limit(0), PATH).collect() == []


def test_other_tokenizers_encode_whole_texts():
    e = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.wordwise and WordEncoder(PATH).wordwise
    t = [x or "" for x in texts()]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(t)] == [ids(e.lib, x) for x in t]


def test_a_doc_id_of_many_rows_is_dealt_to_several_ranges(spark):
    borders = np.asarray([3, 7, 7, 7, 7, 9])
    doc, first = np.asarray([1, 3, 5, 7, 7, 7, 8, 9, 10]), np.asarray([0, 0, 0, 0, 1 << 30, (1 << 31) - 1, 0, 0, 0])
    assert token_store.ranged(doc, first, borders).tolist() == [0, 1, 1, 2, 4, 5, 5, 6, 6]
    rnd = random.Random(3)
    rows = [(7, f"word {rnd.random()}") for _ in range(300)] + [(None, f"x {i}") for i in range(40)] + [(i, f"y {i}") for i in range(30)]
    got = store_and_read(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 1).collect()
    lib = WordEncoder(PATH).lib
    want = sorted((-1 if d is None else d, zlib.crc32(np.asarray(ids(lib, t) + [1], "<u4").tobytes())) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_letters_go_to_the_model_and_each_piece_is_looked_up_once():
    e = WordEncoder(PATH)
    lib = e.lib
    odd = [chr(i) for i in range(0x130) if chr(i).isalpha()]
    words = [*odd, *["An" + c + "lewh" for c in odd], *["".join(random.Random(i).choices(odd, k=12)) for i in range(300)]]
    want = [ids(lib, w) for w in words]
    e.encode(["."])
    e.lib = None  # letters don't need the library's whole way
    asked = []

    class Known(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    e.known = Known(e.known)
    got = e.encode([" ".join(words)] * 3 + [" ".join(words) + "."])
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:3]] == [sum(want, [])] * 3
    assert len(asked) == len(set(asked))


def test_every_white_space_splits_as_in_the_library():
    e = WordEncoder(PATH)
    t = [f"{c}one{c}two's{c}{c}x.{c}" for c in map(chr, range(0x110000)) if c.isspace() or c in "\u180e\u200b\u2060\ufeff"] + ["", " ", "x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(t)] == [ids(e.lib, x) for x in t]


def test_files_with_added_letters_or_padding_are_encoded_whole(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        told = json.load(f)
    word = told["added_tokens"][0] | {"content": "Foo."}
    padding = {"strategy": {"Fixed": 4}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"}
    for i, change in enumerate(({"added_tokens": [*told["added_tokens"], word | {"id": 49408}]}, {"padding": padding})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(told | change), encoding="utf-8")
        e = WordEncoder(str(path))
        t = ["a Foo. b", "x", "foo. Foo"]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(t)] == [ids(e.lib, x) for x in t]
