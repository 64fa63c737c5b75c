import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from corpusmill.llm.pieces import SPACE, UNKNOWN, Pieces, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(1)
    bits = ["the", "The ", "ing", " ", "  ", "\n", "é", "ß", "中", "🙂", "\0", "▁", "don't", "%%%", "1234", "\t", "a\xa0b", "x" * 30]
    return [None, "", " ", "▁", "a▁ b", "word " * 5000, "y" * 20_000] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(200)]


def brute(p, table, s):
    """Best score and ids by trying every piece at every place."""
    best = [(0.0, [])] + [None] * len(s)
    for e in range(1, len(s) + 1):
        found = None
        for a in range(max(0, e - 48), e):
            i = table.get(s[a:e])
            if i is not None:
                score = best[a][0] + i[1]
                if found is None or score > found[0]:  # longest first
                    found = (score, [*best[a][1], i[0]])
        if s[e - 1] not in table:
            score = best[e - 1][0] + p.floor
            if found is None or score > found[0]:
                found = (score, [*best[e - 1][1], *(p.byte_ids[b] for b in s[e - 1].encode())])
        best[e] = found
    return best[-1]


def test_best_segmentation_and_round_trip():
    p = Pieces(PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in p.written if not sp.is_byte(i) and not sp.is_unknown(i)}
    assert p.cuts and max(map(len, table)) <= 48
    for t in texts():
        ids = p.encode(t)
        assert p.text(ids) == (t or "")
        if t and SPACE not in t and len(t) < 400:
            assert np.frombuffer(ids, "<u4").tolist() == brute(p, table, SPACE + t.replace(" ", SPACE))[1], t


def test_other_vocabularies():
    """Pieces that cross words are not cut; without bytes the unknown id stands."""
    p = object.__new__(Pieces)
    p.setup([(1, "a", -3.0), (2, f"a{SPACE}a", -1.0), (3, SPACE, -1.0), (4, "aa", -2.0)], {}, 0)
    assert not p.cuts and p.floor == -3.0 - UNKNOWN
    assert np.frombuffer(p.encode("a aa"), "<u4").tolist() == [3, 2, 1]
    assert np.frombuffer(p.encode("aaq"), "<u4").tolist() == [3, 4, 0]


def test_table(spark):
    p = Pieces(PATH)
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "x", "n"), (None, "x", "n")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    want = sorted(((d, len(e := p.encode(t)) // 4, zlib.crc32(e), True) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.round_trip) for r in got), key=str) == want
