import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import g2p, numbers
from corpusmill.functions import text as T
from corpusmill.functions.profiles import BENGALI, LATIN


def col(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalize_sentence(spark):
    cases = {
        "12,  আমি  যাই": "আমি যাই",
        "১২. আমি": "আমি",
        "a ‌b​﻿ c": "a b c",
        "ওঃ।।।": "ওঃ।",
        "এটা...": "এটা।",
        "কি??!!": "কি?",
        "a–b—c": "a-b-c",
        " 5 x": "5 x",
        "": "",
    }
    assert col(spark, list(cases), T.normalize_sentence) == list(cases.values())
    assert col(spark, ["wait... what"], lambda c: T.normalize_sentence(c, LATIN)) == ["wait. what"]
    assert col(spark, [None], T.normalize_sentence) == [None]


def test_native_nfc_on_the_bengali_block(spark):
    rnd = random.Random(0)
    letters = "কখড়ঢ়য়ে ৗািৈ"
    rows = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 8))) for _ in range(300)] + ["ড়", "ঢ়", "য়", "ো", "ৌ", "ক়্", "ক়্"]
    assert col(spark, rows, T.nfc_bengali) == [unicodedata.normalize("NFC", r) for r in rows]
    assert col(spark, ["é", None], T.nfc) == ["é", None]


def test_keys_words_types(spark):
    assert len(set(col(spark, ["A b", "ab", " a\tB\n", "a b"], T.dedup_key))) == 1
    assert col(spark, ["", " ", " a  b\nc "], T.word_count) == [0, 0, 3]
    assert col(spark, ["a? b!", "a! b", "a."], T.sentence_type) == ["question", "exclamation", "statement"]


def test_validity_and_cleaning(spark):
    assert col(spark, ["", "আমি", "আমি abcdefgh", "।।।", "abc"], T.is_valid) == [False, True, False, True, False]
    assert col(spark, ["আ", " আমি ", "আম abcdef", "x" * 501, "আমি ab"], T.clean_or_null) == [None, "আমি", None, None, "আমি ab"]
    assert col(spark, ["১2a৩", "", "none"], lambda c: T.digits_to_int(c).cast("long")) == [123, 0, 0]


def test_characters_are_counted_without_regexes(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plan = lambda *cs: df.repartition(1).select(*[c.alias("x") for c in cs])._jdf.queryExecution().optimizedPlan().toString()
    t = F.col("t")
    assert "regexp" not in plan(T.script_share(t), T.is_valid(t, LATIN), T.clean_or_null(t, 2, 500, LATIN), T.strip(t))
    assert plan(T.compare_form(t)).count("regexp_replace") == plan(T.remove_latin(t)).count("regexp_replace") == 1
    rnd = random.Random(3)
    rows = ["".join(rnd.choice("aZéɏ0 .;\t\x85\xa0\u2003\u3000\x1c\u200b।কো") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    others = " ।,!?'\"-():;\n"
    own = lambda x: x in others or "A" <= x <= "Z" or "a" <= x <= "z" or "\xc0" <= x <= "\u024f"
    assert col(spark, rows, lambda c: T.script_share(c, LATIN)) == [sum(map(own, x)) / len(x) if x else 0.0 for x in rows]
    assert col(spark, rows, T.strip) == [x.strip(T.SPACE_CHARS) for x in rows]


def test_units(spark):
    (units,) = col(spark, ["মন্ত্র"], T.unit_list)
    assert units == ["consonant:ত", "consonant:ন", "consonant:ম", "consonant:র", "special:্", "conjunct:ন্ত", "conjunct:ত্র", "conjunct:ন্ত্র"]
    assert col(spark, ["মন্ত্র"], T.conjunct_list) == [["ন্ত", "ত্র", "ন্ত্র"]]
    assert len(BENGALI.labelled()) == 116
    assert col(spark, ["ক", "অ", "া", "্", "ঁ", "x", "ৎ"], T.char_kind) == ["consonant", "vowel", "matra", "hasanta", "chandrabindu", "other", "consonant"]


def test_paths_and_names(spark):
    assert col(spark, ["a.wav", "../a", "a;b", ""], T.is_safe_name) == [True, False, False, False]
    assert col(spark, ["/d/a", "/d", "/dx/a", "/d/../a"], lambda c: T.is_within(c, "/d/")) == [True, True, False, False]
    assert col(spark, ["sp_x_00012.wav", "bad"], T.prompt_of) == ["00012", ""]


@pytest.mark.parametrize(
    ("n", "words"),
    [(0, "শূন্য"), (29, "ঊনত্রিশ"), (31, "ত্রিশ এক"), (100, "একশো"), (250, "দুইশো পঞ্চাশ"), (1000, "এক হাজার"), (100000, "এক লাখ"), (12345678, "এক কোটি তেইশ লাখ চল্লিশ পাঁচ হাজার ছয়শো সত্তর আট"), (10**9, "একশো কোটি"), (-5, "ঋণাত্মক পাঁচ")],
)
def test_words_of(n, words):
    assert numbers.words_of(n) == words


def test_native_number_words(spark):
    rnd = random.Random(1)
    ns = [0, 1, 99, 100, 101, 199, 999, 1000, 99_999, 100_000, 9_999_999, 10**7, 9_999_999_999, -42] + [rnd.randrange(10**10) for _ in range(300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long")
    assert [r[0] for r in df.orderBy("i").select(numbers.number_words(F.col("n"))).collect()] == [numbers.words_of(n) for n in ns]


SPOKEN = [
    ("আমার বয়স ২৫", "আমার বয়স পঁচিশ", "a m a r ɔ   b ɔ dʒ ɔ ় s ɔ   p ɔ̃ tʃ i ʃ ɔ"),
    ("৳৫০০ টাকা", "পাঁচশো টাকা টাকা", "p ã tʃ ɔ ʃ o   ʈ a k a   ʈ a k a"),
    ("২৫/১২/২০২৩", "পঁচিশ ডিসেম্বর দুই হাজার তেইশ", "p ɔ̃ tʃ i ʃ ɔ   ɖ i s e mbɔ r ɔ   d u i   h a dʒ a r ɔ   t e i ʃ ɔ"),
    ("৳5.50", "পাঁচ টাকা পঞ্চাশ পয়সা", None),
    ("3.14", "তিন দশমিক এক চার", None),
    ("Hello", "এইচইএলএলও", "e i tʃ ɔ i e l ɔ e l ɔ o"),
    ("1,000", "এক শূন্য", None),
    ("2024-13-01", "দুই হাজার চব্বিশ তেরো এক", None),
    ("ঁক", "ঁক", "k ɔ"),
    ("ক ঁখ", "ক ঁখ", "k ɔ  ̃ kʰ ɔ"),
    ("ক ঽ খ", "ক ঽ খ", "k ɔ   kʰ ɔ"),
    ("ক্তঁ", "ক্তঁ", "ktɔ̃"),
    ("a_b 5%", "a_b পাঁচ%", "a _ b   p ã tʃ ɔ %"),
    ("ব্যক্তি", "ব্যক্তি", "bjɔ ktɔ i"),
    ("চাঁদ", "চাঁদ", "tʃ ã d ɔ"),
]


@pytest.mark.parametrize(("raw", "spoken", "phonemes"), SPOKEN)
def test_spoken_and_phonemes(raw, spoken, phonemes):
    assert numbers.spoken_text(numbers.spoken_text(raw)) == unicodedata.normalize("NFC", spoken)
    if phonemes:
        assert unicodedata.normalize("NFC", g2p.to_phonemes(raw)) == unicodedata.normalize("NFC", phonemes)


def test_native_phonemes_match(spark):
    rnd = random.Random(2)
    alphabet = list("কতনমরলযষশসহজঞদধড়অআইএও") + list("ািীুেোৌ") + ["্", "্", "ঁ", "ং", "ঃ", "ঽ", " ", " ", "a", "%"]
    rows = [numbers.spoken_text(t) for t, _, _ in SPOKEN] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    got = col(spark, rows, g2p.phonemes)
    for t, x in zip(rows, got):
        assert x == " ".join(g2p.sounds(t)), repr(t)


def test_inventory(spark):
    rows = g2p.inventory(spark).groupBy("category").count().collect()
    n = {r[0]: r[1] for r in rows}
    assert n["vowels"] == len(set(g2p.VOWELS.values())) == n["nasalized"]
    assert n["conjuncts"] == len(set(g2p.clusters().values())) and len(g2p.clusters()) == 222
