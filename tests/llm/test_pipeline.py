"""The pipeline against plain Python, stage by stage and as a whole; and the entry module without the subpackage."""

import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
import public_tokenizers
import test_decontam
import test_line_dedup
import test_minhash
import test_quality_rules

import corpus_pipeline as cp
from corpusmill.llm import decontam, quality_rules
from corpusmill.llm.pieces import Pieces

SF = "/root/testdata/sf0.001"


def rejected_by(rules, text):
    n_words, chars, symbols, dups, repeats = test_quality_rules.brute(text)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    w, n = max(n_words, 1), max(len(lines), 1)
    x = {
        "symbols_per_word": symbols / w, "chars_per_word": chars / w, "repeated_share": repeats / w, "upper_share": sum(y.isupper() for y in words) / w,
        "adjacent_share": sum(a == b for a, b in zip(words, words[1:])) / w, "exclaims_per_word": (text or "").count("!") / w, "dup_line_share": dups / n, "words_per_line": w / n,
    }
    base = n_words < 20 or 100 * repeats > 30 * n_words
    return base or any(all(x[f] <= t if op == "<=" else x[f] > t for f, op, t in r.conditions) for r in rules.rules)


def test_whole_run_matches_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if not rejected_by(rules, t)]
    rows = [(d, t) for d, t, _, _ in test_line_dedup.brute(rows)]
    keep = {d for d, _, _, kept in test_minhash.brute(rows, 5, 80) if kept}
    rows = [(d, t) for d, t in rows if d in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    k = {i: int(decontam.RATE * len(decontam.normalize(t))) for i, t in items}
    clean = []
    for d, t in rows:
        norm = decontam.normalize(t)
        # the exact test is quadratic, so items are first asked for a quarter of their text
        near = [(i, x) for i, x in ((i, decontam.normalize(x)) for i, x in items) if any(x[a : a + len(x) // 4] in norm for a in range(0, len(x) - len(x) // 4 + 1, 3))]
        if not any(test_decontam.levenshtein_part(x, norm) <= k[i] for i, x in near):
            clean.append((d, t))
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d, len(e := p.encode(t)) // 4, zlib.crc32(e), True) for d, t in clean)
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.round_trip) for r in cp.run(spark, SF).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (2, "word " * 50, "en", None, 250), (3, " ".join(f"w{i}" for i in range(60)), "en", "s", 9)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert cp.STAGES[-1][1](spark, docs, SF).count() == (1 if rows else 0)


@pytest.mark.parametrize("gone", [["corpusmill/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_works_without_the_subpackage(tmp_path, gone):
    root = Path(cp.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for g in gone:
        p = tmp_path / "r" / g
        shutil.rmtree(p) if p.is_dir() else p.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'curate_lines' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
