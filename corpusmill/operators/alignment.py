"""Spoken against expected words."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compare_form

WINDOW, CORRECT, WARNING = 5, 0.85, 0.5
RESULT = "array<struct<word:string,status:string,confidence:double,spoken:string>>"


def word_similarity(a: Column, b: Column, form=None) -> Column:
    """1 less the edit distance over the longer length, of the words as alignment compares them; 0 if one is empty or null."""
    x, y = (compare_form(c) if form is None else form(c) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    like = F.when(x == y, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), like).otherwise(0.0)


def char_overlap(a: Column, b: Column) -> Column:
    """Shared over all characters; 1 if there are none."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda v: v != "")) for c in (a, b))
    both, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def align(expected: Column, spoken: Column) -> Column:
    """Each expected word with its status, in a fold over the words: the best of the next five spoken words decides.

    correct from 0.85, warning from 0.5, both move on behind their word; an error stays. Words that are only marks are skipped.
    """
    keyed = F.transform(spoken, lambda w: F.struct(compare_form(w).alias("k"), w.alias("w")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(RESULT).alias("out"))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("w"))

    def step(a: Column, word: Column) -> Column:
        k = compare_form(word)
        near = F.slice(keyed, a["at"] + 1, F.lit(WINDOW))
        scored = F.transform(near, lambda x, i: F.struct(word_similarity(k, x["k"], lambda c: c).alias("s"), (i + a["at"]).alias("i"), x["w"].alias("w")))
        best = F.aggregate(scored, none, lambda b, x: F.when(x["s"] > b["s"], x).otherwise(b))
        status = F.when(best["s"] >= CORRECT, "correct").when(best["s"] >= WARNING, "warning").otherwise("error")
        row = F.struct(word.alias("word"), status.alias("status"), F.round(best["s"], 2).alias("confidence"), best["w"].alias("spoken"))
        at = F.when(best["s"] >= WARNING, best["i"] + 1).otherwise(a["at"])
        return F.when(F.length(k) == 0, a).otherwise(F.struct(at.alias("at"), F.concat(a["out"], F.array(row)).alias("out")))

    return F.aggregate(expected, zero, step, lambda a: a["out"])


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def align_words(expected: list[str], spoken: list[str], form) -> list[tuple[str, str, float, str | None]]:
    """The fold for one pair of word lists; long lists go this way, as the JVM's fold copies its result for each word."""
    keys, at, out = [form(w) for w in spoken], 0, []
    for word in expected:
        if not (k := form(word)):
            continue
        best, where = 0.0, -1
        for i in range(at, min(at + WINDOW, len(keys))):
            if k == keys[i]:
                best, where = 1.0, i
                break
            longest = max(len(k), len(keys[i]))
            # the lengths alone bound the similarity, and only a greater one counts
            if keys[i] and 1 - abs(len(k) - len(keys[i])) / longest > best and (s := 1 - _distance(k, keys[i]) / longest) > best:
                best, where = s, i
        status = "correct" if best >= CORRECT else "warning" if best >= WARNING else "error"
        at = where + 1 if best >= WARNING else at
        out.append((word, status, round(best, 2), spoken[where] if where >= 0 else None))
    return out


#: Most bytes of words in one Arrow batch, and rows that are Python objects at a time.
BATCH_BYTES, ROWS = 2 << 20, 64


def _bounded_batches() -> None:
    """Cut Arrow batches by size, so that a worker's memory doesn't follow the length of the texts. A smaller setting stays."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def _align_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    marks = re.compile("[।,!?\\-–—\"'()\\[\\]]+")
    form = lambda w: " ".join(unicodedata.normalize("NFC", marks.sub(" ", w)).split()).lower()
    keys = ("word", "status", "confidence", "spoken")
    kind = pa.list_(pa.struct([(k, pa.float64() if k == "confidence" else pa.string()) for k in keys]))
    parts = []
    for at in range(0, len(a), ROWS):
        rows = [None if x is None or y is None else align_words(x, y, form) for x, y in zip(a.slice(at, ROWS).to_pylist(), b.slice(at, ROWS).to_pylist())]
        parts.append(pa.array([r and [dict(zip(keys, w)) for w in r] for r in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def align_arrow(expected: Column, spoken: Column) -> Column:
    """``align`` in Arrow batches; a few rows at a time are Python objects, the rest stays in Arrow."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _align_batch(a, b)

    _bounded_batches()
    return F.arrow_udf(run, RESULT)(expected, spoken)


def overall(results: Column) -> Column:
    """Correct words and half of the warnings, in percent, truncated; 0 for no words."""
    count = lambda s: F.size(F.filter(results, lambda r: r["status"] == s))
    share = (count("correct") + count("warning") * 0.5) / F.size(results) * 100
    return F.when(F.size(results) > 0, share.cast("int")).otherwise(0)
