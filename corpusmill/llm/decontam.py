"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one space. An item of L characters may occur
with up to k = floor(rate * L) edits. Cut into k+1 pieces, it must then hold one piece unchanged, so an
Aho-Corasick automaton of all pieces finds every place where it can be. Around each hit the item's place is verified by
Myers' bit-parallel edit distance; windows of one item that overlap are verified as one, so a text costs
at most its length per item it has hits of.

The items are a stated query set: they are held by the driver and go to the tasks in blocks of ``BLOCK_CHARS``
characters at most, one pass over the documents each. Nothing is shuffled.

Cases: null or empty text holds nothing. Null and blank items are no queries; items with k = 0 must stand
between word borders. Equal items with several ids are all reported. Repeated documents each keep
their row. All columns of a document are carried in ``row``. Without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, own

BLOCK_CHARS = 4_000_000
RATE = 0.07


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length with their offsets."""
    n = len(item)
    edges = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and the first end of such a part."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, at = score, i + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


class Matcher:
    """An automaton over the pieces of (id, text) items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, pieces = [], {}
        ids: dict[str, list[int]] = {}
        for i, t in items:
            ids.setdefault(normalize(t), []).append(i)
        for text, own_ids in ids.items():
            if text:
                k = int(rate * len(text))
                for at, p in cut(text, k):
                    pieces.setdefault(p, []).append((len(self.items), at))
                self.items.append((text, k, masks(text), own_ids))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """Per item id its least distance in the text, of those within their budget."""
        if not self.items:
            return {}
        t = normalize(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for item, at in where:
                pattern, k, _, _ = self.items[item]
                lo = end + 1 - size - at
                lo, hi = max(0, lo - k), lo + len(pattern) + k
                runs = windows.setdefault(item, [])
                if runs and runs[-1][0] <= lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
        out: dict[int, int] = {}
        for item, runs in windows.items():
            pattern, k, peq, own_ids = self.items[item]
            best = self._exact(pattern, k, t, runs)
            if best is None and k:
                best = min(least_distance(pattern, peq, t[a:b])[0] for a, b in merged(runs))
            if best is not None and best <= k:
                out.update(dict.fromkeys(own_ids, best))
        return out

    @staticmethod
    def _exact(pattern: str, k: int, t: str, runs: list[list[int]]) -> int | None:
        for a, b in runs:
            at = t.find(pattern, a, b)
            while at >= 0:
                z = at + len(pattern)
                if k or not (at and t[at - 1].isalnum() and pattern[0].isalnum()) and not (t[z : z + 1].isalnum() and pattern[-1].isalnum()):
                    return 0
                at = t.find(pattern, at + 1, b)
        return None


def merged(runs: list[list[int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def match_items(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` in a struct ``row`` with ``hits``: array of (item_id, distance) by item_id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.array().cast("array<struct<item_id:bigint,distance:bigint>>").alias("hits"))
    block, size = [], 0
    queries = own(items, "item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator()
    for q in queries:
        block.append((q.item_id, q.text))
        size += len(q.text)
        if size > BLOCK_CHARS:
            rows, block, size = _pass(rows, block, rate), [], 0
    return _pass(rows, block, rate) if block else rows


def _pass(rows: DataFrame, block: list, rate: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in matcher.find(t).items()] for t in texts])

    found = F.pandas_udf(lean(run), "array<struct<item_id:bigint,distance:bigint>>", F.PandasUDFType.SCALAR_ITER)(F.col("row.text"))
    return rows.withColumn("hits", F.array_sort(F.concat("hits", found)))
