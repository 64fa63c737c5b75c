"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

``text_stats`` counts whole texts. ``learn`` takes a labelled sample of at most ``fit_rows`` rows (chosen by a
hash of the label row; the bound is the parameter and holds for the documents these bring, too), grows one conjunction of thresholds after
another for the rejected class by information gain on two thirds of the sample, prunes each on
the other third, keeps it if its precision there suffices, and goes on with the rows it
doesn't cover. ``RuleList.column`` is the ordered conditional expression that Spark evaluates; nothing
is shuffled to apply it.

Cases: null text counts as empty: all counts are 0 and the base fails. Labels that are null or
neither 0 nor 1 aren't used; a label without a document, or an empty label table, teaches
nothing, and a list without rules keeps everything. Ties between thresholds go to the first feature and the
lower threshold. Repeated rows count as often as they occur. Other columns pass
unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean

#: White space to Python's str.split that isn't in [\x20\x09-\x0D].
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_adjacent_repeats long, n_exclaims long"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n] ^ (ids[i : i + n] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    # equal hashes are confirmed on the words
    for a, b in zip(order[:-1][same].tolist(), order[1:][same].tolist()):
        if words[a : a + window] == words[b : b + window]:
            twice[a] = twice[b] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(words),
        lines,
        sum(map(str.isupper, words)),
        sum(map(eq, words, words[1:])),
        text.count("!"),
    )


_NAMES = [x.split()[0] for x in STATS.split(", ")]


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for text in batches:
        yield pd.DataFrame([count_text(t) for t in text], columns=_NAMES)


def text_stats(text: str) -> Column:
    """The statistics of a text column, as a struct.

    Marked as not deterministic, so that no filter on them is pushed below a join or counts a text once more.
    """
    return F.pandas_udf(lean(_counts), STATS, F.PandasUDFType.SCALAR_ITER).asNondeterministic()(text)


def base_failed(s: str) -> Column:
    """Too short, or too much of it repeated; ``s`` is the column with the statistics."""
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


def features(s: str) -> dict[str, Column]:
    c = lambda x: F.col(f"{s}.{x}").cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return {
        "symbols_per_word": c("n_symbols") / words,
        "chars_per_word": c("word_chars") / words,
        "repeated_share": c("n_repeat_words") / words,
        "upper_share": c("n_upper_words") / words,
        "adjacent_share": c("n_adjacent_repeats") / words,
        "exclaims_per_word": c("n_exclaims") / words,
        "dup_line_share": c("n_dup_lines") / lines,
        "words_per_line": words / lines,
    }


@dataclass
class Rule:
    """Rejects where all conditions (feature, "<=" or ">", threshold) hold."""

    conditions: list[tuple[str, str, float]]
    covered: int = 0
    precision: float = 0.0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out


@dataclass
class RuleList:
    rules: list[Rule] = field(default_factory=list)

    def column(self, cols: dict[str, Column]) -> Column:
        """The position of the first rule that fires, from 1; 0 where none does."""
        out = None
        for i, r in enumerate(self.rules, 1):
            fires = F.lit(True)
            for f, op, t in r.conditions:
                fires = fires & ((cols[f] <= t) if op == "<=" else (cols[f] > t))
            out = F.when(fires, i) if out is None else out.when(fires, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{f} {op} {t:.6g}" for f, op, t in r.conditions) + f"  (covers {r.covered}, precision {r.precision:.3f})" for r in self.rules)


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, most: int):
    """The threshold with the highest gain: covered positives x the rise in log precision."""
    p, n = int(y.sum()), len(y) - int(y.sum())
    old, best = np.log2(p / (p + n)), (1e-9, None)
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, up = v[order], np.cumsum(y[order])
        cut = np.flatnonzero(s[1:] > s[:-1])
        if len(cut) > most:
            cut = cut[np.linspace(0, len(cut) - 1, most).astype(int)]
        if not len(cut):
            continue
        left, k = up[cut], cut + 1
        for op, pos, size in (("<=", left, k), (">", p - left, len(y) - k)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - old), -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = gain[i], (f, op, float((s[cut[i]] + s[cut[i] + 1]) / 2))
    return best[1]


def cover(x: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 20, thresholds: int = 256) -> RuleList:
    """Learn from features, labels (True: reject) and ``fold`` (True: for growing; the rest prunes)."""
    out, alive = RuleList(), np.ones(len(y), bool)
    while len(out.rules) < most_rules and (y & alive & fold).sum() >= least:
        grow, prune = alive & fold, alive & ~fold
        rule, inside = Rule([]), grow.copy()
        while (inside & ~y).any() and len(rule.conditions) < 6:
            at = np.flatnonzero(inside)
            found = _best_condition({f: v[at] for f, v in x.items()}, y[at], thresholds)
            if found is None:
                break
            rule.conditions.append(found)
            inside = grow & rule.mask(x)
        if not rule.conditions:
            break

        def worth(k: int) -> tuple[float, int]:
            m = Rule(rule.conditions[:k]).mask(x) & prune
            p, n = int((m & y).sum()), int((m & ~y).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule.conditions = rule.conditions[: max(range(1, len(rule.conditions) + 1), key=lambda k: (*worth(k), -k))]
        m = rule.mask(x)
        tested = m & prune
        rule.covered = int((m & alive).sum())
        rule.precision = float(y[tested].mean()) if tested.any() else 0.0
        if rule.precision < precision or int((tested & y).sum()) < max(1, least // 2):
            break
        out.rules.append(rule)
        alive &= ~m
    return out


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, precision: float = 0.95) -> RuleList:
    """A list for quality 0 from (doc_id, text) and (doc_id, quality). At most ``fit_rows`` label rows are used."""
    bounded_batches(docs.sparkSession)
    picked = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where("quality in (0, 1) and doc_id is not null")
    picked = picked.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(fit_rows)  # bounded, so it can be broadcast
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(picked), "doc_id")
    cols = features("s")
    got = rows.select("quality", F.xxhash64("doc_id").alias("h"), text_stats("text").alias("s")).select("quality", "h", base_failed("s").alias("base"), *[c.alias(f) for f, c in cols.items()])
    # a doc_id that many documents have brings no more rows than the bound
    data = got.where("not base").orderBy("h", "quality", *cols).limit(fit_rows).toPandas()
    if not len(data):
        return RuleList()
    x = {f: data[f].to_numpy(float) for f in cols}
    return cover(x, (data["quality"] == 0).to_numpy(), (data["h"] % 3 != 0).to_numpy(), precision)


def judge(docs: DataFrame, rules: RuleList) -> DataFrame:
    """``docs`` in a struct ``row`` with the statistics ``s``, base_failed, the rule that fired (0: none) and kept."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("s", text_stats("row.text"))
    rows = rows.withColumn("base_failed", base_failed("s")).withColumn("fired", rules.column(features("s")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("fired") == 0))
