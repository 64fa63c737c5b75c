"""Near duplicates by tensored MinHash banding, every link confirmed on full sets.

Two small collections of ``m`` hashes, each of ``K`` MinHash values, are combined: the table (i, j) is keyed by the
i-th of the first and the j-th of the second, so m*m tables cost 2*m*K MinHash values instead of
2*m*m*K. ``m`` is the least for which a link at the very threshold is missed by a
collection with a chance of 1e-5 at most.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Classes that share a table key are a bucket. A pair of a bucket is a candidate where at least half of its MinHash values
   agree (a link at the threshold fails that by a chance below 1e-6).
3. Star rounds: each bucket has a leader, and the others are compared with it, set against set, if they are candidates. The
   first round takes of a class's leaders the one that agrees best, which links most of a group of copies at one comparison
   each. ``ROUNDS`` further ones take all leaders and then leave them out of their buckets, as they have met every member. Classes that
   confirmed links join already are never compared, and a bucket that is one component is done.
4. What is left after these is compared in pairs of blocks of at most ``BLOCK_BYTES`` of sets and ``BLOCK_ROWS`` classes;
   two blocks of one component never meet.
5. Components of the links.

No cap drops a pair, and no step writes the pairs of a group. A leader of many classes is sent to parts of
``BLOCK_ROWS`` of these, which pass it one by one, so memory doesn't grow with a group or with its texts; keys are counted by
partial aggregates, and joins on hot keys are split at run time.

Cases: null text, or text without words, has an empty set and is linked with nothing. With fewer words than a shingle
has, the whole sequence is the one shingle. Rows with equal doc_id are compared by each
of their sets and share the smallest component among these. Null doc_ids pass through, each
row on its own (component null, kept). Other columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, lean, materialize, own
from .components import components

K, COLUMNS = 2, 4096
#: Bounds of a block of sets, and of what one leader meets in one task.
BLOCK_ROWS, BLOCK_BYTES = 250, 8 << 20
#: Further star rounds, which leave leaders out; each costs some thirty stages.
ROUNDS = 0
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


_SPACE = bytes([32, 9, 10, 11, 12, 13])
_IS_SPACE = np.isin(np.arange(256), list(_SPACE))
#: A word's hash is the sum of its bytes' numbers, each times its place's; white space counts 0.
_BYTES = np.where(_IS_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * _M3))
_PLACES = mix(np.arange(1000, 1064, dtype=np.uint64) * _M1) | np.uint64(1)
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word `[^\\x20\\x09-\\x0D]+`."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = max(text.rfind(c, at, end) for c in _SPACE) + 1
            if not end:  # a word longer than the chunk
                end = min((x for c in _SPACE if (x := text.find(c, at)) >= 0), default=len(text))
                out.append(np.asarray([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
                at = end
                continue
        out.append(_hashed(text[at:end]))
        at = end
    return np.concatenate(out) if len(out) != 2 else out[1]


def _hashed(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    word = ~_IS_SPACE[raw]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    sums = np.add.reduceat(_BYTES[raw[starts[0] :]] * _PLACES[np.minimum(place, 63)], starts - starts[0])
    out = mix(sums + size.astype(np.uint64) * _M2)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words by `[^\\x20\\x09-\\x0D]+`."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _M3 + h[i : n - k + 1 + i])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def collections(similarity: float, miss: float = 1e-5) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**K)))


def _factors(m: int) -> np.ndarray:
    return mix(np.arange(1, 2 * m * K + 1, dtype=np.uint64) * _M3) | np.uint64(1)


def minhashes(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 32-bit value for each odd factor; the hashes of ``s`` are uniform, so a product orders them anew."""
    out = np.full(len(factors), ~np.uint64(0))
    for lo in range(0, len(s), 16_384):
        np.minimum(out, np.multiply.outer(factors, s[lo : lo + 16_384]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def collected(sig: np.ndarray, m: int) -> np.ndarray:
    """The two collections, of m hashes of K MinHash values each."""
    values = sig.reshape(2, m, K).astype(np.uint64)
    return mix((values[..., 0] << np.uint64(32) | values[..., 1]) + _M3).view(np.int64)


def _features(shingle: int, m: int):
    factors = _factors(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, th in zip(b["doc_id"], b["text"], b["th"]):
                s = shingle_set(t, shingle)
                if len(s):
                    sig = minhashes(s, factors)
                    x, y = collected(sig, m)
                    out.append((d, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype("<u4").tobytes(), x, y))
                else:
                    out.append((d, th, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n", "digest", "sig", "x", "y"]).astype({"doc_id": "Int64", "th": "Int64"})

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle).astype("<u8").tobytes() for t in b["text"]]
            yield pd.DataFrame({"cid": b["cid"], "bytes": [len(x) for x in sets], "h": sets})

    return run


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The candidates among pairs of MinHash values, with how many agree."""
    for b in batches:
        if not len(b):
            continue
        x, y = (np.frombuffer(b"".join(b[c]), "<u4").reshape(len(b), -1) for c in ("lead_sig", "sig"))
        same = (x == y).sum(1)
        close = 2 * same >= x.shape[1]
        yield pd.DataFrame({"lead": b["lead"][close], "cid": b["cid"][close], "agree": same[close]})


def _near(both: int, n: int, m: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (n + m - both)


def _with_leader(percent: int):
    """Links of leaders, each followed by the classes it is compared with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for lead, leads, cid, h in zip(b["lead"], b["leads"], b["cid"], b["h"]):
                s = np.frombuffer(h, "<u8")
                if leads:
                    top = s.copy()
                    continue
                at = np.searchsorted(top, s)
                both = int((top[np.minimum(at, len(top) - 1)] == s).sum())
                if _near(both, len(top), len(s), percent):
                    out.append((lead, cid))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a[i], b[i]) those that join two trees."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = top(i), top(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def dealt(rows: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """``rows`` (group, c, cid, ...) with (_i, _j), the pairs of blocks of their group that each row goes to.

    A block holds about ``most`` of the weight. A component c above half of that has blocks of its own, which don't meet each other.
    """
    rows = rows.withColumn("_w", weight.cast("long"))
    parts = rows.groupBy(group, "c").agg(F.sum("_w").alias("_w")).withColumn("_big", F.col("_w") > most // 2)
    k = F.ceil(F.col("_w") / most)
    total = parts.groupBy(group).agg(
        F.ceil(F.sum(F.when(~F.col("_big"), F.col("_w")).otherwise(0)) / most).alias("_small"), F.sum(F.when(F.col("_big"), k).otherwise(0)).alias("_own")
    )
    order = W.partitionBy(group).orderBy("c")
    # one row for each component that fills blocks, so few rows for a group of any size
    big = parts.where("_big").select(group, "c", k.alias("_k"), (F.sum(k).over(order) - k).alias("_lo"))
    rows = rows.join(total.hint("merge"), group).join(big.hint("merge"), [group, "c"], "left")
    first = F.col("_small") + F.col("_lo")
    alone = F.col("_lo").isNotNull()
    block = F.when(alone, first + F.pmod(F.xxhash64("cid", F.lit(7)), F.col("_k"))).otherwise(F.pmod(F.xxhash64("c", F.lit(7)), F.greatest("_small", F.lit(1))))
    rows = rows.withColumn("_b", block).withColumn("_first", first)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_small") + F.col("_own") - 1), lambda o: ~alone | (o < F.col("_first")) | (o >= F.col("_first") + F.col("_k")))
    rows = rows.withColumn("_o", F.explode(others))
    return rows.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_w", "_small", "_own", "_k", "_lo", "_first", "_b", "_o")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together, from batches in key order."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        v = b[keys].to_numpy()
        cut = np.flatnonzero((v[1:] != v[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].iloc[-1].to_numpy() != v[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        edges = [0, *cut.tolist(), len(b)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair of blocks of a bucket, a forest over the classes that are a candidate with one of another component."""
    for g in _groups(batches, ["key", "_i", "_j"]):
        cid, c = g["cid"].to_numpy(), g["c"].to_numpy()
        sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(len(g), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(g) - 1):
            j = np.flatnonzero((2 * (sig[i + 1 :] == sig[i]).sum(1) >= sig.shape[1]) & (c[i + 1 :] != c[i])) + i + 1
            a.append(np.full(len(j), i))
            b.append(j)
        links = _forest(len(g), np.concatenate(a), np.concatenate(b))
        if links:
            yield pd.DataFrame([(int(cid[i]), int(cid[j])) for i, j in links], columns=["a", "b"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the hashes that two sets share."""
    n = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    del order
    new = np.empty(len(flat), bool)
    new[:1], new[1:] = True, flat[1:] != flat[:-1]
    starts = np.flatnonzero(new)
    shared = np.diff(np.append(starts, len(flat))) > 1
    number = np.cumsum(new) - 1
    keep = shared[number]
    col, who = (np.cumsum(shared) - 1)[number[keep]], who[keep]
    total = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(col, [lo, lo + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[who[x:y], col[x:y] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _confirm(percent: int):
    """Links between components, of the sets of each pair of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["gid", "_i", "_j"]):
            if len(g) < 2:
                continue
            cid, c = g["cid"].to_numpy(), g["c"].to_numpy()
            sets = [np.frombuffer(h, "<u8") for h in g["h"]]
            n = np.array([len(s) for s in sets])
            both = overlaps(sets)
            near = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0) & (c[:, None] != c[None, :])
            links = _forest(len(g), *np.nonzero(np.triu(near, 1)))
            if links:
                yield pd.DataFrame([(int(cid[i]), int(cid[j])) for i, j in links], columns=["a", "b"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links among pairs (lead, cid), from their sets (cid, bytes, h)."""
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    others = pairs.join(parts.hint("merge"), "lead").select("lead", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("parts")).alias("part"), "cid")
    others = others.join(sets.hint("merge"), "cid").select("lead", "part", F.lit(False).alias("leads"), "cid", "h")
    leads = parts.join(sets.hint("merge"), parts["lead"] == sets["cid"])
    leads = leads.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"), "cid", "h")
    rows = leads.unionByName(others).repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("leads"), "cid")
    return rows.mapInPandas(lean(_with_leader(percent)), "a long, b long")


def _left_over(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, keep) -> DataFrame:
    """(a, b): links between components among the members (key, cid, c) of each bucket, by pairs of blocks."""
    rows = dealt(members, "key", F.lit(1), 4 * BLOCK_ROWS).select("key", "_i", "_j", "cid", "c").join(sigs.hint("merge"), "cid")
    rows = rows.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "cid")
    tree = keep(rows.mapInPandas(lean(_candidates), "a long, b long"))
    if not tree.limit(1).count():
        return tree
    groups = components(tree, keep).select(F.col("v").alias("cid"), F.col("c").alias("gid"))
    rows = groups.join(members.select("cid", "c").distinct().hint("merge"), "cid").join(sets.select("cid", "bytes").hint("merge"), "cid")
    weight = F.greatest(F.col("bytes"), F.lit(BLOCK_BYTES // BLOCK_ROWS))  # so that it bounds the rows as well
    rows = dealt(keep(rows), "gid", weight, BLOCK_BYTES).select("gid", "_i", "_j", "c", "cid").join(sets.select("cid", "h").hint("merge"), "cid")
    rows = rows.repartition("gid", "_i", "_j").sortWithinPartitions("gid", "_i", "_j", "cid")
    return keep(rows.mapInPandas(lean(_confirm(percent)), "a long, b long"))


def _links(classes: DataFrame, rows: DataFrame, joined: DataFrame, m: int, shingle: int, percent: int, keep) -> DataFrame:
    """(v, c): the components of the classes that have links, with the links ``joined`` (a, b) given."""
    # the table (i, j) is keyed by the i-th hash of one collection and the j-th of the other
    tables = classes.select("cid", "y", F.posexplode("x").alias("i", "a")).select("cid", "i", "a", F.posexplode("y").alias("j", "b"))
    tables = tables.select(F.xxhash64("a", "b", F.col("i") * m + F.col("j")).alias("key"), "cid")

    def led(members: DataFrame, turn: int) -> DataFrame:
        """Members (key, cid, c) of the buckets that hold several components, with the leader of each (lead, lead_c)."""
        first = F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("o"), "cid", "c")).alias("f")
        heads = members.groupBy("key").agg(first, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        return keep(members.join(heads.select("key", F.col("f.cid").alias("lead"), F.col("f.c").alias("lead_c")).hint("merge"), "key"))

    sigs = classes.select("cid", "sig")

    def candidates(members: DataFrame) -> DataFrame:
        pairs = members.where("c != lead_c").select("lead", "cid").distinct()
        pairs = pairs.join(sigs.hint("merge"), "cid").join(sigs.select(F.col("cid").alias("lead"), F.col("sig").alias("lead_sig")).hint("merge"), "lead")
        return pairs.mapInPandas(lean(_agreeing), "lead long, cid long, agree long")

    members = led(tables.withColumn("c", F.col("cid")), 0)
    # the sets of all classes in buckets, of one row each
    need = members.select("cid").distinct().join(classes.select("cid", "rep", "th").hint("merge"), "cid")
    texts = rows.join(need.hint("merge"), (rows["doc_id"] == need["rep"]) & (rows["th"] == need["th"]))
    texts = texts.groupBy(need["rep"], need["th"], need["cid"]).agg(F.first("text").alias("text")).select("cid", "text")
    sets = keep(texts.mapInPandas(lean(_sets(shingle)), "cid long, bytes long, h binary"))
    best = candidates(members).groupBy("cid").agg(F.max_by("lead", F.struct("agree", "lead")).alias("lead"))
    links = joined.unionByName(keep(_compared(keep(best), sets, percent)))
    labels = components(links, keep)
    for turn in range(1, ROUNDS + 2):
        members = members.select("key", "cid").join(labels.withColumnRenamed("v", "cid").hint("merge"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
        members = led(members, turn)
        if turn <= ROUNDS:
            more = keep(_compared(keep(candidates(members).select("lead", "cid")), sets, percent))
            members = members.where("cid != lead")
        else:
            more = _left_over(members.select("key", "cid", "c"), sigs, sets, percent, keep)
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links, keep)
    return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; links where 100 * intersection >= percent * union."""
    m = collections(percent / 100)
    rows = own(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    feats = materialize(rows.mapInPandas(lean(_features(shingle, m)), "doc_id long, th long, n long, digest binary, sig binary, x array<long>, y array<long>"))
    full = feats.where("digest is not null and doc_id is not null")
    with Scratch(docs.sparkSession) as scratch:
        # one row for each class of equal sets; its number stands once it is written
        classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "th", "sig", "x", "y")).alias("f"))
        classes = scratch.keep(classes.select("digest", F.monotonically_increasing_id().alias("cid"), F.col("f.doc_id").alias("rep"), "f.th", "f.sig", "f.x", "f.y"))
        # doc_ids with several sets are one document
        each = full.select("doc_id", "digest").join(classes.select("digest", "cid").hint("merge"), "digest").select("doc_id", "cid")
        several = each.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b")
        joined = scratch.keep(each.join(several.select("doc_id", "a").hint("merge"), "doc_id").select("a", F.col("cid").alias("b")).where("a < b"))
        labels = _links(classes, rows, joined, m, shingle, percent, scratch.keep)
        numbered = classes.select("digest", "cid", "rep").join(labels.withColumnRenamed("v", "cid").hint("merge"), "cid", "left")
        least = numbered.where("c is not null").groupBy("c").agg(F.min("rep").alias("least"))
        found = materialize(numbered.join(least.hint("merge"), "c", "left").select("digest", F.coalesce("least", "rep").alias("component_id")))
    out = feats.select("doc_id", "n", "digest").join(found.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
