"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points are counted, by their SHA-256. The index is a folder of the shared
file system with one sub-folder per version:

``refs``      (key, doc_id, n): how often a document holds a key; the exact references
``counts``    (key, n_docs, last_doc): per key its documents and the largest doc_id
``filters``   (shard, shards, filter): a cuckoo filter of the keys of a shard, which follows from the key and the number of shards

A first ``insert`` counts exactly and writes the filters. A later
``insert`` asks the filters first: keys that none of them knows are certainly new and take their counts
from the batch alone; only the rest meet the old tables. ``dedup_lines`` inserts the documents in ``BATCHES`` batches, so that
its counts come through the filters. ``delete`` takes a document's references away,
and a key's fingerprint with its last one. ``drop_lines`` drops the lines of keys held by ``min_docs`` documents
or more, except in the largest doc_id that holds the key.

References are dealt by (key, doc_id) and reach the key as partial counts, so a line in
a third of all documents is no single task's work; shards hold distinct keys only, at most about
``SHARD_KEYS`` each, and an index that outgrows its shards is dealt to twice as many.

Cases: null or empty text is one empty line. Rows with equal doc_id are one document for
counting, and each keeps its own row and text; a null doc_id counts as the smallest. Other columns
stay as they are, whatever their names, in a struct ``row``. An empty table gives an empty index and no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, bounded_batches, remove, shared_dir

SHARD_KEYS, BATCHES = 500_000, 2
_NULL_DOC = -(2**63)


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two places for each key.

    Equal fingerprints in equal buckets are kept as often as they were inserted, so that
    deleting one key never loses another. What finds no place after ``KICKS`` moves
    waits in an exact overflow list; at a load above ``LOAD`` the filter doubles.
    """

    SLOTS, KICKS, LOAD = 4, 200, 0.85

    def __init__(self, keys: int = 0):
        self.size = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / self.LOAD / self.SLOTS))))
        self.cells = np.zeros(self.size * self.SLOTS, np.uint16)
        self.over: list[int] = []
        self.n = 0

    @staticmethod
    def hashed(keys) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and first places, from bytes that are already uniform."""
        raw = np.frombuffer(b"".join(k[:10] for k in keys), np.uint8).reshape(-1, 10)
        fp = raw[:, 8].astype(np.uint16) << 8 | raw[:, 9]
        return np.where(fp == 0, 1, fp).astype(np.uint16), np.ascontiguousarray(raw[:, :8]).view("<u8").ravel()

    @staticmethod
    def _step(fp: int) -> int:
        return (fp * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF

    def contains(self, keys) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        fp, place = self.hashed(keys)
        mask = np.uint64(self.size - 1)
        a = place & mask
        b = a ^ ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(0xFFFFFFFF) & mask)
        cells = self.cells.reshape(-1, self.SLOTS)
        hit = ((cells[a] == fp[:, None]) | (cells[b] == fp[:, None])).any(axis=1)
        if self.over:
            hit |= np.isin(np.minimum(a, b) << np.uint64(16) | fp.astype(np.uint64), np.asarray(self.over, np.uint64))
        return hit

    def insert(self, keys) -> None:
        """Keys that are not in the filter's set yet; the caller keeps the exact set."""
        if not len(keys):
            return
        if (self.n + len(keys)) > self.LOAD * len(self.cells):
            raise OverflowError("rebuild with more room")
        cells, slots, mask = self.cells.tolist(), self.SLOTS, self.size - 1
        fps, places = self.hashed(keys)
        turn = 0
        for fp, place in zip(fps.tolist(), places.tolist()):
            at = place & mask
            for kick in range(self.KICKS):
                for p in (at, at ^ (self._step(fp) & mask)):
                    lo = p * slots
                    for i in range(lo, lo + slots):
                        if not cells[i]:
                            cells[i] = fp
                            break
                    else:
                        continue
                    break
                else:
                    turn += 1
                    at = at ^ (self._step(fp) & mask)
                    i = at * slots + turn % slots
                    fp, cells[i] = cells[i], fp
                    at ^= self._step(fp) & mask
                    continue
                break
            else:
                self.over.append(min(at, at ^ (self._step(fp) & mask)) << 16 | fp)
        self.cells = np.asarray(cells, np.uint16)
        self.n += len(keys)

    def delete(self, keys) -> None:
        """Keys that were inserted."""
        mask = self.size - 1
        fps, places = self.hashed(keys) if len(keys) else ((), ())
        for fp, place in zip(map(int, fps), map(int, places)):
            a = place & mask
            b = a ^ (self._step(fp) & mask)
            self.n -= 1
            for i in (*range(a * self.SLOTS, (a + 1) * self.SLOTS), *range(b * self.SLOTS, (b + 1) * self.SLOTS)):
                if self.cells[i] == fp:
                    self.cells[i] = 0
                    break
            else:
                self.over.remove(min(a, b) << 16 | fp)

    def to_bytes(self) -> bytes:
        return np.asarray([self.size, self.n, len(self.over)], "<u8").tobytes() + np.asarray(self.over, "<u8").tobytes() + self.cells.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        self = cls()
        size, self.n, over = map(int, np.frombuffer(data, "<u8", 3))
        self.size = size
        self.over = np.frombuffer(data, "<u8", over, 24).tolist()
        self.cells = np.frombuffer(data, "<u2", size * cls.SLOTS, 24 + 8 * over).copy()
        return self


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(_NULL_DOC))


class LineIndex:
    """One version of the index. ``insert`` and ``delete`` write a new version and leave the old one as it is."""

    TABLES = {"refs": "key binary, doc_id long, n long", "counts": "key binary, n_docs long, last_doc long", "filters": "shard int, shards int, filter binary"}

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 40, min_docs: int = 5):
        self.spark, self.path, self.min_chars, self.min_docs = spark, path, min_chars, min_docs
        first = self.table("filters").select("shards").limit(1).collect() if path else []
        self.shards = first[0].shards if first else 1

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{name}") if self.path else self.spark.createDataFrame([], self.TABLES[name])

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.table(name)

    def _new(self) -> LineIndex:
        new = LineIndex(self.spark, None, self.min_chars, self.min_docs)
        new.path, new.shards = shared_dir(self.spark), self.shards
        return new

    def drop(self) -> None:
        """Remove this version's folder."""
        if self.path:
            remove(self.spark, self.path)

    def references(self, docs: DataFrame) -> DataFrame:
        """(key, doc_id, n) of the documents' lines."""
        keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= self.min_chars)
        rows = docs.select(_doc("doc_id").alias("doc_id"), F.explode(F.transform(keys, lambda k: F.unhex(F.sha2(k, 256)))).alias("key"))
        return rows.groupBy("key", "doc_id").agg(F.count("*").alias("n"))

    @staticmethod
    def _counted(refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def insert(self, docs: DataFrame, fresh: bool = False) -> LineIndex:
        """The index with documents (doc_id, text) added; a doc_id that it holds already is replaced. ``fresh``: it holds none of them."""
        new = self._new()
        if self.path is None:
            counts = new._write("counts", self._counted(new._write("refs", self.references(docs))))
            new.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD_KEYS))
            new._write("filters", new._build(counts))
            return new
        base = self if fresh else self.delete(docs)
        batch = self._new()
        refs = batch._write("refs", base.references(docs))
        new._write("refs", base.table("refs").unionByName(refs))
        asked = base._ask(self._counted(refs))
        asked.write.parquet(f"{batch.path}/asked")
        asked = self.spark.read.parquet(f"{batch.path}/asked")
        known, old = asked.where("known"), base.table("counts")
        met = known.select("key", F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
        merged = old.join(met, "key", "left").select("key", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
        false_hits = known.join(old.select("key"), "key", "left_anti")
        first = asked.where("not known").unionByName(false_hits).drop("known")
        counts = new._write("counts", merged.unionByName(first))
        if (keys := counts.count()) > SHARD_KEYS * self.shards:
            new.shards = 2 * -(-keys // SHARD_KEYS)
            new._write("filters", new._build(counts))
        else:
            new._write("filters", new._changed(base, first, delete=False))
        batch.drop()
        if base is not self:
            base.drop()
        return new

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without these doc_ids; their texts are not needed."""
        if self.path is None:
            return self
        new, refs = self._new(), self.table("refs")
        gone = docs.select(_doc("doc_id").alias("doc_id")).distinct()
        left = new._write("refs", refs.join(gone, "doc_id", "left_anti").select(*refs.columns))
        touched = refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        kept = self.table("counts").join(touched, "key", "left_anti")
        counts = new._write("counts", kept.unionByName(self._counted(left.join(touched, "key", "left_semi"))))
        lost = self.table("counts").join(counts.select("key"), "key", "left_anti")
        new._write("filters", new._changed(self, lost, delete=True))
        return new

    def _by_shard(self, keys: DataFrame):
        return keys.withColumn("shard", F.pmod(F.hash("key"), F.lit(self.shards)).cast("int")).groupBy("shard")

    def _ask(self, counts: DataFrame) -> DataFrame:
        """``known``: whether the filter of the key's shard may hold it."""

        def ask(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            known = Cuckoo.from_bytes(b["filter"].iloc[0]).contains(a["key"].tolist()) if len(b) else np.zeros(len(a), bool)
            return a.drop(columns="shard").assign(known=known)

        return self._by_shard(counts).cogroup(self.table("filters").groupBy("shard")).applyInPandas(ask, self.TABLES["counts"] + ", known boolean")

    def _build(self, counts: DataFrame) -> DataFrame:
        shards = self.shards

        def build(a: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo(2 * len(a))
            f.insert(a["key"].tolist())
            return pd.DataFrame({"shard": [int(a["shard"].iloc[0])], "shards": [shards], "filter": [f.to_bytes()]})

        return self._by_shard(counts.select("key")).applyInPandas(build, self.TABLES["filters"])

    def _changed(self, base: LineIndex, keys: DataFrame, delete: bool) -> DataFrame:
        """The filters of ``base`` with keys put in or taken out; a shard that outgrows its filter gets a new one from the exact keys."""

        shards = self.shards

        def change(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            f = Cuckoo.from_bytes(b["filter"].iloc[0]) if len(b) else Cuckoo(2 * len(a))
            (f.delete if delete else f.insert)(a["key"].tolist())
            return pd.DataFrame({"shard": [int((a if len(a) else b)["shard"].iloc[0])], "shards": [shards], "filter": [f.to_bytes()]})

        filters = base.table("filters")
        keys = keys.select("key")
        if delete:
            return self._by_shard(keys).cogroup(filters.groupBy("shard")).applyInPandas(change, self.TABLES["filters"])
        sizes = self._by_shard(self.table("counts")).agg(F.count("*").alias("k"))
        cells = filters.select("shard", (F.length("filter") / 2 - 12).alias("cells"))
        full = sizes.join(cells, "shard").where(F.col("k") > F.col("cells") * (Cuckoo.LOAD * 0.9)).select("shard")
        shard = F.pmod(F.hash("key"), F.lit(self.shards)).cast("int")
        grown = self._build(self.table("counts").withColumn("shard", shard).join(full, "shard", "left_semi"))
        stay = self._by_shard(keys.withColumn("shard", shard).join(full, "shard", "left_anti").select("key"))
        return grown.unionByName(stay.cogroup(filters.join(full, "shard", "left_anti").groupBy("shard")).applyInPandas(change, self.TABLES["filters"]))

    def frequent(self) -> DataFrame:
        """(key, last_doc) of the keys that lose lines."""
        return self.table("counts").where(F.col("n_docs") >= self.min_docs).select("key", "last_doc")

    def drop_lines(self, docs: DataFrame) -> DataFrame:
        """(row, n_lines, n_dropped): ``row`` has the columns of ``docs`` with the text that is left.

        Only texts that lose a line pass through Python.
        """
        bounded_batches(self.spark)
        lost = self.table("refs").join(self.frequent(), "key").where(F.col("doc_id") != F.col("last_doc"))
        lost = lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost"))
        least = self.min_chars

        @F.pandas_udf("text string, dropped long")
        def cut(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
            out = []
            for t, gone in zip(text, lost):
                if gone is None:
                    out.append((None, 0))
                    continue
                gone = set(map(bytes, gone))
                lines = (t or "").split("\n")
                kept = [x for x in lines if len(k := x.strip(SPACE_CHARS)) < least or hashlib.sha256(k.translate(_LOWER).encode()).digest() not in gone]
                out.append(("\n".join(kept), len(lines) - len(kept)))
            return pd.DataFrame(out, columns=["text", "dropped"])

        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        j = rows.join(lost, F.coalesce("row.doc_id", F.lit(_NULL_DOC)) == F.col("doc_id"), "left")
        j = j.withColumn("cut", cut(F.when(F.col("lost").isNotNull(), F.col("row.text")), "lost"))
        left = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(F.col("cut.text"))
        return j.select(
            F.struct(*[F.col("row")[c].alias(c) if c != "text" else left.alias("text") for c in docs.columns]).alias("row"),
            F.size(lines_of(F.col("row.text"))).cast("long").alias("n_lines"),
            F.coalesce("cut.dropped", F.lit(0)).cast("long").alias("n_dropped"),
        )


_LOWER = {i: i + 32 for i in range(65, 91)}


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All documents through an index made in ``BATCHES`` inserts, dealt by doc_id; see ``LineIndex.drop_lines``."""
    index = LineIndex(docs.sparkSession, None, min_chars, min_docs)
    for i in range(BATCHES):
        before, index = index, index.insert(docs.where(F.pmod(F.hash(docs["doc_id"]), F.lit(BATCHES)) == i), fresh=True)
        before.drop()
    return index.drop_lines(docs)
