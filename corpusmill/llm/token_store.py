"""Token ids in files of directly addressable codes.

An id is split into chunks of ``BITS`` bits, lowest first. Level k holds the k-th chunk of
every id that has one, and one bit per chunk that says whether the id goes on at the
next level. A rank directory holds the count of set bits before every ``BLOCK`` bits, so
that the place of an id's next chunk is one rank away: any id is read without decoding
others.

A shard file::

    magic "DACS1\\0", u16 levels, u32 documents, u64 ids
    i64 doc_id per document, u64 first id per document (counted in the shard)
    per level: u64 chunks, the chunks (u8 each), the bitmap (u8, low bit first), the directory (u32)

all little-endian. Shards follow ascending doc_id. ``encode_documents`` deals documents to ranges of
doc_id, of which the borders are quantiles of the ids alone, and each task writes its ranges in order
as shards of bounded size through the shared folder's file system, first under another name
and then renamed, so that an attempt that is repeated leaves one whole file. The manifest is
one row per shard.

Cases: a null text is an empty one (its end id only). Documents with equal doc_id go in order of
their ids' bytes, and a doc_id that fills several ranges is dealt to them by the first of these; a null doc_id is stored as the smallest number and read back as null, so
it comes first. Extra columns are not carried.
An empty table writes no shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, own, shared_dir

BITS, BLOCK, MAGIC = 8, 512, b"DACS1\0"
#: Stands for a null doc_id.
NULL_DOC = -(2**63)
#: Most ids in a shard, unless one document has more.
SHARD_IDS = 4_000_000


class Level:
    """Chunks, continuation bits and rank directory of one level."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, goes_on: np.ndarray) -> Level:
        sums = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks = np.zeros(len(sums), np.uint32)
        np.cumsum(sums[:-1], out=ranks[1:])
        return cls(chunks.astype(np.uint8), np.packbits(goes_on, bitorder="little"), ranks)

    def bit(self, i: int) -> bool:
        return bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before i."""
        block = i // BLOCK
        lo, whole = block * BLOCK // 8, i >> 3
        n = int(self.ranks[block]) + int(np.bitwise_count(self.bitmap[lo:whole]).sum())
        return n + int(self.bitmap[whole] & ((1 << (i & 7)) - 1)).bit_count()


class Shard:
    """A shard in memory; reads any id or any document's ids."""

    def __init__(self, doc_ids: np.ndarray, starts: np.ndarray, n: int, levels: list[Level]):
        self.doc_ids, self.starts, self.n, self.levels = doc_ids, starts, n, levels

    @classmethod
    def build(cls, doc_ids: Iterable[int], ids: list[np.ndarray]) -> Shard:
        sizes = np.fromiter(map(len, ids), np.uint64, len(ids))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32)
        starts = np.zeros(len(ids), np.uint64)
        np.cumsum(sizes[:-1], out=starts[1:])
        levels, rest = [], flat
        while len(rest):
            on = rest >> BITS > 0
            levels.append(Level.of(rest & ((1 << BITS) - 1), on))
            rest = rest[on] >> BITS
        return cls(np.asarray(list(doc_ids), np.int64), starts, len(flat), levels)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<HIQ", len(self.levels), len(self.doc_ids), self.n), self.doc_ids.astype("<i8").tobytes(), self.starts.astype("<u8").tobytes()]
        for x in self.levels:
            out += [struct.pack("<Q", len(x.chunks)), x.chunks.tobytes(), x.bitmap.tobytes(), x.ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:6] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        n_levels, docs, n = struct.unpack_from("<HIQ", data, 6)
        at = 20
        take = lambda kind, k: np.frombuffer(data, kind, k, at)
        doc_ids = take("<i8", docs)
        at += 8 * docs
        starts = take("<u8", docs)
        at += 8 * docs
        levels = []
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, k in (("u1", m), ("u1", -(-m // 8)), ("<u4", -(-m // BLOCK))):
                parts.append(take(kind, k))
                at += parts[-1].nbytes
            levels.append(Level(*parts))
        return cls(doc_ids, starts, n, levels)

    def __getitem__(self, i: int) -> int:
        """The id at position i, by a rank for each level it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for x in self.levels:
            value |= int(x.chunks[i]) << shift
            if not x.bit(i):
                return value
            i, shift = x.rank(i), shift + BITS
        raise ValueError("a code goes on past the last level")

    def all(self) -> np.ndarray:
        """Every id of the shard, level by level."""
        if not self.levels:
            return np.zeros(0, np.uint32)
        value = None
        for x in reversed(self.levels):
            here = x.chunks.astype(np.uint32)
            if value is not None:
                here[np.unpackbits(x.bitmap, count=len(here), bitorder="little").view(bool)] |= value << BITS
            value = here
        return value


#: The normalizer and pre-tokenizer by which a text is its pieces between white space, lower-cased.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: Punctuation that is encoded apart from the letters before it.
TAIL = ".,!?%&$#*;:|"


def wordwise(path: str) -> bool:
    """Whether the tokenizers file drops white space, never matches across it and ignores case, and no added token is letters and ``TAIL`` alone."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    plain = all(not x["normalized"] and not any(c.isspace() for c in x["content"]) and any(not c.isalpha() and c not in TAIL for c in x["content"]) for x in told["added_tokens"])
    return plain and told.get("truncation") is None and told.get("padding") is None and all(told[k] == v for k, v in WORDWISE.items())


class WordEncoder:
    """Ids of whole texts by a tokenizers file, remembering the ids of pieces between white space.

    That is for files that are ``wordwise``; by any other, texts are encoded whole. Arrow splits a batch
    and numbers its distinct pieces, so that each is looked up once a batch, and joins their ids. A piece
    that is letters below U+0130 and then punctuation of ``TAIL`` is encoded as both parts; any other as
    it stands. Such letters are lower-cased and one pre-token, so they go to the file's model itself,
    at about a third of the cost of the library's whole way; the rest goes to the library in calls of 10,000.
    Texts with U+001C to U+001F, which only Python and Arrow count as space, are encoded whole.
    """

    MOST = 700_000

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.lib, self.kind, self.wordwise = Tokenizer.from_file(path), kind, wordwise(path)
        self.known: dict[str, bytes] = {}
        if self.wordwise:
            self.model, byte_level = self.lib.model, self.lib.pre_tokenizer.pre_tokenize_str
            #: Letters as the pre-tokenizer hands their bytes to the model.
            self.spelt = {i: byte_level(chr(i))[0][0] for i in range(128, 0x130) if chr(i).isalpha()}

    def learn(self, new: list[str]) -> None:
        known = self.known
        made, words, others = [], set(), set()
        for piece in new:
            word = piece.rstrip(TAIL)
            if word.isalpha() and (word.isascii() or max(word) < "\u0130"):
                low, tail = word.lower(), piece[len(word) :]
                made.append((piece, low, tail))
                words.add(low)
                if tail:
                    others.add(tail)
            else:
                others.add(piece)
        units = list(others.difference(known))
        for i in range(0, len(units), 10_000):
            some = units[i : i + 10_000]
            e = self.lib.encode(some, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(some)) if e.ids else np.zeros(len(some), np.int64)
            self.remember(some, e.ids, np.cumsum(sizes))
        units, tokenize, spelt = list(words.difference(known)), self.model.tokenize, self.spelt
        for i in range(0, len(units), 10_000):
            some, ids, ends = units[i : i + 10_000], [], []
            for u in some:
                ids += [t.id for t in tokenize(u if u.isascii() else u.translate(spelt))]
                ends.append(len(ids))
            self.remember(some, ids, np.asarray(ends))
        known.update([(piece, known[low] + known[tail] if tail else known[low]) for piece, low, tail in made])

    def remember(self, units: list[str], ids: list[int], ends: np.ndarray) -> None:
        raw, at = np.asarray(ids, self.kind).tobytes(), (np.dtype(self.kind).itemsize * ends).tolist()
        self.known.update([(u, raw[x:y]) for u, x, y in zip(units, [0, *at], at)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of the encoder's kind."""
        if len(self.known) > self.MOST:
            self.known.clear()
        whole = [not self.wordwise or any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        got = [b""] * len(texts) if all(whole) else self.by_words(["" if w else t for w, t in zip(whole, texts)])
        return [np.asarray(self.lib.encode(t, add_special_tokens=False).ids, self.kind).tobytes() if w else x for w, t, x in zip(whole, texts, got)]

    def by_words(self, texts: list[str]) -> list[bytes]:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, pieces))
        if new := [p for p, x in zip(pieces, ids) if x is None]:
            self.learn(new)
            ids = [self.known[p] if x is None else x for p, x in zip(pieces, ids)]
        _, ends, joined = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        at = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(joined or b"")
        return [bytes(raw[x:y]) for x, y in zip(at, at[1:])]


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, kind: str) -> WordEncoder:
    """One for each worker process, kept across tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = WordEncoder(path, kind)
    return _ENCODERS[path, kind]


def _store(path: str):
    """The shared folder's file system and the path on it, for executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None, path: str, ranges: int | None = None) -> DataFrame:
    """Encode (doc_id, text), write the shards under ``path`` and return the manifest (file, range, part, n_docs, n_ids)."""
    spark = docs.sparkSession
    rows = own(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("doc_id"), "text")
    n = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Borders from the ids alone; at most n numbers come to the driver.
    borders = np.asarray(sorted(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("b")).first().b or []) if n > 1 else [], np.int64)
    from tokenizers import Tokenizer

    # Ids travel in two bytes where they fit.
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
    wide = np.dtype(kind).itemsize
    end = b"" if end_id is None else np.asarray([end_id], kind).tobytes()

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer, kind)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for lo, hi in _runs(texts, 2_000_000):
                got = [x + end for x in e.encode(texts[lo:hi])]
                doc = b["doc_id"].to_numpy(np.int64)[lo:hi]
                first = np.fromiter((int.from_bytes(x[:4].ljust(4, b"\0")) >> 1 for x in got), np.int64, len(got))
                yield pd.DataFrame({"doc_id": doc, "n": [len(x) // wide for x in got], "ids": got, "range": ranged(doc, first, borders)})

    coded = rows.mapInPandas(ids, "doc_id long, n long, ids binary, range long")
    dealt = coded.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "doc_id", "ids")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        store, base = _store(path)
        store.create_dir(base, recursive=True)
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        total, at, part, done = 0, None, 0, []

        def flush():
            nonlocal total, part
            if held:
                name = f"shard-{at:08d}-{part:06d}.dac"
                tmp = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(tmp) as f:
                    f.write(Shard.build(held_ids, held).to_bytes())
                store.move(tmp, f"{base}/{name}")
                done.append((name, at, part, len(held), total))
                held_ids.clear()
                held.clear()
                total, part = 0, part + 1

        for b in batches:
            for doc, k, x, r in zip(b["doc_id"], b["n"], b["ids"], b["range"]):
                if r != at:
                    flush()
                    at, part = r, 0
                elif total + k > SHARD_IDS:
                    flush()
                held_ids.append(int(doc))
                held.append(np.frombuffer(x, kind))
                total += int(k)
        flush()
        yield pd.DataFrame(done, columns=["file", "range", "part", "n_docs", "n_ids"])

    return materialize(dealt.mapInPandas(write, "file string, range long, part long, n_docs long, n_ids long"))


def ranged(doc: np.ndarray, first: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The range of each doc_id; one that is several borders is dealt to as many ranges by ``first`` (31 bits)."""
    lo, hi = np.searchsorted(borders, doc, "left"), np.searchsorted(borders, doc, "right")
    return np.where(hi - lo > 1, lo + 1 + ((hi - lo) * first >> 31), hi)


def _runs(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts all ids before it."""
    # ids before each shard: those of earlier ranges (one row for each range), then those of earlier parts
    ranges = manifest.groupBy("range").agg(F.sum("n_ids").alias("ids"))
    ranges = ranges.select("range", (F.sum("ids").over(W.orderBy("range")) - F.col("ids")).alias("earlier"))
    before = F.col("earlier") + F.sum("n_ids").over(W.partitionBy("range").orderBy("part")) - F.col("n_ids")
    shards = manifest.join(ranges, "range").select("file", before.alias("before"))
    schema = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                s = Shard.from_bytes(data)
                flat = s.all().astype("<u4")
                ends = np.append(s.starts[1:], s.n).astype(np.int64)
                starts = s.starts.astype(np.int64)
                yield pd.DataFrame(
                    {
                        "file": name.rsplit("/", 1)[-1],
                        "doc_id": s.doc_ids.astype(np.int64),
                        "start": starts,
                        "n_tokens": ends - starts,
                        "ids_crc32": np.fromiter((zlib.crc32(flat[x:y]) for x, y in zip(starts, ends)), np.int64, len(starts)),
                    }
                )

    if not manifest.limit(1).count():
        return spark.createDataFrame([], schema).drop("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(path)
    got = files.select("path", "content").mapInPandas(read, schema).join(shards, "file")
    return got.select(F.when(F.col("doc_id") != NULL_DOC, F.col("doc_id")).alias("doc_id"), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Write the documents' ids under the shared folder and read every one back."""
    path = f"{shared_dir(docs.sparkSession)}/dac"
    manifest = encode_documents(docs, tokenizer, end_id, path)
    return read_documents(docs.sparkSession, path, manifest)
