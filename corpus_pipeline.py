"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; the
first four return the columns of ``documents``. Between stages the documents are written as Parquet
under the shared folder and read again.

Every stage takes documents with any further columns and passes these on, but for the last, which returns doc_id and ids. Null and empty texts fail
the quality rules' base (fewer than 20 words), so they go in the first stage; called by itself, each later stage keeps
them. Rows with an equal doc_id are judged one by one for quality and benchmark items, are one document in line dedup and
near-dedup (all of them stay or go), and each have their ids. A row with a null doc_id is never a near copy. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, line_dedup, minhash, pieces, quality_rules
from corpusmill.llm.common import materialize

#: A SentencePiece model file; None: the 32k pieces of the public tokenizers package.
MODEL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned decision list keep."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules).where("kept").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents share, but for the last of these; n_chars follows."""
    left = line_dedup.dedup_lines(docs).select("row.*")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else left


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8."""
    near = minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(near, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    found = decontam.match_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept document, and whether they decode to its text."""
    if MODEL is None:
        import public_tokenizers

    return pieces.encode_documents(docs, MODEL or public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("sentencepiece", encode),
]

#: SQL can't express the learned rules, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
