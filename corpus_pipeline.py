"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.cluster import checkpointed
from loomgraph.llm.decontaminate import without_contaminated
from loomgraph.llm.langid import in_known_language
from loomgraph.llm.line_dedup import without_duplicate_lines
from loomgraph.llm.minhash_dedup import without_near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.queries import LANGUAGE_VOCABULARY, PACKING_VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, no clear language, or unlike every learned one.

    Null and empty texts go; each row is judged by its own text, whatever its doc_id; rows alike
    stay or go together; texts are scored whole; an empty table stays empty; other columns pass.
    """
    return in_known_language(docs, LANGUAGE_VOCABULARY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike, of any length, one stays: that of the least doc_id and line; documents left without any line go.

    Null and blank texts pass; rows are told apart by doc_id and text (null doc_ids come last); of
    rows equal in both one stays; an empty table stays empty; other columns pass, n_chars follows.
    """
    return without_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near duplicates (five-word shingles, similarity 0.8) that of the least doc_id stays.

    Null texts and those without words pass; rows are told apart by doc_id and text (null doc_ids
    come last), of rows equal in both one stays; texts are compared whole; an empty table stays empty.
    """
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words, or a whole shorter item, of the benchmark go.

    Null and empty texts pass; each row is judged by its own whole text, whatever its doc_id; an
    empty benchmark takes none; an empty table stays empty; other columns pass.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as sequences of at most 4096 tokens, one row for each piece.

    Null and empty texts are the end id alone; repeated rows are documents of their own; a very
    long text takes many sequences; an empty table gives no rows.
    """
    pieces = pack_documents(docs, PACKING_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and tokenizer ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
