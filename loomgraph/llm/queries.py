"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated_words
from .langid import identify_languages
from .licences import known_licences, scan_licences
from .line_dedup import duplicate_lines
from .maxscore import integer_vectors, top_inner_products
from .minhash_dedup import near_duplicate_documents
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack_documents
from .pii import find_personal_data
from .revisit import captures, resolve_revisits
from .sharding import shard_documents

#: Vocabulary files of the tasks that need one.
PACKING_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LANGUAGE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of ``documents``: the first line of its component, and whether it is kept.

    Null texts have no lines; blank lines are kept; equal or near-equal lines of any length form one
    component whose least (doc_id, line_no) is kept, of rows repeated as a whole one copy; long
    texts are compared line by line; an empty table gives no rows.  Only doc_id and text are read.
    """
    return duplicate_lines(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document: where it lies in its document and in its sequence.

    Null and empty texts are the end id alone; repeated rows are documents of their own; a very
    long text takes many sequences; an empty table gives no rows.  Only doc_id and text are read.
    """
    pieces = pack_documents(_table(spark, sf_dir, "documents"), PACKING_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each revisit among the captures made of ``pages``: its response, status and merged headers.

    Null URLs have no prior response; of responses at one time the greatest record_id counts;
    repeated pages give repeated records; an empty table gives no rows.  page_id, url and html are read.
    """
    resolved = resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return resolved.select("record_id", "canonical_url", "ts", "response_id", "status", listed.alias("headers"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the digest of its canonical text, and the licence that it is as a whole, if any.

    Null and empty texts, and texts without letters and digits, have neither; rows alike give rows
    alike; texts are read whole; an empty table gives no rows.  Only doc_id and text are read.
    """
    return scan_licences(_table(spark, sf_dir, "documents"), known_licences(spark))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of each vector whose vec_id is divisible by 100, ties to smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part; of a repeated query
    one copy is asked; repeated vectors are candidates of their own; an empty table gives no rows.
    """
    vectors = integer_vectors(_table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, vectors.where("id % 100 = 0"), k=10)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans.

    A null text is empty and has none; rows alike give rows alike; texts are read whole; spans that
    begin together are listed by kind; an empty table gives no rows.  Only doc_id and text are read.
    """
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its shard of 40 and its slot there, by the law ``bytes``.

    A null text has size 16 and crc32 0; documents of equal text stay together unless they exceed a
    shard; slots of equal rows are in any order; an empty table gives no rows.  Only doc_id and text are read.
    """
    placed = shard_documents(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: held_out, its predicted language and the posterior.

    Null texts, and those without a letter, are und with score 0; ties go to the first language in
    order; rows alike are judged alike; texts are scored whole; an empty table gives no rows.
    """
    return identify_languages(_table(spark, sf_dir, "documents"), LANGUAGE_VOCABULARY)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the size of its set of 2-word shingles, its component and whether it names it.

    Null texts and those without words have no shingles and no links; a null doc_id names no
    component; repeated rows share theirs; texts are compared whole; an empty table gives no rows.
    """
    return near_duplicate_documents(_table(spark, sf_dir, "documents"), shingle_words=2).drop("first")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its words, those hit by benchmark windows, and the items' digest.

    Null texts have no words; an item of fewer than ten words is one window; rows alike give rows
    alike; texts are read whole; an empty table of documents gives no rows, one of items no hits.
    """
    found = contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_packing, op3_revisits, op4_licence_scan, op5_maxscore,
        op6_personal_data, op7_sharding, op8_language_id, op9_minhash_dedup, op10_decontamination,
    )
}
