"""Licence scan: canonical digests of whole texts, joined with those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import EQUIVALENT, KNOWN

#: Most known digests that are broadcast.
BROADCAST_DIGESTS = 100_000

#: A line that states a copyright or reserves rights, in lower case.
COPYRIGHT_LINE = r"^[^a-z0-9©\n]*((copyright|\(c\)|©)[ \t]*(©|\(c\)|[0-9]{4}|<|\[|:|by )[^\n]*|all rights reserved\.?[ \t]*\r?)$"


def canonical_text(text: Column) -> Column:
    """Case, punctuation, copyright lines and equivalent spellings normalised; words have two spaces between them, one at either end.

    Single words are looked up one by one, in one pass; the few spellings of several words are
    replaced after that.
    """
    lines = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT_LINE, "")
    words = F.split(F.trim(F.regexp_replace(lines, "[^\\p{L}\\p{N}]+", " ")), " ")
    standard = F.create_map(*[F.lit(x) for pair in EQUIVALENT if " " not in pair[0] for x in pair])
    out = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.coalesce(standard[w], w)), "  "), F.lit(" "))
    for spelling, other in EQUIVALENT:
        if " " in spelling:
            out = F.replace(out, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    return out


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null for a null text and for one without letters and digits."""
    canonical = canonical_text(text)
    return F.when(F.length(F.trim(canonical)) > 0, F.sha2(canonical, 256))


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences that come with the package: MIT, ISC, the BSD family, Apache, GPL, LGPL, MPL and others."""
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def scan_licences(docs: DataFrame, known: DataFrame, n_known: int | None = None) -> DataFrame:
    """The licence that each text as a whole is, if it is a known one.

    docs: doc_id and text, known: license_id and text; further columns, whatever their names, are
    not read.  Returns one row for each row of docs: doc_id, digest, license_id (null: none known;
    ids of licences with the same canonical text are joined by ";").  Null and empty texts, and
    texts without letters and digits, have a null digest and no licence.  Rows alike give rows alike,
    with or without doc_id; texts are read whole, however long; an empty table gives no rows.

    Built-in functions only.  Up to BROADCAST_DIGESTS known digests are broadcast, so that texts
    that many documents share meet no single task; more are joined by a shuffle.
    """
    if n_known is None:
        n_known = known.count()
    digests = known.select(F.col("license_id").cast("string").alias("i"), canonical_digest(F.col("text").cast("string")).alias("known_digest"))
    digests = digests.where("known_digest is not null and i is not null").groupBy("known_digest").agg(F.array_join(F.array_sort(F.collect_set("i")), ";").alias("license_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_digest(F.col("text").cast("string")).alias("digest"))
    side = F.broadcast(digests) if n_known <= BROADCAST_DIGESTS else digests
    return texts.join(side, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license_id")
