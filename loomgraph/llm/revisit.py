"""Not-modified revisits of web archives: as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of capture times; a URL's captures within one range are ordered in one task.
RANGES = 64
#: Query parameters that don't tell pages apart; headers that a 304 response may update.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|sessionid|phpsessid|jsessionid"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """One form for the spellings of a URL.

    Scheme, user, "www" label, the scheme's default port, fragment, trailing slash and tracking
    parameters go; the host is lower-cased and the other parameters are sorted.  Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*\\.", "")
    # a port goes where it is that of the scheme; without a scheme it is taken for http
    port = F.when(F.lower(plain).startswith("https:"), F.lit(":443")).otherwise(F.lit(":80"))
    host = F.regexp_replace(F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host), "\\.$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&", -1)
    kept = F.array_sort(F.filter(query, lambda p: (F.length(p) > 0) & ~F.lower(p).rlike(f"^({TRACKING})(=.*)?$")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _headers(headers: Column) -> Column:
    """Header names in lower case; of names that are then equal, the last one's value."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda f: f["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def resolve_revisits(records: DataFrame, *, ranges: int = RANGES) -> DataFrame:
    """What each revisit record stands for.

    records: record_id long, url string, ts long, full boolean (a full response; null or false: a
    revisit), etag, last_modified and digest string, headers map<string,string>; further columns,
    whatever their names, are not read.  A revisit's response is the full one of its canonical URL
    with the greatest (ts, record_id) at a strictly earlier ts.  The first validator that both have
    decides, in the order entity tag (weakly compared), modification time, payload digest.

    Returns one row for each revisit: record_id, canonical_url, ts, response_id and
    - status "no_prior": there is no such response, or url or ts is null;
    - status "mismatch": the validators differ; "unverified": they have none in common;
    - status "resolved", with headers: the response's, updated by those of the revisit that a 304
      response may update.  In the other cases response headers are null.

    Ties of response times go to the greater record_id; repeated rows are records of their own; an
    empty table gives no rows; null headers are none.

    As-of in two levels, so that no task orders all captures of one URL: only captures of one URL
    and range of capture times are ordered together; a range with revisits also gets the last
    response of the nearest earlier range that has one, found among the ranges' keys alone.
    """
    payload = ("record_id", "etag", "last_modified", "digest", "headers")
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"),
        F.coalesce(F.col("full").cast("boolean"), F.lit(False)).alias("full"), *[F.col(c).cast("string").alias(c) for c in ("etag", "last_modified", "digest")], _headers(F.col("headers")).alias("headers"),
    )
    cuts = records.agg(F.percentile_approx(F.col("ts").cast("long"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<bigint>")
    rows = rows.withColumn("range", F.when(F.col("ts").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("ts")))))
    response = F.struct(*payload)
    ends = rows.where("full and canonical_url is not null and ts is not null").groupBy("canonical_url", "range").agg(F.max_by(response, F.struct("ts", "record_id")).alias("last"))
    # (URL, range) pairs with responses or revisits, at most 2 * ranges + 2 rows of a URL: each gets the last response of the nearest earlier range
    keys = ends.select("canonical_url", "range", F.lit(True).alias("has")).unionByName(rows.where("not full and canonical_url is not null and ts is not null").select("canonical_url", "range", F.lit(False).alias("has")).distinct())
    before = keys.groupBy("canonical_url", "range").agg(F.max("has").alias("has"), F.min("has").alias("only"))
    before = before.selectExpr("canonical_url as url_", "range as range_", "not only as asked", "max(case when has then range end) over (partition by canonical_url order by range rows between unbounded preceding and 1 preceding) as from_").where("asked and from_ is not null")
    last = ends.select(F.col("canonical_url").alias("url__"), F.col("range").alias("range__"), F.col("last").alias("carried"))
    # payloads travel to the ranges that ask for them, no others
    carried = before.join(last, (F.col("url_") == F.col("url__")) & (F.col("from_") == F.col("range__"))).select("url_", "range_", "carried")
    inside = rows.withColumn("last", F.expr(f"last(case when full then struct({', '.join(payload)}) end, true) over (partition by canonical_url, range order by ts, full, record_id rows between unbounded preceding and current row)"))
    joined = inside.where("not full").join(carried, (F.col("canonical_url") == F.col("url_")) & (F.col("range") == F.col("range_")), "left")
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    joined = joined.withColumn("r", F.when(known, F.coalesce("last", "carried")))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(tag(F.col("etag")) == tag(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"), F.col("digest") == F.col("r.digest"))
    status = F.when(F.col("r").isNull(), "no_prior").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, _: ~F.map_contains_key(update, k)), update)
    out = joined.withColumn("status", status)
    return out.select("record_id", "canonical_url", "ts", F.col("r.record_id").alias("response_id"), "status", F.when(F.col("status") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of web pages: for each page a full response and a revisit.

    Times and validators are functions of page_id, url and html, by way of h = page_id * 7919 % 1009.
    The revisit asks for another spelling of the URL some time later, or, where 5 divides h,
    earlier; where 7 divides h its entity tag is another, and where 11 does it has no validators.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("md5"))
    page = page.withColumn("h", F.col("page_id") * 7919 % 1009)
    tag = F.concat(F.lit('"'), F.col("md5"), F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id"))
    answer = page.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 100).alias("ts"), F.lit(True).alias("full"), tag.alias("etag"), modified.alias("last_modified"), F.col("md5").alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.concat(F.lit("s"), F.col("h") % 4)).alias("headers"),
    )
    bare, changed = F.col("h") % 11 == 0, F.col("h") % 7 == 0
    seen = F.when(~bare, F.when(changed, F.concat(F.lit('"x'), F.col("md5"), F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag)))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=crawl#again"))
    again = page.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), other.alias("url"), (F.col("page_id") * 100 + F.when(F.col("h") % 5 == 0, -50).otherwise(F.col("h") % 1000 + 1)).alias("ts"), F.lit(False).alias("full"),
        seen.alias("etag"), F.when(~bare, modified).alias("last_modified"), F.when(~bare, F.col("md5")).alias("digest"),
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("h") % 100), F.lit("Expires"), F.concat(F.lit("t"), F.col("h") % 9), F.lit("Server"), F.lit("other")).alias("headers"),
    )
    return answer.unionByName(again)

