"""Licence digests and revisit resolution."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm.licence_texts import EQUIVALENT, KNOWN
from loomgraph.llm.licences import canonical_text, known_licences, scan_licences
from loomgraph.llm.revisit import canonical_url, captures, resolve_revisits


def licence_of(spark, *texts, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, digest string, license_id string")
    return [r["license_id"] for r in scan_licences(docs, known_licences(spark), **options).orderBy("doc_id").collect()]


def test_known_texts(spark):
    assert licence_of(spark, *[t for _, t in KNOWN]) == [i for i, _ in KNOWN]


def test_variants(spark):
    mit = KNOWN[0][1]
    shouting = mit.upper().replace("COPYRIGHT (C) <YEAR> <COPYRIGHT HOLDERS>", "Copyright © 1999, 2004 Somebody Else")
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit).replace('"', "“").replace(",", " ,")
    spelled = mit.replace("License", "Licence").replace("sublicense", "sub-license")
    commented = "\n".join(" * " + line for line in mit.split("\n"))
    assert licence_of(spark, shouting, wrapped, spelled, commented) == ["MIT"] * 4
    assert licence_of(spark, mit + " Except on Sundays.", "MIT", None, "", "!!! ...", "x" * 2_000_000) == [None] * 6


def test_a_notice_is_no_licence(spark):
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    assert licence_of(spark, *notices, *[f"some text\n{n}" for n in notices]) == [None] * 8


def test_the_common_licences_are_known(spark):
    wanted = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "Zlib", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"}
    texts = dict(KNOWN)
    assert wanted <= set(texts)
    rewrapped = {i: re.sub(r"\blicense\b", "licence", texts[i]).replace("\n", "\r\n   ").upper() for i in ("Apache-2.0", "GPL-3.0", "MPL-2.0")}
    assert licence_of(spark, *rewrapped.values()) == list(rewrapped)


def test_words_are_looked_up_like_replaced_spellings(spark):
    """One pass over the words gives what replacing one spelling after the other gives."""
    words = " ".join(x for pair in EQUIVALENT for x in (pair[0], "between", pair[1], pair[0], pair[0])) + " per  cent, sub-licence"
    want = " " + re.sub("[^a-z]+", "  ", words) + " "
    for spelling, standard in EQUIVALENT:
        want = want.replace(" " + spelling.replace(" ", "  ") + " ", " " + standard.replace(" ", "  ") + " ")
    assert spark.range(1).select(canonical_text(F.lit(words))).first()[0] == want


def test_copyright_line_inside_a_sentence_stays(spark):
    text = "THE AUTHORS OR\ncopyright holders be liable"
    assert "copyright  holders" in spark.range(1).select(canonical_text(F.lit(text))).first()[0]


def test_many_known(spark, monkeypatch):
    from loomgraph.llm import licences

    monkeypatch.setattr(licences, "BROADCAST_DIGESTS", 0)
    assert licence_of(spark, *[t for _, t in KNOWN]) == [i for i, _ in KNOWN]


def test_scan_is_native_and_keeps_rows(spark):
    mit = KNOWN[0][1]
    docs = spark.createDataFrame([(None, mit), (1, mit.upper()), (1, mit.upper())], "doc_id long, text string")
    found = scan_licences(docs, known_licences(spark))
    assert [r["license_id"] for r in found.collect()] == ["MIT"] * 3
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", ""))
    assert scan_licences(docs.limit(0), known_licences(spark)).count() == 0
    assert scan_licences(docs, known_licences(spark).limit(0)).where("license_id is null").count() == 3


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/A/b/?utm_source=x&b=2&a=1#frag", "example.com/A/b?a=1&b=2"), ("https://m.example.com/", "m.example.com"), ("https://u:p@h.org:443/x", "h.org/x"), ("http://h.org:443/x", "h.org:443/x"), ("HTTPS://h.org:80", "h.org:80"),
        ("//h.org/x?ref=1", "h.org/x?ref=1"), ("h.org:80/x?gclid=1", "h.org/x"), ("h.org/x?q=#a", "h.org/x?q="), ("", ""), (None, None), ("http://h.org?b&a", "h.org?a&b"), ("http://h.org/x?Utm_Id=1&reference=2", "h.org/x?reference=2"),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


RECORDS = "record_id long, url string, ts long, full boolean, etag string, last_modified string, digest string, headers map<string,string>, status string, last string"


def brute(rows):
    """rows: tuples of RECORDS with canonical URLs."""
    out = {}
    for i, url, ts, full, etag, modified, digest, _, *_ in rows:
        if full:
            continue
        earlier = [r for r in rows if r[3] and r[1] == url and url is not None and ts is not None and r[2] is not None and r[2] < ts]
        if not earlier:
            out[i] = (None, "no_prior")
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        strip = lambda t: t and re.sub("^W/", "", t)
        for mine, other in ((strip(etag), strip(best[4])), (modified, best[5]), (digest, best[6])):
            if mine is not None and other is not None:
                out[i] = (best[0], "resolved" if mine == other else "mismatch")
                break
        else:
            out[i] = (best[0], "unverified")
    return out


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_as_of(spark, ranges):
    rows = []
    for i in range(400):
        h = i * 7919 % 101
        url = None if h == 0 else "hot" if h < 60 else f"u{h % 9}"
        ts = None if h == 1 else (i * 37) % 150
        rows.append((i, url, ts, h % 3 != 0 if h != 2 else None, [None, "t1", "W/t1", "t2"][h % 4], [None, "m1", "m2"][h % 3], [None, "d1"][h % 2], {"A": "1", "ETag": "x"} if h % 5 else None, "s", "l"))
    got = {r["record_id"]: (r["response_id"], r["status"]) for r in resolve_revisits(spark.createDataFrame(rows, RECORDS), ranges=ranges).collect()}
    assert got == brute(rows)


def test_headers(spark):
    rows = [
        (1, "u", 1, True, "e", None, None, {"Content-Type": "a", "Cache-Control": "old", "cache-control": "older", "X": "1"}, "s", "l"),
        (2, "u", 2, False, "e", None, None, {"CACHE-CONTROL": "new", "Date": "d", "Content-Type": "evil", "x": "2"}, "s", "l"),
        (3, "u", 2, False, "f", None, None, {"Date": "d"}, "s", "l"),
    ]
    got = {r["record_id"]: r for r in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got[2]["headers"] == {"content-type": "a", "cache-control": "new", "x": "1", "date": "d"}
    assert got[3]["headers"] is None
    assert resolve_revisits(spark.createDataFrame(rows, RECORDS).limit(0)).count() == 0


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "x"), (1, "http://a/b", "x"), (2, None, None), (None, "http://a/b", "x")], "page_id long, url string, html string")
    got = resolve_revisits(captures(pages)).collect()
    assert len(got) == 4
    assert {r["status"] for r in got if r["record_id"] is None or r["record_id"] == 5} == {"no_prior"}
