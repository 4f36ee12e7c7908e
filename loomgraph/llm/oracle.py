"""DuckDB SQL of the queries that SQL can express."""

from .licence_texts import EQUIVALENT, KNOWN
from .licences import COPYRIGHT_LINE
from .revisit import TRACKING


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences() -> str:
    canonical = f"""concat(' ', trim(regexp_replace(regexp_replace(lower(text), {_quoted("(?m)" + COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')), ' ')"""
    for spelling, standard in EQUIVALENT:
        canonical = f"replace({canonical}, {_quoted(' ' + spelling.replace(' ', '  ') + ' ')}, {_quoted(' ' + standard.replace(' ', '  ') + ' ')})"
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    return f"""
        WITH known(license_id, text) AS (VALUES {known}),
        k AS (SELECT license_id, {canonical} AS c FROM known),
        d AS (SELECT sha256(c) AS digest, string_agg(DISTINCT license_id, ';' ORDER BY license_id) AS license_id FROM k GROUP BY 1),
        t AS (SELECT doc_id, {canonical} AS c FROM documents)
        SELECT t.doc_id, CASE WHEN length(trim(c)) > 0 THEN sha256(c) END AS digest, d.license_id
        FROM t LEFT JOIN d ON length(trim(c)) > 0 AND sha256(c) = d.digest"""


def _revisits() -> str:
    plain = "regexp_replace(trim(url), '#.*$', '')"
    bare = f"regexp_replace({plain}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#@]*@)?', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^www[0-9]*\\.', ''), CASE WHEN starts_with(lower({plain}), 'https:') THEN ':443$' ELSE ':80$' END, '')"
    host = f"regexp_replace({host}, '\\.$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: length(p) > 0 AND NOT regexp_full_match(lower(p), '({TRACKING})(=.*)?')))"
    canonical = f"concat({host}, {path}, CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END)"
    return f"""
        WITH page AS (SELECT page_id, url, md5(coalesce(html, '')) AS m, page_id * 7919 % 1009 AS h FROM pages),
        answer AS (SELECT page_id * 2 AS record_id, {canonical} AS c, page_id * 100 AS ts, concat('"', m, '"') AS etag, concat('day ', page_id) AS modified, m, h FROM page),
        again AS (
            SELECT page_id * 2 + 1 AS record_id, {canonical} AS c, page_id * 100 + CASE WHEN h % 5 = 0 THEN -50 ELSE h % 1000 + 1 END AS ts,
                CASE WHEN h % 11 <> 0 THEN concat('"', CASE WHEN h % 7 = 0 THEN 'x' ELSE '' END, m, '"') END AS etag, h
            FROM page),
        matched AS (
            SELECT r.record_id, r.c, r.ts, r.etag, r.h, a.record_id AS response_id, a.etag AS a_etag, a.h AS a_h
            FROM again r LEFT JOIN answer a ON a.c = r.c AND a.ts < r.ts
            QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY a.ts DESC, a.record_id DESC) = 1),
        said AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_prior' WHEN etag IS NULL THEN 'unverified' WHEN etag = a_etag THEN 'resolved' ELSE 'mismatch' END AS status FROM matched)
        SELECT record_id, c AS canonical_url, ts, response_id, status,
            CASE WHEN status = 'resolved' THEN concat('cache-control=max-age=', h % 100, ';content-type=text/html;etag=', a_etag, ';expires=t', h % 9, ';server=s', a_h % 4) END AS headers
        FROM said"""


_SEARCH = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_NEAR = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, list_distinct(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) END) AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM g),
    t AS (SELECT doc_id, unnest(s) AS x FROM g),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
    SELECT n.doc_id, cast(n.n AS BIGINT) AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
    FROM n JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m ON m.doc_id = n.doc_id"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_CONTAMINATED = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + 9], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0) z),
    sizes AS (SELECT DISTINCT k FROM i),
    o AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k) z),
    h AS (SELECT o.doc_id, o.p, o.k, i.item_id FROM o JOIN i ON i.k = o.k AND i.x = o.x),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM h) z) y GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS s FROM h) z GROUP BY doc_id)
    SELECT d.doc_id, len(d.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_revisits": _revisits(),
    "op4_licence_scan": _licences(),
    "op5_maxscore": _SEARCH,
    "op9_minhash_dedup": _NEAR,
    "op10_decontamination": _CONTAMINATED,
}
