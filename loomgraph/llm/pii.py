"""Personal data in texts: fixed base rules, and a span classifier trained by weak supervision.

Labelers (shape, checksum or variety, gazetteer, context) vote for or against every candidate
span or abstain.  Expectation-maximisation over the counts of the vote patterns estimates how
reliable each labeler is; its posteriors are the soft labels on which the final classifier, a
logistic regression over features of the span and its context that no labeler sees (length,
character classes, the hashed word before it), is trained.  Whatever the corpus, the driver only
sees counts of distinct feature patterns, of which there are at most PATTERNS.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, map_arrow

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("shape", "check", "gazetteer", "context")
#: Length classes of a span, sets of character classes in it, buckets of the word before it (0: none).
LENGTHS, CLASSES, WORDS = 4, 8, 32
#: Patterns whose features are held at once.
AT_ONCE = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken as a whole: a match can't begin or end inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SPELLED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}([^\s,;\"']{6,}+)")
_KEY = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+")

#: Top-level domains, first digits of card issuers, prefixes of access keys, words before a span that speak for its kind, and words that speak against every kind.
DOMAINS = frozenset("com org net edu gov mil int info biz io co app dev de fr es it uk eu us ca au jp cn in br ru ch at nl be se no dk fi pl pt mx ar".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk_test_", "xoxb", "xoxp", "AIza", "glpat")
CUES = {
    "email": ("mail", "email", "contact", "write", "to", "from", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "ping", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "appelez", "llame"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "api-key", "credentials"),
}
AGAINST = ("version", "release", "isbn", "order", "page", "section", "chapter", "serial", "item", "no")
_WORD = re.compile(r"[A-Za-zÀ-ÿ_-]+")


def luhn(digits: str) -> bool:
    """The digits pass the mod-10 check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of the leftmost non-overlapping base matches of each kind."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        start = at
        if host:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = host.end()
            yield "email", start, end, True
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        yield "ip", *m.span(), _is_ip(m[0])
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            yield "card", *m.span(), _is_card(m[0])
    for m in _PHONE.finditer(text):
        yield "phone", *m.span(), 10 <= len(_digits(m[0])) <= 15


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _parts(text: str, kind: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Of a base match that failed its check: the groups of digits in it that would pass (the first ones), or the match itself."""
    groups = [(a + m.start(), a + m.end()) for m in re.finditer("[0-9]+", text[a:b])]
    if kind == "phone":
        digits = 0
        for start, end in groups:
            digits += end - start
            if digits >= 10:
                return [(kind, a, end)] if digits <= 15 else []
    if kind == "card":
        out, i = [], 0
        while i < len(groups):
            digits = 0
            for j in range(i, min(len(groups), i + 19)):
                digits += groups[j][1] - groups[j][0]
                if 14 <= digits <= 19 and _is_card(text[groups[i][0] : groups[j][1]]):
                    out.append((kind, groups[i][0], groups[j][1]))
                    i = j
                    break
                if digits > 19:
                    break
            i += 1
        return out or [(kind, a, b)]
    return [(kind, a, b)]


def candidates(text: str, base: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int]]:
    """Spans that the classifier decides on: what is in base matches that failed their check, and looser shapes."""
    found = [span for kind, a, b, passes in base if not passes for span in _parts(text, kind, a, b)]
    found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if " dot " in text or "(dot)" in text or "[dot]" in text:
        found += [("email", *m.span()) for m in _SPELLED_EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    found += [("secret", *m.span()) for m in _KEY.finditer(text) if any("0" <= c <= "9" for c in m[0]) and not m[0].isdigit()]
    kept, end = [], -1
    base_spans = [(a, b) for _, a, b, passes in base if passes]
    for kind, a, b in sorted(set(found), key=lambda s: (s[1], -s[2], s[0])):
        if a >= end and all(b <= x or a >= y for x, y in base_spans):
            kept.append((kind, a, b))
            end = b
    return kept


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, int, int, int]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing."""
    span = text[a:b]
    digits = _digits(span)
    before = [w.lower().strip("_-") for w in _WORD.findall(text[max(0, a - 32) : a])][-2:]
    context = 1 if any(w in CUES[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    if kind == "email":
        shape = 1 if "@" in span else 0
        tail = re.split(r"[^A-Za-z]+", span)[-1].lower()
        return shape, 1 if len(span) <= 254 else -1, 1 if tail in DOMAINS else -1, context
    if kind == "ip":
        parts = span.split(".")
        plain = all(len(p) == 1 or p[0] != "0" for p in parts)
        return 1 if plain else -1, 1 if _is_ip(span) else -1, -1 if parts[0] in ("0", "255") else 0, context
    if kind == "card":
        grouped = re.fullmatch(r"[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}", span)
        return 1 if grouped else -1, 1 if luhn(digits) and 12 <= len(digits) <= 19 else -1, 1 if digits.startswith(ISSUERS) else -1, context
    if kind == "phone":
        shape = 1 if re.fullmatch(r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,3}", span) else -1
        return shape, 1 if 9 <= len(digits) <= 15 and len(set(digits)) >= 4 else -1, 1 if span[0] == "+" or re.match(r"\(?[2-9]", span) else -1, context
    kinds = (any(c.isdigit() for c in span)) + any(c.islower() for c in span) + any(c.isupper() for c in span)
    shape = 1 if re.fullmatch(r"[A-Z0-9]{20}|(?:[0-9a-f]{2}){8,32}|[A-Za-z0-9_]{32,64}", span) and kinds >= 2 else 0
    return shape, 1 if len(set(span)) >= 8 else -1 if len(set(span)) < 5 else 0, 1 if span.startswith(KEY_PREFIXES) else 0, context


def _length_class(a: int, b: int) -> int:
    return min(LENGTHS - 1, (b - a) // 12)


def _classes(span: str) -> int:
    """Which of digits, capitals and small letters a span has."""
    return any("0" <= c <= "9" for c in span) + 2 * any("A" <= c <= "Z" for c in span) + 4 * any("a" <= c <= "z" for c in span)


def _word_bucket(text: str, a: int) -> int:
    """The last word among the 32 characters before a span, hashed."""
    words = _WORD.findall(text[max(0, a - 32) : a])
    return 1 + zlib.crc32(words[-1].lower().encode()) % (WORDS - 1) if words else 0


VOTES = len(KINDS) * 3 ** len(LABELERS)
PATTERNS = VOTES * LENGTHS * CLASSES * WORDS


def _code(kind: str, said: tuple[int, ...], length: int, classes: int = 0, word: int = 0) -> int:
    """One number for kind, votes, length class, character classes and the word before."""
    out = KINDS.index(kind)
    for v in said:
        out = out * 3 + v + 1
    return ((out * LENGTHS + length) * CLASSES + classes) * WORDS + word


def _votes_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind, and votes plus one, of each of the VOTES codes."""
    said = np.stack([codes // 3**j % 3 for j in reversed(range(len(LABELERS)))], axis=1)
    return codes // 3 ** len(LABELERS), said


def reliabilities(counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(P(labeler says v | private or not, and it speaks), posterior of each of the VOTES patterns) by expectation-maximisation.

    counts: how often each of PATTERNS codes occurs.  Each labeler is independent given the class;
    the share of private spans is estimated for each kind.  The start is the majority of votes.
    """
    counts = counts.reshape(VOTES, -1).sum(axis=1)
    kind, said_at = _votes_of(np.arange(VOTES))
    posterior = 1 / (1 + np.exp(-1.5 * (said_at - 1).sum(axis=1)))
    speaks = np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        share = np.array([((posterior * counts)[kind == k].sum() + 1) / (counts[kind == k].sum() + 2) for k in range(len(KINDS))])
        for c, weight in enumerate(((1 - posterior) * counts, posterior * counts)):
            for j in range(len(LABELERS)):
                prior = np.array([1.0, 0.0, 3.0]) if c else np.array([3.0, 0.0, 1.0])  # labelers do better than chance
                said = np.bincount(said_at[:, j], weight, 3) * [1, 0, 1] + prior
                speaks[c, j] = said / said.sum()
        speaks[:, :, 1] = 1.0  # to abstain says nothing
        logs = [np.log(speaks[c][np.arange(len(LABELERS)), said_at]).sum(axis=1) for c in (0, 1)]
        odds = np.log(share[kind] / (1 - share[kind])) + logs[1] - logs[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return speaks, posterior


def _features(codes: np.ndarray) -> np.ndarray:
    """One-hot features: kind, each labeler's vote, length class, and by kind the character classes and the word before."""
    word, rest = codes % WORDS, codes // WORDS
    classes, rest = rest % CLASSES, rest // CLASSES
    length, rest = rest % LENGTHS, rest // LENGTHS
    kind, said = _votes_of(rest)
    hot = [(kind, len(KINDS)), *((said[:, j], 3) for j in range(len(LABELERS))), (length, LENGTHS), (kind * CLASSES + classes, len(KINDS) * CLASSES), (kind * WORDS + word, len(KINDS) * WORDS)]
    out, at = np.zeros((len(codes), sum(n for _, n in hot))), 0
    for values, n in hot:
        out[np.arange(len(codes)), at + values] = 1
        at += n
    return out


def trained(counts: np.ndarray, steps: int = 100) -> np.ndarray:
    """Probability that a span of each code is private (0 for codes that don't occur): logistic regression on the EM's soft labels."""
    _, posterior = reliabilities(counts)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts))
    parts = [used[i : i + AT_ONCE] for i in range(0, len(used), AT_ONCE)]
    w = np.zeros(_features(used[:1]).shape[1])
    for _ in range(steps if parts else 0):
        slope, curve = 0.1 * w, 0.1 * np.eye(len(w))
        for part in parts:
            x, y, weight = _features(part), posterior[part // (PATTERNS // VOTES)], np.sqrt(counts[part])  # frequent patterns don't drown the others
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = slope + x.T @ ((p - y) * weight)
            curve = curve + (x * (p * (1 - p) * weight)[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    for part in parts:
        out[part] = 1 / (1 + np.exp(-np.clip(_features(part) @ w, -30, 30)))
    return out


def _code_of(text: str, kind: str, a: int, b: int) -> int:
    return _code(kind, votes(text, kind, a, b), _length_class(a, b), _classes(text[a:b]), _word_bucket(text, a))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = list(matches(text))
            sure = _ordered([s[:3] for s in base if s[3]])
            extra = candidates(text, base)
            codes = [_code_of(text, k, a, b) for k, a, b in [*sure, *extra]]
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in sure)
            out.append((
                *(sum(s[0] == k for s in sure) for k in KINDS[:4]),
                listed,
                [{"start": a, "kind": KINDS.index(k), "end": b, "code": c, "base": i < len(sure)} for i, ((k, a, b), c) in enumerate(zip([*sure, *extra], codes, strict=True))],
            ))
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int32()), ("base", pa.bool_())])
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(span)]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", "found"])


def find_personal_data(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Spans of personal data in every whole text.

    docs: doc_id and text (null: empty); further columns, whatever their names, are not read.
    Base spans (email, ip, card, phone) follow fixed rules and always stay.  The classifier adds
    spans of these kinds and of "secret" (access keys, passwords) that overlap no base span.

    Returns one row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone and base (the base
    spans), and spans (all); a list is "kind:start:end", by start and then kind, joined by commas,
    in code points, end exclusive.  A text without any has zeros and empty strings.  Texts are read
    whole, however long; rows alike give rows alike, with or without doc_id; spans that tie are
    listed by kind; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = ", ".join(f"n_{k} long" for k in KINDS[:4])
    found = checkpointed(map_arrow(texts, _extract, f"doc_id long, {numbers}, base string, found array<struct<start:long,kind:int,end:long,code:int,base:boolean>>"))
    counts = np.zeros(PATTERNS)
    for row in found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect():
        counts[row["code"]] = row["count"]
    private = [int(c) for c in np.flatnonzero((trained(counts) >= least) & (counts > 0))]
    names = F.array(*[F.lit(k) for k in KINDS])
    taken = F.array_sort(F.filter("found", lambda s: s["base"] | F.array_contains(F.lit(private).cast("array<int>"), s["code"])))
    listed = F.array_join(F.transform(taken, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", listed.alias("spans"))


def base_digest(base: str) -> str:
    """What the query's base_sha256 holds for a list of base spans."""
    return hashlib.sha256(base.encode()).hexdigest()
