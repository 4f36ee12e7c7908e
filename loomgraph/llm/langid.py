"""Language identification by unigram pieces, marginalised over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.  A forward pass over
a word's characters sums the probabilities of all its segmentations; a text's score in a language
is the product over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, held, kept_rows, map_arrow

#: Words whose scores a worker remembers, the first ones that it meets; distinct words that it counts before it passes the counts on; words, and texts, that are scored together.
CACHE_WORDS, COUNTED_WORDS, AT_ONCE, TEXTS = 300_000, 100_000, 8_192, 256
#: Probability of a character that is no piece; counts that every piece has besides its own.
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Letters of a run whose spans are kept; those of a longer one are found again where they are read.
KEPT = 4_096
#: Characters of words that a task gathers before it counts their pieces.
GATHERED = 1 << 19
#: Most rounds of expectation-maximisation, and the change of the mean log-probability of a word that ends it.
ROUNDS, SETTLED = 30, 1e-4
#: A text whose mean log-probability of a character is this much below its language's is in none of the learned languages.
MARGIN = 3.0
#: Languages that are learned, those with the most texts; counts are summed as whole multiples of 1 / UNITS, so that their order is all the same.
LANGUAGES, UNITS = 256, 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_EDGES = ".,;:!?()\"'"


class Pieces:
    """The vocabulary's pieces by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [(model.id_to_piece(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.size = model.get_piece_size()
        by_length: dict[int, list[tuple[int, int]]] = {}
        for text, i in texts:
            if text and _MARK not in text[1:]:  # a mark inside never fits a word
                by_length.setdefault(len(text), []).append((_hash(text), i))
        self.by_length, self.near = {}, {}
        for length, found in by_length.items():
            found.sort()
            hashes = np.array([h for h, _ in found], dtype=np.uint64)
            self.by_length[length] = (hashes, np.array([i for _, i in found], dtype=np.int64))
            self.near[length] = np.zeros(1 << 16, dtype=bool)
            self.near[length][_short(hashes)] = True
        self.longest = max(self.by_length)

    def find(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h`` of the hashes of pieces of that length, the pieces): only what shares 16 bits with one is searched."""
        hashes, ids = self.by_length[length]
        at = np.flatnonzero(self.near[length].take(_short(h)))
        h = h[at]
        near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[near] == h
        return at[hit], ids[near[hit]]

    def spans(self, words: list[str]) -> dict[tuple[int, int], _Span] | _Spans:
        """(start, end) to the pieces there in words that are all of one length."""
        found = _Spans(self, words)
        n = len(words[0]) + 1
        if n > KEPT:
            return found
        return {(start, start + length): span for length in self.by_length if length <= n for start, span in found.of(length, 0, n - length + 1)}


#: (which words have a piece there, or None for all of them; the pieces, ``size`` for none and ``size + 1`` for a character that is none).
_Span = tuple[np.ndarray | None, np.ndarray]


class _Spans:
    """The pieces of words of one length by (start, end), from running hashes of their characters."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces, n = pieces, len(words[0]) + 1
        codes = np.frombuffer((_MARK + _MARK.join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n).astype(np.uint64)
        self.sums = np.zeros((n + 1, len(words)), dtype=np.uint64)
        self.powers = [_U(1)]
        with np.errstate(over="ignore"):
            for j in range(n):
                self.sums[j + 1] = self.sums[j] * _BASE + codes[:, j] + _U(1)
            for _ in range(pieces.longest):
                self.powers.append(self.powers[-1] * _BASE)

    def of(self, length: int, first: int, last: int) -> Iterator[tuple[int, _Span]]:
        """(start, span) of the pieces of that length that start from ``first`` to before ``last``."""
        size, rows = self.pieces.size, self.sums.shape[1]
        with np.errstate(over="ignore"):
            h = self.sums[first + length : last + length] - self.sums[first:last] * self.powers[length]
        at, found = self.pieces.find(h.ravel(), length)
        bounds = np.searchsorted(at, np.arange(last - first + 1) * rows)
        for i in range(last - first):
            here, ids = at[bounds[i] : bounds[i + 1]] - i * rows, found[bounds[i] : bounds[i + 1]]
            if length == 1 or 2 * len(here) > rows:
                whole = np.full(rows, size + 1 if length == 1 else size)
                whole[here] = ids
                yield first + i, (None, whole)
            elif len(here):
                yield first + i, (here, ids)

    def get(self, key: tuple[int, int]) -> _Span | None:
        start, end = key
        if end - start not in self.pieces.by_length:
            return None
        return next((span for _, span in self.of(end - start, start, start + 1)), None)


def _short(h: np.ndarray) -> np.ndarray:
    """16 bits of each hash."""
    with np.errstate(over="ignore"):
        return ((h * _BASE) >> _U(48)).view(np.int64)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
    return h


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Words of equal length, at most AT_ONCE of them, as (length, positions)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    for found in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
        for start in range(0, len(found), AT_ONCE):
            yield len(words[found[0]]), found[start : start + AT_ONCE]


def _chances(spans, table: np.ndarray) -> Callable[[tuple[int, int]], tuple[np.ndarray | None, np.ndarray] | None]:
    """(start, end) to (words with a piece there, its probability in each column of ``table``); what is kept of spans is looked up once."""
    full = np.append(table, np.full((1, table.shape[1]), UNKNOWN), axis=0)

    def chance(span: _Span | None):
        return None if span is None else (span[0], full.take(span[1], axis=0))

    if isinstance(spans, dict):
        return {key: chance(span) for key, span in spans.items()}.get
    return lambda key: chance(spans.get(key))


def _forward(chances, n: int, rows: int, languages: int, longest: int, *, back: bool = False, keep: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over all segmentations of every prefix (``back``: suffix, by its length), and the logarithms they are scaled by."""
    alpha, scale = [np.ones((rows, languages))], [np.zeros((rows, languages))]
    for end in range(1, n + 1):
        total, base = np.zeros((rows, languages)), scale[end - 1]
        for start in range(max(0, end - longest), end):
            found = chances((n - end, n - start) if back else (start, end))
            if found is None:
                continue
            at, p = found
            part = p * (alpha[start] if at is None else alpha[start].take(at, axis=0))
            if scale[start] is not base:
                part *= np.exp(np.clip(scale[start] - base, -600, 600))[slice(None) if at is None else at]
            if at is None:
                total += part
            else:
                total[at] += part
        low = total < 1e-100
        if low.any():
            base = base + np.where(low, -100 * math.log(10), 0)
            total = np.where(low, total * 1e100, total)
        alpha.append(total)
        scale.append(base)
        if end > longest and not keep:  # what is too far back is never read again
            alpha[end - longest - 1] = scale[end - longest - 1] = None
    return alpha, scale


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language (columns of ``table``), over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for length, at in _by_length(words):
        chances = _chances(pieces.spans([words[i] for i in at.tolist()]), table)
        alpha, scale = _forward(chances, length + 1, len(at), table.shape[1], pieces.longest)
        out[at] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, first: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected uses of each piece in weighted words under the probabilities ``first``, weighted log-probability of the words)."""
    counts = np.zeros(pieces.size + 2)
    table, logs = np.append(first, 0.0)[:, None], 0.0
    for length, at in _by_length(words):
        spans = pieces.spans([words[i] for i in at.tolist()])
        chances, n, weight = _chances(spans, table), length + 1, weights[at]
        alpha, up = _forward(chances, n, len(at), 1, pieces.longest, keep=True)
        beta, down = _forward(chances, n, len(at), 1, pieces.longest, back=True, keep=True)
        whole, top = np.maximum(alpha[n][:, 0], 1e-300), up[n][:, 0]
        scaled = up[n] is not up[0] or down[n] is not down[0]
        logs += float(((np.log(whole) + top) * weight).sum())
        for end in range(1, n + 1):
            right = beta[n - end][:, 0] / whole
            for start in range(max(0, end - pieces.longest), end):
                span = spans.get((start, end))
                if span is None:
                    continue
                here = slice(None) if span[0] is None else span[0]
                share = alpha[start][here, 0] * chances((start, end))[1][:, 0] * right[here]
                if scaled:
                    share = share * np.exp(np.clip(up[start][here, 0] + down[n - end][here, 0] - top[here], -600, 600))
                counts += np.bincount(span[1], share * weight[here], len(counts))
    return counts[:-2], logs


def pieces_of(path: str) -> Pieces:
    """The process's pieces of ``path``."""
    return held(f"pieces {path}", lambda: Pieces(path))


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; signs that are numerals in words, as ½ or Ⅷ, are no letters."""
    words = _WORD.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def _strings(column: pa.Array) -> list[str | None]:
    """``column.to_pylist()``, which makes a scalar of each string, in a tenth of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(bounds of each text's tokens, which token each is, words of all distinct tokens, how many each token has).

    A token is what lies between ASCII spaces, so that words, as ``words_of`` finds them, are looked
    for once in each distinct token of a batch only.
    """
    split = pc.ascii_split_whitespace(texts)
    distinct = split.values.dictionary_encode()
    tokens = _strings(distinct.dictionary)
    words: list[str] = []
    count = np.ones(len(tokens), dtype=np.int64)
    for i, low in enumerate("\n".join(tokens).lower().split("\n") if tokens else []):
        if low.isalpha() or (low := low.strip(_EDGES)).isalpha():
            words.append(low)
        else:
            found = words_of(tokens[i])
            words += found
            count[i] = len(found)
    return split.offsets.to_numpy(), distinct.indices.to_numpy(), words, count


def _first(size: int) -> np.ndarray:
    """Piece probabilities to start from: Zipf's law over the vocabulary's order."""
    p = 1.0 / (np.arange(size) + 10.0)
    return p / p.sum()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs in texts of each language; the empty word counts the texts."""
    seen: dict[str, Counter] = {}

    def passed() -> pa.RecordBatch:
        langs = [pa.repeat(pa.scalar(lang, pa.string()), len(words)) for lang, words in seen.items()]
        words = [pa.array(list(words), pa.string()) for words in seen.values()]
        n = [pa.array(list(words.values()), pa.int64()) for words in seen.values()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in ((langs, pa.string()), (words, pa.string()), (n, pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, lang = _strings(langs.dictionary), langs.indices.to_numpy()
        for name, n in zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True):
            seen.setdefault(name, Counter())[""] += n
        bounds, at, words, count = _split(batch.column("text"))
        pairs, n = np.unique(np.repeat(lang, np.diff(bounds)) * np.int64(len(count)) + at, return_counts=True)
        first = np.cumsum(count) - count
        for i, name in enumerate(names):
            low, high = np.searchsorted(pairs, [i * len(count), (i + 1) * len(count)])
            counts, here = seen[name], pairs[low:high] - i * len(count)
            for begin, more, times in zip(first[here].tolist(), count[here].tolist(), n[low:high].tolist(), strict=True):
                for word in words[begin : begin + more]:
                    counts[word] += times
        if sum(map(len, seen.values())) > COUNTED_WORDS:
            yield passed()
    yield passed()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """(lang, words, n) of a task's rows, gathered over batches: words of equal length are counted together."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def taken() -> Iterator[tuple[str, list[str], np.ndarray]]:
        for lang, parts in held.items():
            yield lang, np.concatenate([w for w, _ in parts]).tolist(), np.concatenate([n for _, n in parts]).astype(float)
        held.clear()

    letters = 0
    for batch in batches:
        langs, words, n = batch.column("lang").dictionary_encode(), batch.column("word"), batch.column("n").to_numpy()
        names, lang, letters = _strings(langs.dictionary), langs.indices.to_numpy(), letters + (pc.sum(pc.utf8_length(words)).as_py() or 0)
        words = words.to_numpy(zero_copy_only=False)
        for i, name in enumerate(names):
            held.setdefault(name, []).append((words[lang == i], n[lang == i]))
        if letters >= GATHERED:
            yield from taken()
            letters = 0
    yield from taken()


def _expect(path: str, sent):
    """mapInArrow function: (lang, word, n) to the expected uses of pieces and, as one piece more, the words' log-probability; whole multiples of 1 / UNITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, starts = pieces_of(path), sent.value
        totals: dict[str, np.ndarray] = {}
        for lang, words, n in _gathered(batches):
            counts, logs = expected_counts(words, n, pieces, starts[lang])
            totals[lang] = totals.get(lang, 0) + np.rint(np.append(counts, logs) * UNITS).astype(np.int64)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "piece", "n"])

    return run


def _fixed_points(totals: dict[str, float], size: int, expect: Callable[[dict[str, np.ndarray]], dict[str, tuple[np.ndarray, float]]]) -> dict[str, tuple[np.ndarray, float]]:
    """(piece probabilities, log-probability of the words under them) of each language, by expectation-maximisation from Zipf's law.

    totals: how many words each language has.  ``expect`` gives the expected counts and the
    log-probability under the probabilities of the languages that haven't settled yet.
    """
    starts, before, found = {lang: _first(size) for lang in totals}, dict.fromkeys(totals, -math.inf), {}
    for left in range(ROUNDS, -1, -1):
        if not starts:
            break
        for lang, (counts, logs) in expect(starts).items():
            if logs - before[lang] < SETTLED * totals[lang] or not left:
                found[lang] = starts.pop(lang), logs
            else:
                starts[lang], before[lang] = (counts + SMOOTHING) / (counts + SMOOTHING).sum(), logs
    return found


def settled(words: list[str], n: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece probabilities of weighted words, at the fixed point of expectation-maximisation."""
    return _fixed_points({"": n.sum()}, pieces.size, lambda starts: {"": expected_counts(words, n, pieces, starts[""])})[""][0]


def _expected(words: DataFrame, path: str, starts: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, float]]:
    """(expected uses of each piece, log-probability) of the words (lang, word, n) of each language of ``starts``."""
    sent = words.sparkSession.sparkContext.broadcast(starts)
    expected = map_arrow(words.where(F.col("lang").isin(list(starts))), _expect(path, sent), "lang string, piece int, n long")
    rows = expected.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    langs, piece, n = rows.column("lang").to_numpy(), rows.column("piece").to_numpy(), rows.column("n").to_numpy() / UNITS
    out = {}
    for lang, p in starts.items():
        counts, here = np.zeros(len(p) + 1), langs == lang
        counts[piece[here]] = n[here]
        out[lang] = counts[:-1], float(counts[-1])
    return out


def learned(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, piece probabilities with a zero row at the end, log shares of the texts, mean log-probability of a character).

    docs: doc_id, text and lang, none null.  Words are counted over all rows, and every round of
    expectation-maximisation is over all words, in tasks, until a language's probabilities have
    settled; the usual log-probability of a character is that of all words too.  The driver gets at
    most one number for each of LANGUAGES languages and each piece in a round.
    """
    counted = map_arrow(docs.select("lang", "text"), _count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted.sortWithinPartitions("lang", F.length("word")))
    texts = {r["lang"]: r["n"] for r in counted.where("word = ''").orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(texts)
    pieces = pieces_of(path)
    table, usual = np.zeros((pieces.size + 1, len(languages))), np.full(len(languages), -math.inf)
    table[:-1] = 1 / pieces.size  # of a language without any letter
    if not languages:
        return [], table, np.zeros(0), np.zeros(0)
    whole = counted.where((F.col("word") != "") & F.col("lang").isin(languages))
    sums = {r["lang"]: r for r in whole.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.col("n") * (F.length("word") + 1)).alias("letters")).collect()}
    found = _fixed_points({lang: float(r["words"]) for lang, r in sums.items()}, pieces.size, lambda starts: _expected(whole, path, starts))
    for j, lang in enumerate(languages):
        if lang in found:
            table[:-1, j], usual[j] = found[lang][0], found[lang][1] / sums[lang]["letters"]
    shares = np.array([texts[lang] for lang in languages], dtype=float)
    return languages, table, np.log(shares / shares.sum()), usual


class _Rows(dict):
    """Rows of words: one that is looked up for the first time gets the next."""

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        return row


class Predictor:
    """Languages of texts by a learned model; scores of words are remembered."""

    def __init__(self, path: str, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]):
        self.languages, self.table, self.prior, self.usual = model
        self.pieces = pieces_of(path)
        self.known = _Rows()
        self.scores = np.zeros((CACHE_WORDS, len(self.languages)))  # takes memory as it is filled

    def _scores(self, words: list[str]) -> np.ndarray:
        """Scores of the words, which may repeat; what is beyond CACHE_WORDS serves this call alone."""
        n = len(self.known)
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(reversed(self.known), len(self.known) - n))[::-1]
        if not new:
            return self.scores.take(rows, axis=0)
        found = word_scores(new, self.pieces, self.table)
        if n + len(new) > CACHE_WORDS:
            for _ in new:
                self.known.popitem()
            out, old = np.empty((len(words), len(self.languages))), rows < n
            out[old], out[~old] = self.scores[rows[old]], found[rows[~old] - n]
            return out
        self.scores[n : n + len(new)] = found
        return self.scores.take(rows, axis=0)

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """(language, posterior, how far a character's mean log-probability is from the language's usual one) of each text; (und, 0, 0) for one without letters or where nothing was learned."""
        names, values, levels = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, values, levels
        bounds, at, words, count = _split(texts)
        scores, letters, some = np.zeros((len(count), len(self.languages))), np.zeros(len(count), dtype=np.int64), np.flatnonzero(count)
        if len(some):
            first = (np.cumsum(count) - count)[some]
            scores[some] = np.add.reduceat(self._scores(words), first, axis=0)
            letters[some] = np.add.reduceat(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, first)
        for i, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            here = at[start:end]
            length = int(letters[here].sum())
            if not length:
                continue
            total = scores.take(here, axis=0).sum(axis=0) + self.prior
            best = int(total.argmax())
            names[i] = self.languages[best]
            values[i] = float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())
            levels[i] = float((total[best] - self.prior[best]) / length - self.usual[best])
        return names, values, levels


def _predict(path: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(path, model.value)
        for batch in batches:
            names: list[str] = []
            values: list[float] = []
            for begin in range(0, batch.num_rows, TEXTS):
                found = predict(batch.column("text").slice(begin, TEXTS))
                names += found[0]
                values += found[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _model(docs: DataFrame, vocabulary_path: str):
    """The broadcast model learned from rows with text and lang whose crc32 of the doc_id isn't 1 modulo 3."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    taught = rows.where("doc_id is not null and text is not null and lang is not null").where(~_held(F.col("doc_id")))
    return docs.sparkSession.sparkContext.broadcast(learned(taught, vocabulary_path))


def _held(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The language of every text, learned from the other texts.

    docs: doc_id, text and lang; further columns, whatever their names, are not read.  It is learned
    from rows with text and lang whose crc32 of the doc_id (as text) isn't 1 modulo 3.  Returns one
    row for each row of docs: doc_id, held_out (that remainder is 1; false for a null doc_id),
    lang_pred, score (posterior probability).  A text that is null or holds no letter, and every
    text if nothing could be learned, is ``und`` with score 0; ties go to the first language in
    order.  Rows alike are judged alike; a very long text or word is scored whole; an empty table
    gives no rows.  lang is never read for a prediction.
    """
    sent = _model(docs, vocabulary_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _predict(vocabulary_path, sent), "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, vocabulary_path: str, *, least: float = 0.5, margin: float = MARGIN) -> DataFrame:
    """``docs`` (columns and all) less the rows whose text is ``und``, has a score below ``least`` or isn't like its language.

    The score compares the learned languages only, and nears 1 for long texts in any other; so a
    text goes too whose mean log-probability of a character is ``margin`` below the usual one.
    Each row is judged by its own text where it is read; doc_ids, null or repeated, don't matter.
    """
    sent = _model(docs, vocabulary_path)

    def judge():
        predict = Predictor(vocabulary_path, sent.value)

        def keep(batch: pa.RecordBatch) -> pa.Array:
            good: list[bool] = []
            for begin in range(0, batch.num_rows, TEXTS):
                found = predict(batch.column("text").slice(begin, TEXTS))
                good += [name != "und" and value >= least and level >= -margin for name, value, level in zip(*found, strict=True)]
            return pa.array(good, pa.bool_())

        return keep

    return kept_rows(docs, judge)
