"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import held, map_arrow
from .hashing import mix64

#: Windows that are packed together, and so tokens of a task in memory: WINDOWS times the capacity.
WINDOWS = 64
#: A block leaves capacity / SLACK of each window free, so that near-equal windows fit; pieces are at most capacity / PIECES and get smaller as a block fills, down to capacity / SLACK.
SLACK, PIECES = 512, 4
#: Words whose ids a worker remembers, the first ones that it meets; characters that are encoded together; characters of the longest word that is remembered; texts that are taken from a batch together.
CACHE_WORDS, CHARS, LONGEST, TEXTS = 1_000_000, 1 << 18, 64, 256
#: Rows, and bytes of their ids, that a task returns together, or a few more.
ROWS, BYTES = 4_096, 1 << 20

_U = np.uint64
_LETTER, _NUMBER, _OTHER, _FOREIGN = 1, 2, 3, 4
#: Characters that the tables know; all beyond are foreign.
_KNOWN = 0x180


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case code) of the characters below _KNOWN, and of one for all others.

    0 is white space.  Foreign: control characters, and those whose lower case isn't one character.
    """
    kind, lower = np.full(_KNOWN + 1, _FOREIGN, dtype=np.uint8), np.arange(_KNOWN + 1, dtype=np.uint16)
    for i, c in enumerate(map(chr, range(_KNOWN))):
        if c in "\t\n\r " or "!" <= c <= "~" or (i > 0xA0 and len(c.lower()) == 1):
            kind[i] = 0 if c.isspace() else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)
            lower[i] = ord(c.lower())
    return kind, lower


_KIND, _LOWER = _tables()
#: What the vocabulary's pattern takes after an apostrophe, by the first two letters.
_SHORT = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_BASE = 0x9E3779B97F4A7C15
_HASHED = mix64(_LOWER.astype(np.uint64) * _U(_BASE) + _U(1))


def _split(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word by the vocabulary's splitting pattern.

    A word is a run of letters, a single number, a run of other characters, or an apostrophe of its
    own with one of the short endings, which may be the beginning of a longer run of letters.
    """
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == _NUMBER
    quotes = np.flatnonzero((codes[:-1] == 39) & (kind[1:] == _LETTER) & change[:-1])
    for at in quotes.tolist():
        letters = [chr(_LOWER[c]) for c in codes[at + 1 : at + 3]]
        size = _SHORT.get(letters[0]) or (_SHORT.get("".join(letters)) if len(letters) == 2 else None)
        if size:
            change[at + 1] = False
            if at + 1 + size < len(kind) and kind[at + 1 + size] == _LETTER:
                change[at + 1 + size] = True
    at = np.flatnonzero(change)
    word = kind[at] != 0
    return at[word], np.append(at, len(kind))[1:][word]


class _Words:
    """Ids of known words by the 64-bit hash of their characters: open addressing in arrays."""

    def __init__(self, room: int):
        self.bits = max(4, (2 * room - 1).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        self.ids, self.first, self.n = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _U(0xD6E8FEB86659FD93)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash; -1: unknown."""
        at = self._slots(hashes)
        key = self.keys[at]
        out = np.where(key == hashes, self.rows[at], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            key = self.keys[at[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Distinct unknown hashes and their ids, one after the other."""
        rows = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        if self.first[-1] + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.first[-1]], np.zeros(len(self.ids) + len(ids), dtype="<u4")])
        self.ids[self.first[-1] : self.first[-1] + len(ids)] = ids
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.n += len(hashes)
        at, open_ = self._slots(hashes), np.arange(len(hashes))
        while len(open_):
            free = open_[self.keys[at[open_]] == 0]
            self.keys[at[free]] = hashes[free]  # of those that meet in a slot one stays
            self.rows[at[free]] = rows[free]
            open_ = open_[self.keys[at[open_]] != hashes[open_]]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Ids of texts by a vocabulary file of ``tokenizers``, without special tokens.

    Words of texts in Latin letters are looked up one by one, which gives the same ids: the
    vocabulary splits, lower-cases and merges each word for itself and marks its last id.  Words
    are found in arrays over the characters of many texts; the unknown ones are encoded together
    and told apart by these marks.  Other texts, and those that may hold the name of a special
    token, go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        spec = self._tokenizer.to_str()
        self._by_word = all(x in spec for x in ('"end_of_word_suffix":"</w>"', '"Lowercase"', "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"))
        self._last = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._last[i] = token.endswith("</w>")
        # words are split and lower-cased already, and none has a character that normal forms change
        self._words = Tokenizer(self._tokenizer.model)  # one vocabulary in memory serves both
        self._words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._known = _Words(CACHE_WORDS)
        base = np.full(CHARS + 1, _BASE, dtype=np.uint64)
        back = np.full(CHARS + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        base[0] = back[0] = 1
        self._power, self._back = np.cumprod(base), np.cumprod(back)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, one after the other, the end of each word's)."""
        parts = (" ".join(words[i : i + 200]).lower() for i in range(0, len(words), 200))
        ids = np.concatenate([np.array(self._words.encode_batch_fast([x], add_special_tokens=False)[0].ids, dtype="<u4") for x in parts])
        ends = np.flatnonzero(self._last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary's marks don't tell its words apart")
        return ids, ends

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):  # a longer single text has a chunk of its own
            if size and size + len(text) >= CHARS:
                out += self._chunk(texts[start:i])
                start, size = i, 0
            size += len(text) + 1
        return out + self._chunk(texts[start:]) if start < len(texts) else out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            return [self._whole(t) for t in texts]
        joined = "\n".join(texts) + "\n"
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _KNOWN).astype(np.uint16)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        kind = _KIND[codes]
        odd = np.concatenate([np.flatnonzero(kind == _FOREIGN), np.flatnonzero((codes[:-1] == 60) & (codes[1:] == 124))])
        whole = set((np.searchsorted(bounds, odd, "right") - 1).tolist())
        for i in whole:
            kind[bounds[i] : bounds[i + 1]] = 0
        first, last = _split(codes, kind)
        ids, ends = self._looked_up(joined, codes, first, last)
        cuts = np.concatenate([[0], ends])[np.searchsorted(first, bounds)].tolist()
        raw = ids.tobytes()
        return [self._whole(t) if i in whole else raw[4 * cuts[i] : 4 * cuts[i + 1]] for i, t in enumerate(texts)]

    def _looked_up(self, joined: str, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at first to last, one after the other, the end of each word's)."""
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(first), dtype=np.uint64)
            for begin in range(0, len(first), 1 << 16):  # the powers reach over a part of the characters
                a, b = first[begin : begin + (1 << 16)], last[begin : begin + (1 << 16)]
                for low, high in _within(a, b, CHARS):
                    part = codes[a[low] : b[high - 1]]
                    if len(part) > CHARS:  # a single word: too long to be remembered
                        continue
                    sums = np.zeros(len(part) + 1, dtype=np.uint64)
                    np.cumsum(_HASHED[part] * self._power[: len(part)], out=sums[1:])
                    x, y = a[low:high] - a[low], b[low:high] - a[low]
                    hashes[begin + low : begin + high] = mix64((sums[y] - sums[x]) * self._back[x]) | _U(1)
        rows = self._known.find(hashes)
        long = np.flatnonzero(last - first > LONGEST)
        rows[long] = -1
        hashes[long] = 2 * long.astype(np.uint64)  # even: unlike all others, and each its own
        lost = np.flatnonzero(rows < 0)
        known = self._known
        if len(lost):
            new, one, again = np.unique(hashes[lost], return_index=True, return_inverse=True)
            at = lost[one]
            ids, ends = self._new([joined[a:b] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)])
            if known.n + len(new) <= CACHE_WORDS and not len(long):
                rows[lost] = known.n + again
                known.add(new, ids, ends)
            else:  # no room: these words serve this call alone
                rows[lost] = known.n + again
                starts = np.concatenate([known.first[:-1], known.first[-1] + np.concatenate([[0], ends[:-1]])])
                counts = np.concatenate([np.diff(known.first), np.diff(np.concatenate([[0], ends]))])
                return _gathered(np.concatenate([known.ids[: known.first[-1]], ids]), starts[rows], counts[rows])
        return _gathered(known.ids, known.first[rows], known.first[rows + 1] - known.first[rows])

    def __call__(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _within(a: np.ndarray, b: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of the words a to b, in order, that span at most ``size`` characters; a longer word is one."""
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(b, a[low] + size, "right")))
        yield low, high
        low = high


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``ids`` at starts, one after the other, the end of each)."""
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends


def encoder(path: str) -> Encoder:
    """The process's encoder of ``path``."""
    return held(f"encoder {path}", lambda: Encoder(path))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of ``sizes`` in k parts of near-equal sums (Karmarkar-Karp, k ways).

    A partial partition is a row of k sums, largest first, less its least.  The two of the largest
    spread are merged, the largest part of one with the smallest of the other, until one is left.
    """
    parts: list = [[] for _ in range(k)]
    if not sizes or k == 1:
        parts[0] = list(range(len(sizes)))
        return parts
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [(i,), *[()] * (k - 1)]))
    heapq.heapify(heap)
    for turn in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        of_b = of_b[::-1]
        of = [of_a[j] + of_b[j] for j in order.tolist()]
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, of))
    return [list(x) for x in heap[0][3]]


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items (their positions), each of at most ``capacity`` together; no item is larger.

    The number of windows begins with the least that holds the sum and rises by one, and all items
    are differenced again, as long as a window exceeds the capacity.
    """
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 2, windows: int = WINDOWS, cut: bool = True) -> DataFrame:
    """Documents as token sequences of at most ``capacity`` ids with near-equal lengths.

    docs: doc_id and text (null: empty); further columns, whatever their names, are not read.  A
    document's ids are those of the vocabulary file at ``tokenizer_path`` and ``end_id``; an empty
    text is ``end_id`` alone.  Full windows of a document are sequences of their own.  With
    ``cut``, what remains is cut into pieces before anything is packed: large ones first, smaller
    ones towards the end of a block, which even the windows out; without, it stays whole.  ``pack_block`` packs the pieces that nearly fill ``windows``
    windows at a time (capacity / SLACK of each is left free), so that differencing alone decides
    what lies in a window, and the count rises where its best isn't good enough.  This happens
    within the task that reads them: nothing is shuffled, memory is bounded, and which pieces share
    a sequence follows the partitions of the input.  Very long texts take many sequences.

    Returns one row for each piece: doc_id, start (its document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (gapless from 0 in a
    sequence).  Repeated rows are documents of their own; a null doc_id stays null; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_all
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size_out = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence, size_out
            offset = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            size_out += 4 * offset
            sequence += 1

        def flush(block: list[tuple]) -> None:
            for window in pack_block([len(x[2]) // 4 for x in block], capacity):
                emit([block[i] for i in window])

        def batch_of() -> pa.RecordBatch:
            nonlocal size_out
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            size_out = 0
            return out

        block: list[tuple] = []
        filled, full = 0, (capacity - capacity // SLACK) * windows
        most, least = max(1, capacity // PIECES), max(1, capacity // SLACK)
        for part in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, found in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids = found + end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    emit([(doc_id, start, ids[4 * start : 4 * (start + capacity)], total)])
                    if size_out >= BYTES:
                        yield batch_of()
                start = whole
                while start < total:
                    size = min(total - start, max(least, min(most, (full - filled) // (2 * windows)))) if cut else total - start
                    if block and filled + size > full:
                        flush(block)
                        block, filled = [], 0
                        continue
                    block.append((doc_id, start, ids[4 * start : 4 * (start + size)], total))
                    filled += size
                    start += size
                if len(rows) >= ROWS or size_out >= BYTES:
                    yield batch_of()
        if block:
            flush(block)
        if rows:
            yield batch_of()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(columns, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
