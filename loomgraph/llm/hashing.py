"""Vectorised 64-bit hashes of words, word shingles and character shingles.

Everything here is a pure function of the text: no process-dependent hash
seeds, so that a task that is run again gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power_table(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** size modulo 2 ** 64 (grown and kept)."""
    table = _powers.get(base)
    if table is None or len(table) <= size:
        full = np.full(max(size, 2 * CHUNK_BYTES) + 1, base, dtype=np.uint64)
        full[0] = 1
        table = _powers[base] = np.cumprod(full)
    return table


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK_BYTES:
            yield start, i
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, hashes of all words, text boundaries) chunk by chunk.

    Words are runs without ASCII white space (9 to 13 and 32).
    """
    for start, end in _chunks([len(t) for t in texts]):
        data = np.frombuffer(b"\n" + b"\n".join(texts[start:end]) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        at = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = at[0::2], at[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power_table(_BASE, len(data))[: len(data)], out=sums[1:])
        hashes = mix64((sums[last] - sums[first]) * _power_table(_BASE_INVERSE, len(data))[first])
        lengths = np.array([len(t) + 1 for t in texts[start:end]], dtype=np.int64)
        bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]) + 1)
        yield start, end, hashes, bounds


def _windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct windows of ``width``; a shorter text is one window."""
    if width > 1 and len(hashes) >= width:
        n = len(hashes) - width + 1
        joined = hashes[:n].copy()
        for i in range(1, width):
            joined = joined * _U(_BASE) + hashes[i : i + n]
        joined = mix64(joined)
    else:
        joined = hashes
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            part = np.sort(joined[a : b - width + 1])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif b > a:
            whole = _U(b - a)
            for h in hashes[a:b]:
                whole = whole * _U(_BASE_INVERSE) + h
            yield mix64(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def word_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Distinct ``width``-word shingles of each text, A-Z lower-cased, as sorted hashes.

    A text with fewer words is one shingle of them all; a null text or one
    without words has none.
    """
    with np.errstate(over="ignore"):
        for _, _, hashes, bounds in word_hashes([b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]):
            yield from _windows(hashes, bounds, width)


#: What stands for a window that would reach into the next text: no set holds it.
NO_WINDOW = np.iinfo(np.uint64).max


def char_windows(texts: list[str], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, a hash for each character, boundaries of the texts).

    The hash at a character is that of the window that begins there, with repeats; NO_WINDOW where
    the text ends within it.  A text shorter than ``width`` is one window; an empty one has none.
    ``width`` is a power of two.
    """
    with np.errstate(over="ignore"):
        for start, end in _chunks([4 * len(t) for t in texts]):
            lengths = np.array([len(t) for t in texts[start:end]], dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            joined = np.zeros(bounds[-1] + width, dtype=np.uint64)
            joined[: bounds[-1]] = np.frombuffer("".join(texts[start:end]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            joined += _U(1)
            codes, base, step = joined[: bounds[-1]].copy(), _BASE, 1
            while step < width:  # windows of twice the length, again and again
                joined = joined[:-step] * _U(base) + joined[step:]
                base, step = base * base % (1 << 64), 2 * step
            out = np.minimum(mix64(joined[: bounds[-1]]), NO_WINDOW - _U(1))
            for back in range(1, width):
                at = bounds[1:] - back
                out[at[at >= bounds[:-1]]] = NO_WINDOW
            for i in np.flatnonzero((lengths > 0) & (lengths < width)).tolist():
                whole = _U(lengths[i])
                for c in codes[bounds[i] : bounds[i + 1]]:
                    whole = whole * _U(_BASE_INVERSE) + c
                out[bounds[i]] = np.minimum(mix64(np.array([whole])), NO_WINDOW - _U(1))[0]
            yield start, end, out, bounds


#: Bits of a shingle in sets that are compared many at once; the rest of a number tells the sets apart.
SHINGLE_BITS = 52
_AT_ONCE = 1 << (64 - SHINGLE_BITS)


def distinct_sets(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct SHINGLE_BITS-bit values of each run of ``flat``, their boundaries); NO_WINDOW is left out."""
    values, sizes = [], []
    for low in range(0, len(bounds) - 1, _AT_ONCE):
        cuts = bounds[low : low + _AT_ONCE + 1]
        part = flat[cuts[0] : cuts[-1]]
        owner = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint64), np.diff(cuts))
        real = part != NO_WINDOW
        keys = np.sort((owner[real] << _U(SHINGLE_BITS)) | (part[real] >> _U(64 - SHINGLE_BITS)))
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        sizes.append(np.bincount((keys >> _U(SHINGLE_BITS)).astype(np.int64), minlength=len(cuts) - 1))
        values.append(keys & _U((1 << SHINGLE_BITS) - 1))
    return np.concatenate([np.zeros(0, np.uint64), *values]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)


def shared_values(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[i] and b[i] of ``distinct_sets`` share, for each i."""
    out, sizes = np.zeros(len(a), dtype=np.int64), np.diff(bounds)
    weights = np.cumsum(sizes[a] + sizes[b])
    low = 0
    while low < len(a):  # as many pairs as the numbers tell apart, of about CHUNK_BYTES values
        high = min(low + _AT_ONCE, max(low + 1, int(np.searchsorted(weights, (weights[low - 1] if low else 0) + CHUNK_BYTES, "right"))))
        keys = []
        for side in (a[low:high], b[low:high]):
            n = sizes[side]
            at = np.repeat(bounds[side] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append((np.repeat(np.arange(high - low, dtype=np.uint64), n) << _U(SHINGLE_BITS)) | values[at])
        both = np.sort(np.concatenate(keys))
        out[low:high] = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(SHINGLE_BITS)).astype(np.int64), minlength=high - low)
        low = high
    return out


def _joined_sets(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in parts)])
    return values, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(b) for _, b in parts)]))]).astype(np.int64)


def char_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of each text's character windows, as of ``distinct_sets``."""
    return _joined_sets([distinct_sets(hashes, bounds) for _, _, hashes, bounds in char_windows(texts, width)])


def word_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of each text's word shingles, as of ``distinct_sets``."""
    sets = list(word_shingles(texts, width))
    return distinct_sets(np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64))


def set_keys(flat: np.ndarray, bounds: np.ndarray, seed: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A 64-bit key of each set of distinct hashes, whatever their order (0: empty)."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(mix64(flat ^ _U(seed)))])
        sizes = np.diff(bounds).astype(np.uint64)
        return np.where(sizes > 0, mix64((sums[bounds[1:]] - sums[bounds[:-1]]) + sizes * _U(_BASE)), _U(0))


def minimum_hashes(flat: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` independent MinHash values of each non-empty set (rows; empty sets give ones)."""
    out = np.full((len(bounds) - 1, count), np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.flatnonzero(np.diff(bounds))
    if not len(rows):
        return out
    seeds = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64))
    size, step = len(rows), 1 << 18
    with np.errstate(over="ignore"):
        a = 0
        while a < size:  # parts that stay in the processor's cache
            b = int(np.searchsorted(bounds[rows], bounds[rows[a]] + step))
            b = max(b, a + 1)
            low = bounds[rows[a]]
            part, starts = flat[low : bounds[rows[b - 1] + 1]], bounds[rows[a:b]] - low
            for k in range(count):
                out[rows[a:b], k] = np.minimum.reduceat((part ^ seeds[2 * k]) * (seeds[2 * k + 1] | _U(1)), starts)
            a = b
    return out


def one_permutation(flat: np.ndarray, bounds: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash of each set in each of ``bins`` ranges of hashes, which of them are filled).

    The hashes must be well mixed; NO_WINDOW among them is left out.
    """
    n = len(bounds) - 1
    out = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    at = np.repeat(np.arange(n, dtype=np.int64) * bins, np.diff(bounds))
    at += (((flat >> _U(32)) * _U(bins)) >> _U(32)).view(np.int64)
    np.minimum.at(out, at, flat)
    out = out.reshape(n, bins)
    return out, out != np.iinfo(np.uint64).max


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the nearest filled bin to their left (around the end)."""
    n, bins = values.shape
    at = np.where(np.concatenate([filled, filled], axis=1), np.arange(2 * bins), -1)
    at = np.maximum.accumulate(at, axis=1)[:, bins:]
    gap = (np.arange(bins, 2 * bins) - at).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.take_along_axis(values, np.maximum(at, 0) % bins, axis=1) + gap * _U(0xD1B54A32D192ED03)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` values, which stand apart; equal keys only within a band.

    A densified sample has runs of one value: neighbours would make bands of a single sample.
    """
    n, k = values.shape
    bands = k // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(7, 7 + bands, dtype=np.uint64)), (n, bands)).copy()
        for i in range(rows):
            key = mix64(key * _U(_BASE) + values[:, i * bands : (i + 1) * bands])
    return key


def odd_sketches(values: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: every filled sample flips the bit that its bin and value hash to."""
    n, bins = values.shape
    out = np.zeros(n * (bits // 64), dtype=np.uint64)
    row, col = np.nonzero(filled)
    with np.errstate(over="ignore"):
        at = mix64(values[row, col] + col.astype(np.uint64) * _U(_BASE)) % _U(bits)
    np.bitwise_xor.at(out, row * (bits // 64) + (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out.reshape(n, bits // 64)
