"""Array kernels over the UTF-8 bytes of many texts at once; they run inside Spark's Arrow tasks.

A slice of texts is one byte array with offsets. Words are ``[^\\x20\\x09-\\x0D]+``; their hashes come from one
prefix sum of ``byte * B**i`` modulo 2**64, so that no loop runs over bytes or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Any odd base can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes in one slice; a single longer text forms a slice of its own.
SLICE = 1 << 20
#: A text over so many bytes is read in parts.
LONG = 4 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's lifetime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 4096)
        have = np.empty(size, U)
        have[0] = 1
        k = 1
        while k < size:
            step = U(pow(base, k, 1 << 64))
            m = min(k, size - k)
            np.multiply(have[:m], step, out=have[k : k + m])
            k += m
        if size <= 8 * SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of one bigint column."""
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rotl(v: np.ndarray, r: int) -> np.ndarray:
        return (v << U(r)) | (v >> U(64 - r))

    h = rotl(x.astype(np.int64).view(U) * p2, 31) * p1 ^ (p5 + U(seed) + U(8))
    h = rotl(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return h ^ (h >> U(32))


def utf8_parts(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of an Arrow text or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.string()
    col = col.fill_null(b"" if kind == pa.binary() else "")
    if kind == pa.string():
        col = col.cast(pa.large_string())
    else:
        col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n+1 entries)."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[b]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(BASE, len(b)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(BASE_INV, len(b))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words_of(b: np.ndarray, offsets: np.ndarray, lower: bool = True, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and for each text the index of its first word (n+1 entries).

    A slice of more than ``long`` bytes is one very long text: it is read in parts that end between words, and a word that
    is longer than a part in pieces, so that little more than the hashes is held.
    """
    fold = LOWER if lower else np.arange(256, dtype=np.uint8)
    if len(b) <= long or len(offsets) > 2:
        b = fold[b]
        s, e, first = word_spans(b, offsets)
        return word_hashes(b, s, e), first
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + long)
        if end < len(b):
            gap = np.flatnonzero(SPACE[b[at:end]])
            if not len(gap):
                while end < len(b) and not SPACE[b[end]]:
                    more = np.flatnonzero(SPACE[b[end : end + long]])
                    end = end + int(more[0]) if len(more) else min(len(b), end + long)
                total = 0
                for k in range(at, end, long):
                    part = fold[b[k : min(end, k + long)]]
                    total += pow(BASE, k - at, 1 << 64) * int(((part.astype(U) + U(1)) * powers(BASE, len(part))).sum(dtype=U))
                out.append(mix(np.array([(total + (end - at) * 0xD6E8FEB86659FD93) % (1 << 64)], U)))
                at = end
                continue
            end = at + int(gap[-1]) + 1
        part = fold[b[at:end]]
        s, e, _ = word_spans(part, np.array([0, len(part)]))
        out.append(word_hashes(part, s, e))
        at = end
    h = np.concatenate(out)
    return h, np.array([0, len(h)])


def chain(*parts: np.ndarray) -> np.ndarray:
    """An ordered hash of several hash columns."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * U(0x2545F4914F6CDD1D | 1) + p)
    return h


def word_ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and their text's row; shorter texts with words give their whole sequence."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    if len(h) >= n:
        m = len(h) - n + 1
        good = row[:m] == row[n - 1 :]
        grams = chain(*(h[i : m + i] for i in range(n)))[good]
        at = row[:m][good]
    else:
        grams, at = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for r in short:
            seq = h[first[r] : first[r + 1]]
            extra.append(chain(*(seq[i : i + 1] for i in range(len(seq))), np.array([len(seq)], U))[0])
        grams = np.concatenate([grams, np.array(extra, U)])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, at


def distinct_by_row(grams: np.ndarray, at: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, concatenated, with n_rows+1 offsets. ``at`` must ascend."""
    cuts = np.searchsorted(at, np.arange(n_rows + 1))
    out, sizes = [], np.zeros(n_rows, np.int64)
    for r in range(n_rows):
        if cuts[r + 1] > cuts[r]:
            g = np.sort(grams[cuts[r] : cuts[r + 1]])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            g = g[keep]
            out.append(g)
            sizes[r] = len(g)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(col, n: int, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of an Arrow text column: first row, end row, sorted distinct shingle hashes, offsets."""
    data, offsets = utf8_parts(col)
    for i, j, b, o in slices(data, offsets):
        h, first = words_of(b, o, lower)
        g, at = word_ngrams(h, first, n)
        yield i, j, *distinct_by_row(g, at, j - i)
