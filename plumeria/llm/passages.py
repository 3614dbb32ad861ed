"""Operator 2: removal of passages that start in an earlier document too, by a column-wise suffix construction.

A k-byte string that two documents share holds the same *anchor* in both: the m-byte substring of least hash, leftmost
on ties. So all k-byte windows of the corpus fall into runs with one anchor, and equal windows meet in the bucket of
their anchor's hash. The plan, with texts shuffled twice by document and nothing collected:

1. Each document sends its anchors' short fingerprints to buckets; those seen in two documents are sent back. Where one
   task sees a fingerprint in two documents it tells their homes itself, so a bucket gets one entry a task at most.
2. Documents send the *fragments* (a run of windows with one anchor, at most 2k-m bytes) of such anchors to buckets.
   Equal fragments of one batch are sent once, with their smallest document; the others are known to be removed.
   Anchors of very many places are cut into single windows, which go by their own hash.
3. A bucket builds the Burrows-Wheeler transform of its collection of fragments with common prefixes, column by column:
   each round inserts one symbol of every fragment, reading the transform and the prefix lengths of the round before
   from a sequential file in blocks and writing the next. The two files are scratch of one task attempt and hold nothing
   that another needs. Runs of prefixes >= k are equal windows; their smallest document decides. Of a fragment only the
   windows near whose anchor another fragment agrees take part: others have no equal.
4. The removed ranges go back to their documents, which are cut.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import batch_of, home, pack, runs_of, send_texts, unpack
from .store import text_bytes, written
from .textkernels import BASE, BASE_INV, U, mix, powers, slices, utf8_parts
from .workers import trimmed

POS_BITS = 24
FLUSH = 16 << 20
#: Symbols of one collection, about; all strings of one anchor are in one.
COLLECTION = 200_000
#: Entries of the transform in memory at a time, at most 1 << 16.
BLOCK = 1 << 16
#: Where each symbol begins among keys of a symbol and 16 bits.
EDGES = np.arange(257, dtype=np.uint32) << np.uint32(16)
#: Anchors with this many places are cut into windows; one in SAMPLE rows estimates them.
HOT, SAMPLE = 200_000, 32


def anchored(b: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Runs of k-byte windows with one anchor: text row, first window, end of last window, anchor hash, content hash."""
    n = len(b)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    if n < k:
        return none
    sums = np.zeros(n + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    back = powers(BASE_INV, n)
    grams = mix((sums[m:] - sums[: n - m + 1]) * back[: n - m + 1])
    low = grams & ~U((1 << POS_BITS) - 1)
    low |= np.arange(len(low), dtype=U)
    width, have = k - m + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: n - k + 1], low[width - have : width - have + n - k + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: n - k + 1] == row[k - 1 :]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    at = (low[start] & U((1 << POS_BITS) - 1)).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = start[new]
    end = np.append(start[np.flatnonzero(new)[1:] - 1], start[-1]) + k
    content = mix((sums[end] - sums[first]) * back[first] + (end - first).astype(U) * U(0xD6E8FEB86659FD93))
    return row[first], first, end, grams[at[new]], content


def pieces(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Slices of whole texts, and overlapping parts of very long ones: first row, end row, offset in the text, bytes, offsets."""
    most = 1 << (POS_BITS - 1)
    for i, j, b, o in slices(data, offsets):
        for at in range(0, max(1, len(b) - k + 1), most) if len(b) > most + k else (0,):
            part = b[at : at + most + k - 1] if len(b) > most + k else b
            yield i, j, at, part, (np.array([0, len(part)]) if len(b) > most + k else o)


FINGER = U((1 << 40) - 1)


def bucket_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each anchor, from the upper 40 bits of its hash."""
    return ((anchor >> U(24)) % U(parts)).astype(np.int64)


def by_home(to: np.ndarray, finger: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct fingerprints of each home, in order."""
    if len(to) and int(to.max()) < 1 << 24:  # both fit in 64 bits
        key = np.unique((to.astype(U) << U(40)) | finger)
        to, finger = (key >> U(40)).astype(np.int64), key & FINGER
    else:
        order = np.lexsort((finger, to))
        to, finger = to[order], finger[order]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1]) | (finger[1:] != finger[:-1])
        to, finger = to[new], finger[new]
    for v, s, e in runs_of(to):
        yield v, finger[s:e]


def _send_fingers(k: int, m: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            many = np.repeat(doc[first] != doc[np.append(first[1:], len(doc)) - 1], np.diff(np.append(first, len(doc))))
            to = home(doc, parts)
            # two documents here have it: their homes are told at once, and the bucket gets one entry, however hot it is
            for v, finger in by_home(to[many], anchor[many] & FINGER):
                yield _row(v, True, finger)
            once = np.concatenate([first[~many[first]], first[many[first]]])
            where = np.where(many[once], -1, to[once])
            bucket = bucket_of(anchor[once], parts)
            order = np.lexsort((anchor[once] & FINGER, where, bucket))
            once, where, bucket = once[order], where[order], bucket[order]
            for v, s, e in runs_of(bucket):
                yield _row(v, False, anchor[once[s:e]] & FINGER, where[s:e])

        def _row(to: int, known: bool, finger: np.ndarray, where: np.ndarray | None = None) -> tuple[int, bool, bytes]:
            five = np.ascontiguousarray(finger).view(np.uint8).reshape(-1, 8)[:, :5]
            return to, known, pack(np.ascontiguousarray(five).ravel(), *(() if where is None else (where.astype(np.int32),)))

        def batch() -> pa.RecordBatch:
            to, known, data = zip(*flush(), strict=True)
            return batch_of(bucket=pa.array(to, pa.int32()), known=pa.array(known), data=pa.array(data, pa.binary()))

        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, _, b, o in pieces(*utf8_parts(part.column(1)), k):
                row, _, _, anchor, _ = anchored(b, o, k, m)
                if len(anchor):
                    held.append((anchor, ids[i + row]))
                size += len(b)
                if size > FLUSH and held:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return run


def _fingers(five: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(five) // 5, 8), np.uint8)
    wide[:, :5] = five.reshape(-1, 5)
    return wide.view(U).ravel()


def _shared_fingers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: fingerprints of two documents or more, for each home; what homes are told goes on to them."""
    got: list[tuple] = []
    for batch in batches:
        for to, known, blob in zip(batch.column("bucket").to_pylist(), batch.column("known").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if known:
                yield batch_of(home=pa.array([to], pa.int32()), data=pa.array([blob], pa.binary()))
            else:
                five, where = unpack(blob, np.uint8, np.int32)
                got.append((_fingers(five), where, np.full(len(where), len(got), np.int32)))
    if not got:
        return
    finger, to, sender = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(finger, kind="stable")
    finger, to, sender = finger[order], to[order], sender[order]
    first = np.flatnonzero(np.concatenate([[True], finger[1:] != finger[:-1]]))
    shared = (np.minimum.reduceat(to, first) < 0) | (np.minimum.reduceat(sender, first) != np.maximum.reduceat(sender, first))
    keep = np.repeat(shared, np.diff(np.append(first, len(finger)))) & (to >= 0)
    finger, to = finger[keep], to[keep]
    order = np.argsort(to, kind="stable")
    finger, to = finger[order], to[order]
    for v, s, e in runs_of(to):
        five = np.ascontiguousarray(np.ascontiguousarray(np.unique(finger[s:e])).view(np.uint8).reshape(-1, 8)[:, :5]).ravel()
        yield batch_of(home=pa.array([v], pa.int32()), data=pa.array([pack(five)], pa.binary()))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document, with those that touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def split_windows(fragments: tuple[np.ndarray, ...], hot: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Fragments (document, place, length, anchor, content, bytes) with those of hot anchors cut into single windows.

    A window goes by its own hash then, so that no bucket and no collection holds all strings of an anchor that recurs
    in very many contexts.
    """
    doc, at, length, anchor, content, text = fragments
    if not len(hot):
        return fragments
    is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    if not is_hot.any():
        return fragments
    place = np.cumsum(length) - length
    count = length[is_hot] - k + 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(place[is_hot], count) + step
    sums = np.concatenate([[U(0)], np.cumsum((text.astype(U) + U(1)) * powers(BASE, len(text)))])
    own = mix((sums[start + k] - sums[start]) * powers(BASE_INV, len(text))[start] + U(k) * U(0xD6E8FEB86659FD93))
    cold = ~is_hot
    flat = text[np.repeat(place[cold], length[cold]) + np.arange(length[cold].sum()) - np.repeat(np.cumsum(length[cold]) - length[cold], length[cold])]
    windows = text[(start[:, None] + np.arange(k)).ravel()]
    return (
        np.concatenate([doc[cold], np.repeat(doc[is_hot], count)]), np.concatenate([at[cold], np.repeat(at[is_hot], count) + step]),
        np.concatenate([length[cold], np.full(len(start), k)]), np.concatenate([anchor[cold], mix(own + U(0x5851F42D4C957F2D))]),
        np.concatenate([content[cold], own]), np.concatenate([flat, windows]),
    )


def _send_fragments(k: int, m: int, parts: int, hot: np.ndarray):
    """Rows of one home: kind 0 with shared fingerprints, then kind 1 with packed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, known, held, size = [], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, at, length, anchor, content, text = split_windows(tuple(np.concatenate([h[c] for h in held]) for c in range(6)), hot, k)
            place = np.cumsum(length) - length
            order = np.lexsort((at, doc, content))
            c, d = content[order], doc[order]
            first = np.concatenate([[True], c[1:] != c[:-1]])
            head = d[np.flatnonzero(first)][np.cumsum(first) - 1]
            send = np.zeros(len(doc), bool)
            send[order] = d == head
            local = merged(doc[~send], at[~send], (at + length)[~send])
            sel = np.flatnonzero(send)
            sel = sel[np.lexsort((at[sel], doc[sel], bucket_of(anchor[sel], parts)))]
            bucket = bucket_of(anchor[sel], parts)
            took = length[sel]
            step = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
            flat = text[np.repeat(place[sel], took) + step]
            ends = np.cumsum(took)
            out = {"bucket": [], "data": []}
            for v, s, e in runs_of(bucket):
                x = sel[s:e]
                out["bucket"].append(v)
                out["data"].append(pack(anchor[x], doc[x], at[x], length[x].astype(np.uint16), flat[ends[s] - took[s] : ends[e - 1]], *(np.zeros(0, np.int64),) * 3))
            if len(local[0]):
                out["bucket"].append(int(home(local[0][:1], parts)[0]))
                out["data"].append(pack(*(np.zeros(0, np.int64),) * 5, *local))
            yield batch_of(bucket=pa.array(out["bucket"], pa.int32()), data=pa.array(out["data"], pa.binary()))

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for r in np.flatnonzero(kinds == 0):
                shared.append(_fingers(unpack(batch.column("data")[int(r)].as_py(), np.uint8)[0]))
            docs = np.flatnonzero(kinds == 1)
            if not len(docs):
                continue
            if known is None:
                known = np.unique(np.concatenate(shared)) if shared else np.zeros(0, U)
            for r in docs if len(known) else ():
                ids, sizes, data = unpack(batch.column("data")[int(r)].as_py(), np.int64, np.int64, np.uint8)
                for i, _, base, b, o in pieces(data, np.concatenate([[0], np.cumsum(sizes)]), k):
                    row, s, e, anchor, content = anchored(b, o, k, m)
                    finger = anchor & FINGER
                    keep = known[np.minimum(np.searchsorted(known, finger), len(known) - 1)] == finger
                    if not keep.any():
                        continue
                    row, s, e = row[keep], s[keep], e[keep]
                    took = e - s
                    step = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took)
                    held.append((ids[i + row], s - o[row] + base, took, anchor[keep], content[keep], b[np.repeat(s, took) + step]))
                    size += len(held[-1][5])
                    if size > FLUSH:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return run


def _symbol(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8)[2::4])


def _prefix(x: np.ndarray) -> np.ndarray:
    """The prefix lengths of entries, with one place more."""
    return np.append(x.view(np.int16)[::2], np.int16(0x7FFF))


def _blocks(file, size: int) -> Iterator[np.ndarray]:
    """The entries of a file, in order."""
    file.seek(0)
    at = 0
    while at < size:
        block = np.fromfile(file, np.uint32, min(BLOCK, size - at))
        yield block
        at += len(block)


class Runs:
    """Runs of equal symbols in a block of the transform, also in the order of their symbols.

    Strings with one anchor are much alike, so runs are long; occurrences of a symbol are counted and found by its runs.
    """

    def __init__(self, block: np.ndarray) -> None:
        symbol = _symbol(block)
        self.start = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        self.end = np.append(self.start[1:], len(block))
        key = (symbol[self.start].astype(np.uint32) << np.uint32(16)) | np.arange(len(self.start), dtype=np.uint32)
        key.sort()
        self.order = (key & np.uint32(0xFFFF)).astype(np.int64)
        self.rank = np.empty(len(key), np.int64)
        self.rank[self.order] = np.arange(len(key))
        #: The first run of each symbol in that order, and the entries before each run.
        self.first = np.searchsorted(key, EDGES)
        self.before = np.concatenate([[0], np.cumsum((self.end - self.start)[self.order])])
        self.count = np.diff(self.before[self.first])


def collection_bwt(text: np.ndarray, ends: np.ndarray, files: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """BWT and common prefix lengths of a collection of short strings, one inserted symbol for each string and round.

    text holds symbols >= 1; string i is text[ends[i-1]:ends[i]] and ends in a terminator of its own, below all symbols.
    An entry holds its symbol (0: start of a string) and its common prefix with the entry above, up to 4095. Every round
    reads the transform of the round before from one of the two files in blocks, and writes its own to the other; in memory
    are a block and one place for each string. Yields symbols and prefix lengths of the last transform, block by block.
    """
    n = len(ends)
    length = np.diff(np.concatenate([[0], ends]))
    live = np.arange(n)  # strings that go on, by the place of their latest suffix
    q = np.arange(n)  # these places
    closed = 0  # starts of strings, which are never extended
    here, there = files
    here.seek(0)
    (text[ends - 1].astype(np.uint32) << np.uint32(16)).tofile(here)
    size = n
    total = np.bincount(text[ends - 1], minlength=256)
    for t in range(1, int(length.max()) + 1):
        last = text[ends[live] - t]
        c = last.astype(np.int64)
        below = np.cumsum(total) - total
        r, over, under = np.empty(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        has_down = np.zeros(len(q), bool)
        # pass 1: ranks, and prefixes shared with the neighbouring occurrences of the symbol, whose extensions stand next to the new suffix
        seen, carry, waits = np.zeros(256, np.int64), np.full(256, 0x7FFF), np.full(256, -1)
        at = lo = 0
        for block in _blocks(here, size):
            hi = int(np.searchsorted(q, at + len(block)))
            runs, prefix = Runs(block), _prefix(block)
            mine, sym = q[lo:hi] - at, c[lo:hi]
            run = np.searchsorted(runs.start, mine, "right") - 1
            start, rank = runs.start[run], runs.rank[run]
            r[lo:hi] = (below + seen - runs.before[runs.first[:-1]])[sym] + runs.before[rank] + mine - start
            # the neighbouring occurrence is in the same run, in another run of the symbol in this block, or not in this block
            near = mine > start
            far = ~near & (rank == runs.first[sym])
            over[lo:hi] = prefix[mine] + 1
            if len(edge := np.flatnonzero(~near & ~far)):
                pair = np.stack([runs.end[runs.order[rank[edge] - 1]], mine[edge] + 1], axis=1).ravel()
                over[lo + edge] = np.minimum.reduceat(prefix, pair)[::2] + 1
            near = mine + 1 < runs.end[run]
            awaited = ~near & (rank + 1 == runs.first[sym + 1])
            under[lo:hi] = prefix[mine + 1] + 1
            if len(edge := np.flatnonzero(~near & ~awaited)):
                pair = np.stack([mine[edge] + 1, runs.start[runs.order[rank[edge] + 1]] + 1], axis=1).ravel()
                under[lo + edge] = np.minimum.reduceat(prefix, pair)[::2] + 1
            has_down[lo:hi] = ~awaited
            if size > len(block):
                own = np.flatnonzero(runs.count)
                # least prefix down to each symbol's first occurrence, and after its last one
                spot = runs.start[runs.order[runs.first[own]]]
                by = np.argsort(spot)
                least = np.zeros(256, np.int64)
                least[own[by]] = np.minimum.accumulate(np.minimum.reduceat(prefix[: spot[by[-1]] + 1], np.append(0, spot[by[:-1]] + 1)))
                spot = runs.end[runs.order[runs.first[own + 1] - 1]]
                by = np.argsort(spot)
                rest = np.minimum.accumulate(np.minimum.reduceat(prefix, spot[by])[::-1])[::-1]
                over[lo:hi][far] = np.where(seen[sym[far]] > 0, np.minimum(carry[sym[far]], least[sym[far]]) + 1, 0)
                # symbols whose next occurrence was awaited have it here
                met = own[waits[own] >= 0]
                under[waits[met]] = np.minimum(carry[met], least[met]) + 1
                has_down[waits[met]] = True
                waits[met] = -1
                waits[sym[awaited]] = lo + np.flatnonzero(awaited)
                carry = np.minimum(carry, prefix.min())
                carry[own[by]] = rest
                seen += runs.count
            else:
                over[lo:hi][far] = 0
            at, lo = at + len(block), hi
        # pass 2: terminators come first, then all suffixes by their first symbol, that is by the rank of that symbol
        rank = np.argsort(last, kind="stable")
        spot, live = (n + r - closed)[rank], live[rank]
        lower = under[rank].astype(np.uint32)
        ended = length[live] == t
        symbol = np.where(ended, 0, text[np.maximum(ends[live] - t - 1, 0)])
        entry = (symbol.astype(np.uint32) << np.uint32(16)) | over[rank].astype(np.uint32)
        old = spot - np.arange(len(rank))  # the entry that each new one is put before
        fix = has_down[rank] & (np.append(np.diff(spot), 0) != 1)
        there.seek(0)
        at = lo = 0
        for block in _blocks(here, size) if len(block) < size else [block]:
            hi = int(np.searchsorted(old, at + len(block))) if at + len(block) < size else len(old)
            mend = np.flatnonzero(fix[lo:hi] & (old[lo:hi] < size)) + lo
            block[old[mend] - at] = (block[old[mend] - at] & np.uint32(0xFF0000)) | lower[mend]
            fresh = np.empty(len(block) + hi - lo, np.uint32)
            mask = np.ones(len(fresh), bool)
            new = old[lo:hi] - at + np.arange(hi - lo)
            mask[new] = False
            fresh[mask] = block
            fresh[new] = entry[lo:hi]
            fresh.tofile(there)
            at, lo = at + len(block), hi
        total += np.bincount(symbol, minlength=256)
        closed += int(ended.sum())
        size += len(rank)
        live, q = live[~ended], spot[~ended]
        here, there = there, here
    for block in _blocks(here, size):
        yield _symbol(block), _prefix(block)[:-1]


def suffix_places(symbols: tuple[np.ndarray, ...], ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The string and the length of the suffix at each place of a transform in blocks; length 0 for those below ``least``.

    A string is read off backwards from its terminator: an entry's extension by its symbol stands at that symbol's rank.
    """
    n, size = len(ends), sum(map(len, symbols))
    total = sum(np.bincount(s, minlength=256) for s in symbols)
    seen = np.cumsum(total) - total + n - total[0]
    to = np.empty(size, np.int32 if size < 1 << 31 else np.int64)
    at = 0
    for s in symbols:
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=256)
        to[at + order] = np.repeat(seen - (np.cumsum(count) - count), count) + np.arange(len(s))
        seen += count
        at += len(s)
    owner, left = np.zeros(size, np.int32 if n < 1 << 31 else np.int64), np.zeros(size, np.int16)
    length = np.diff(np.concatenate([[0], ends]))
    live = place = np.arange(n)
    for t in range(1, int(length.max()) + 1):
        place = to[place]
        if t >= least:
            owner[place], left[place] = live, t
        on = length[live] > t
        live, place = live[on], place[on]
    return owner, left


def common_parts(text: np.ndarray, ends: np.ndarray, anchor: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each string's windows that another string may have too; both are equal where there are none.

    Windows fall into five classes by where the anchor stands in them. Equal windows are of one class and agree in the bytes
    around the anchor that all windows of the class hold; a string keeps its windows from the first to the last class in
    which another string agrees. Strings without their anchor (single windows of hot ones) stay whole.
    """
    start = np.concatenate([[0], ends[:-1]])
    sums = np.zeros(len(text) + 1, U)
    np.cumsum((text.astype(U) + U(1)) * powers(BASE, len(text)), out=sums[1:])
    back = powers(BASE_INV, len(text))
    string = np.repeat(np.arange(len(ends)), ends - start)[: len(text) - m + 1]
    hit = np.flatnonzero(mix((sums[m:] - sums[:-m]) * back[: len(string)]) == anchor[string])
    hit = hit[hit + m <= ends[string[hit]]]
    new = np.ones(len(hit), bool)
    new[1:] = string[hit[1:]] != string[hit[:-1]]
    at = hit[new]  # a string's first occurrence is its anchor
    own = string[at]
    first, last = start.copy(), ends.copy()
    first[own], last[own] = ends[own], start[own]
    step = -(-(k - m + 1) // 5)
    for before in range(0, k - m + 1, step):
        after = max(0, k - m - before - step + 1)
        x = np.flatnonzero((at - before >= start[own]) & (at + m + after <= ends[own]))
        s, e = at[x] - before, at[x] + m + after
        _, which, count = np.unique((sums[e] - sums[s]) * back[s], return_inverse=True, return_counts=True)
        x = x[count[which] > 1]
        first[own[x]] = np.minimum(first[own[x]], at[x] - before - step + 1)
        last[own[x]] = np.maximum(last[own[x]], at[x] - before + k)
    first, last = np.maximum(first, start), np.minimum(last, ends)
    return first, np.where(last - first < k, first, last)


def equal_windows(text: np.ndarray, ends: np.ndarray, doc: np.ndarray, anchor: np.ndarray, k: int, m: int, files: list) -> np.ndarray:
    """For each position of the strings, the smallest document of any string with the k-byte window that starts there.

    Strings of one anchor form one collection with those of other anchors. A bucket's collections share two files.
    """
    length = np.diff(np.concatenate([[0], ends]))
    out = np.repeat(doc, length)
    order = np.argsort(anchor, kind="stable")
    group = np.cumsum(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])) - 1
    # an anchor with one string shares its windows with no other string
    order = order[np.bincount(group)[group] > 1]
    if not len(order):
        return out
    took = length[order]
    stop = np.cumsum(took)
    shift = ends[order] - stop
    first, last = common_parts(text[np.repeat(shift, took) + np.arange(stop[-1])], stop, anchor[order], k, m)
    some = last > first
    order, first, took = order[some], (first + shift)[some], (last - first)[some]
    if not len(order):
        return out
    new = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
    group = np.cumsum(new) - 1
    batch = (np.cumsum(took) - took)[np.flatnonzero(new)] // -(-took.sum() // max(1, round(took.sum() / COLLECTION)))
    for _, s, e in runs_of(batch[group]):
        stop = np.cumsum(took[s:e])
        at = np.repeat(first[s:e] + took[s:e] - stop, took[s:e]) + np.arange(stop[-1])
        out[at] = np.minimum(out[at], collection_windows(text[at], stop, doc[order[s:e]], k, files))
    return out


def collection_windows(text: np.ndarray, ends: np.ndarray, doc: np.ndarray, k: int, files: list) -> np.ndarray:
    """equal_windows() of one collection, by its transform and common prefixes."""
    used = np.unique(text)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    symbols, new = zip(*((symbol, prefix < k) for symbol, prefix in collection_bwt(code[text], ends, files)), strict=True)
    owner, left = suffix_places(symbols, ends, k)
    out = np.full(len(text), np.iinfo(np.int64).max)
    full = np.flatnonzero(left)
    if len(full):
        new = np.concatenate(new)[full]
        new[0] = True
        owner = owner[full]
        least = np.minimum.reduceat(doc[owner], np.flatnonzero(new))
        out[ends[owner] - left[full]] = least[np.cumsum(new) - 1]
    return out


def _ranges(k: int, m: int, parts: int):
    """One bucket of fragments: the ranges to remove, for each home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, local = [], []
        for batch in batches:
            for blob in batch.column("data").to_pylist():
                *own, d, s, e = unpack(blob, U, np.int64, np.int64, np.uint16, np.uint8, np.int64, np.int64, np.int64)
                # "own" of a blob with ranges only is empty
                if len(own[0]):
                    got.append(own)
                if len(d):
                    local.append((d, s, e))
        result = [tuple(np.concatenate(x) for x in zip(*local, strict=True))] if local else []
        if got:
            anchor, doc, at, length, text = (np.concatenate(x) for x in zip(*got, strict=True))
            length = length.astype(np.int64)
            start = np.cumsum(length) - length
            order = np.argsort(anchor, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
            many = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
            keep = np.zeros(len(doc), bool)
            keep[order] = np.repeat(many, np.diff(np.append(first, len(doc))))
            sel = np.flatnonzero(keep)
            if len(sel):
                doc, at, length, start = doc[sel], at[sel], length[sel], start[sel]
                sums = np.zeros(len(text) + 1, U)
                np.cumsum((text.astype(U) + U(1)) * powers(BASE, len(text)), out=sums[1:])
                content = mix((sums[start + length] - sums[start]) * powers(BASE_INV, len(text))[start] + length.astype(U) * U(0xD6E8FEB86659FD93))
                _, pick, inverse = np.unique(content, return_index=True, return_inverse=True)
                least = np.full(len(pick), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, doc)
                took = length[pick]
                ends = np.cumsum(took)
                flat = text[np.repeat(start[pick] - (ends - took), took) + np.arange(ends[-1])]
                with tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
                    windows = equal_windows(flat, ends, least, anchor[sel][pick], k, m, [one, two])
                count = length - k + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                gone = windows[np.repeat((ends - took)[inverse], count) + step] < np.repeat(doc, count)
                s = (np.repeat(at, count) + step)[gone]
                result.append((np.repeat(doc, count)[gone], s, s + k))
        if not result:
            return
        doc, s, e = merged(*(np.concatenate(x) for x in zip(*result, strict=True)))
        to = home(doc, parts)
        order = np.argsort(to, kind="stable")
        doc, s, e, to = doc[order], s[order], e[order], to[order]
        for v, i, j in runs_of(to):
            yield batch_of(home=pa.array([v], pa.int32()), data=pa.array([pack(doc[i:j], s[i:j], e[i:j])], pa.binary()))

    return run


def _cut(names: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, ranges = [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for r in np.flatnonzero(kinds == 0):
                got.append(unpack(batch.column("data")[int(r)].as_py(), np.int64, np.int64, np.int64))
            docs = np.flatnonzero(kinds == 1)
            if not len(docs):
                continue
            if ranges is None:
                ranges = merged(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else (np.zeros(0, np.int64),) * 3
            part = batch.slice(int(docs[0]), len(docs))
            data, offsets = utf8_parts(part.column("text"))
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            texts = []
            for r, doc in enumerate(part.column("doc_id").to_pylist()):
                b = data[offsets[r] : offsets[r + 1]]
                lo, hi = (0, 0) if doc is None else (np.searchsorted(ranges[0], doc, side) for side in ("left", "right"))
                out["n_bytes"].append(len(b))
                out["n_spans"].append(int(hi - lo))
                out["n_removed"].append(int((ranges[2][lo:hi] - ranges[1][lo:hi]).sum()))
                if hi > lo:
                    edges = np.concatenate([[0], np.stack([ranges[1][lo:hi], ranges[2][lo:hi]], axis=1).ravel(), [len(b)]])
                    b = np.concatenate([b[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2)])
                out["kept_sha256"].append(hashlib.sha256(b).hexdigest())
                if with_text:
                    texts.append(b.tobytes().decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if x == "text" else part.column(x) for x in names]
            columns += [pa.array(out[x], pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *out])

    return run


def hot_anchors(plain: DataFrame, k: int, m: int, hot: int, sample: int) -> np.ndarray:
    """Anchors with about ``hot`` places or more, sorted, from one row in ``sample``.

    This only balances load, as range partitioning does with its sample: results are the same for any set of hot anchors.
    The estimate of ``hot`` places bounds the set to the corpus's places over ``hot``, some 500 bytes for each terabyte.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate(held), return_counts=True)
            return batch_of(anchor=pa.array(anchor[n > 1].view(np.int64)), n=pa.array(n[n > 1]))

        for batch in batches:
            for _, _, _, b, o in pieces(*utf8_parts(batch.column(0)), k):
                held.append(anchored(b, o, k, m)[3])
                size += len(b)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    some = plain.select("text").sample(1 / sample, 7) if sample > 1 else plain.select("text")
    found = some.mapInArrow(trimmed(count), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= hot / sample)
    return np.sort(np.array([r.anchor for r in found.select("anchor").collect()], np.int64).view(U))


def dedup_passages(
    docs: DataFrame, k: int = 50, anchor: int = 18, with_text: bool = True, partition_bytes: int = 8 << 20, hot: int = HOT, sample: int = SAMPLE
) -> DataFrame:
    """The columns of docs (doc_id, text, ...) with the text cut, and n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte covered by a k-byte string that also starts in a document with a smaller doc_id, judged on the
    input. kept_sha256 is of the kept bytes; ``text`` is what of them is whole characters (a null text is returned as
    empty). Texts shorter than k lose nothing. A row with a null doc_id is neither cut nor compared. Repeated rows have one
    doc_id and so do not cut each other; a doc_id stands for one text. Columns of docs named home, kind, data, n_bytes,
    n_removed, n_spans or kept_sha256 are returned as own__home and so on. k is from ``anchor`` to 2,000.
    """
    if not 0 < anchor <= k <= 2000:
        raise ValueError("k has to be between the anchor's length and 2000")
    clash = {"home", "kind", "data", "n_bytes", "n_removed", "n_spans", "kept_sha256"} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"own__{c}" for c in clash})
    names = renamed.columns if with_text else ["doc_id"]
    parts = max(64, text_bytes(docs) // partition_bytes)
    plain = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    often = hot_anchors(plain, k, anchor, hot, sample)
    fingers = plain.mapInArrow(trimmed(_send_fingers(k, anchor, parts)), "bucket int, known boolean, data binary")
    shared = fingers.repartitionById(parts, "bucket").mapInArrow(trimmed(_shared_fingers), "home int, data binary")

    def at_home(left: DataFrame, right: DataFrame) -> DataFrame:
        # null ids are neither cut nor compared, so any home will do
        at = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(parts)).cast("int")
        there = right.withColumns({"home": at, "kind": F.lit(1), "data": F.lit(None).cast("binary")})
        both = left.withColumn("kind", F.lit(0)).unionByName(there, allowMissingColumns=True)
        return both.repartitionById(parts, "home").sortWithinPartitions("kind")

    packed = shared.withColumn("kind", F.lit(0)).unionByName(plain.mapInArrow(trimmed(send_texts(parts)), "home int, data binary").withColumn("kind", F.lit(1)))
    fragments = packed.repartitionById(parts, "home").sortWithinPartitions("kind").mapInArrow(trimmed(_send_fragments(k, anchor, parts, often)), "bucket int, data binary")
    ranges = fragments.repartitionById(parts, "bucket").mapInArrow(trimmed(_ranges(k, anchor, parts)), "home int, data binary")
    ranges = written(ranges, "ranges")
    schema = T.StructType([f for f in renamed.schema.fields if f.name in names])
    for f in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(f, T.LongType())
    schema = schema.add("kept_sha256", T.StringType())
    source = renamed if with_text else renamed.select("doc_id", "text")
    out = at_home(ranges, source).mapInArrow(trimmed(_cut(names, with_text)), schema)
    return out
