"""Operator 3: Jaccard self-join on word shingles, by T-occurrence search (DivideSkip) inside exact coarse clusters.

Plan, with no collected state and no bound on partners:

1. Every text becomes a set of 64-bit shingle hashes; texts with equal sets form one class (``k1, k2, n_shingles``).
2. Two linked sets of sizes s and t differ in at most (s+t)(1-j)/(1+j) shingles. Sets are split by hash into more
   parts than that, so two linked sets agree in at least one whole part that is not empty. Equal part signatures
   (about nine shingles each) make edges; their connected components are coarse clusters that hold every link.
3. In each cluster, T-occurrence search: a query's longest inverted lists are put aside, the short ones are merged
   and candidates that can still reach the overlap T are probed by binary search in the long ones. Clusters over
   ``block`` shingles are cut into blocks at random. Each block is searched, and packed as shingle hashes for the
   searches of pairs of blocks, so that no task holds an unbounded group and texts move once.
4. Components of the links give the classes of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packing import batch_of, home, pack, runs_of, send_texts, unpack
from .store import text_bytes, written
from .textkernels import U, mix, shingle_sets
from .workers import trimmed

SETS = "doc_id long, n_shingles long, k1 long, k2 long"
COUNTED = "bucket int, data binary"
SIGNED = "bucket int, edges boolean, data binary"


def set_keys(g: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit keys of each set; those of an empty set are 0."""
    full = np.flatnonzero(np.diff(o))
    k1, k2 = np.zeros(len(o) - 1, U), np.zeros(len(o) - 1, U)
    if len(full):
        k1[full] = mix(np.add.reduceat(mix(g), o[:-1][full]))
        k2[full] = mix(np.add.reduceat(mix(g ^ U(0x5851F42D4C957F2D)), o[:-1][full]))
    return k1, k2


class Parts:
    """Size classes and the number of parts that a pair of linked sets cannot all spoil."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        bounds = [1]
        while bounds[-1] < largest:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
        self.bounds = np.array(bounds, np.int64)
        differ = (100 - percent) * 2 * (self.bounds[1:] - 1) // (100 + percent)
        self.spare = (differ > 0).astype(np.int64)
        self.parts = differ + 1 + self.spare

    def signatures(self, g: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All part signatures of the sets, and the row of each."""
        sizes = np.diff(o)
        level = np.searchsorted(self.bounds, sizes, "right") - 1
        sigs, rows = [], []
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        for up in (0, 1):  # a set meets its own size class and, one level up, the next larger one
            at = np.clip(level + up, 0, len(self.parts) - 1)
            parts = np.where(sizes > 0, self.parts[at], 0)
            base = np.concatenate([[0], np.cumsum(parts)])
            slot = base[row_of] + ((g >> U(17)) % parts[row_of].astype(U)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
            total = np.zeros(base[-1], U)
            filled = np.zeros(base[-1], bool)
            if len(first):
                total[slot[first]] = np.add.reduceat(mix(g[order] + U(0x632BE59BD9B4E019)), first)
                filled[slot[first]] = True
            row = np.repeat(np.arange(len(sizes)), parts)
            part = np.arange(base[-1]) - base[row]
            empty = parts - np.bincount(row, filled, len(sizes)).astype(np.int64)
            keep = filled | (empty > self.spare[at])[row]  # enough empty parts to spoil the count: they take part too
            sig = mix(total + mix((at[row] * 0x100000001 + 7).astype(U) * U(0x9E3779B97F4A7C15) + part.astype(U)))
            sigs.append(sig[keep])
            rows.append(row[keep])
        return np.concatenate(sigs), np.concatenate(rows)


def word_shingles(words: int) -> Callable:
    """Sets of distinct shingles of lower-cased words, for the join."""
    return lambda col: shingle_sets(col, words)


def document_sets(docs: DataFrame, sets: Callable) -> DataFrame:
    """doc_id, n_shingles and the set's two keys, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, g, o in sets(batch.column(1)):
                n[i:j] = np.diff(o)
                k1, k2 = set_keys(g, o)
                a[i:j], b[i:j] = k1.view(np.int64), k2.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SETS)


def coarse_edges(docs: DataFrame, sets: Callable, percent: int, buckets: int) -> DataFrame:
    """Edges (a, b) between sets, by their first key, that share a part's signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, kept, size = Parts(percent), set(), [], 0

        def flush() -> pa.RecordBatch:
            sig, sid = (np.concatenate(x) for x in zip(*kept, strict=True))
            return heads_of(sig, sid, buckets)

        for batch in batches:
            for _, _, g, o in sets(batch.column(0)):
                k1, _ = set_keys(g, o)
                fresh = np.array([bool(n) and k not in seen and not seen.add(k) for k, n in zip(k1.tolist(), np.diff(o).tolist(), strict=True)], bool)
                if not fresh.any():
                    continue
                sizes = np.diff(o)
                g, o, k1 = g[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])]), k1[fresh]
                sig, row = parts.signatures(g, o)
                kept.append((sig, k1[row]))
                size += len(sig)
                if size > 1 << 20:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return linked(docs.select("text").mapInArrow(trimmed(sign), SIGNED), buckets)


def first_of(sig: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures in order, their sets, and the first set of each one's signature."""
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    return sig, sid, sid[np.flatnonzero(first)][np.cumsum(first) - 1]


def heads_of(sig: np.ndarray, sid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for the buckets: the first set of each signature here, and edges of the other sets with it.

    So a bucket gets one entry for a signature from each batch at most, however many sets have it.
    """
    sig, sid, head = first_of(sig, sid)
    far = sid != head
    lead = np.concatenate([[True], sig[1:] != sig[:-1]])
    bucket = ((sig[lead] >> U(40)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, first = sig[lead][order], sid[lead][order]
    rows = [(v, False, np.concatenate([own[s:e], first[s:e]]).tobytes()) for v, s, e in runs_of(bucket[order])]
    if far.any():
        pairs = np.unique(np.stack([sid[far], head[far]]), axis=1)
        rows.append((int(pairs[0, 0] % U(buckets)), True, pairs.tobytes()))
    to, edges, data = zip(*rows, strict=True)
    return batch_of(bucket=pa.array(to, pa.int32()), edges=pa.array(edges), data=pa.array(data, pa.binary()))


def linked(signed: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) of every set with the first set of each of its signatures, of that batch or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def edges(pairs: np.ndarray) -> pa.RecordBatch:
            return batch_of(a=pa.array(pairs[0].view(np.int64)), b=pa.array(pairs[1].view(np.int64)))

        for batch in batches:
            for known, blob in zip(batch.column("edges").to_pylist(), batch.column("data").to_pylist(), strict=True):
                pair = np.frombuffer(blob, U).reshape(2, -1)
                if known:
                    yield edges(pair)
                else:
                    held.append(pair)
        if held:
            sig, sid, head = first_of(*np.concatenate(held, axis=1))
            far = sid != head
            if far.any():
                yield edges(np.unique(np.stack([sid[far], head[far]]), axis=1))

    return signed.repartitionById(buckets, "bucket").mapInArrow(trimmed(run), "a long, b long")


def _rows_of(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order].astype(np.int64), [c[order] for c in columns]
    rows = [(v, pack(*(c[s:e] for c in columns))) for v, s, e in runs_of(bucket)]
    return batch_of(bucket=pa.array([v for v, _ in rows], pa.int32()), data=pa.array([b for _, b in rows], pa.binary()))


def rare_edges(docs: DataFrame, sets: Callable, percent: int, buckets: int, by_length: bool = False) -> DataFrame:
    """Edges (a, b) between sets that share one of the shingles that are rarest in both: the prefix filter.

    Under one order of all shingles, two sets with an overlap of t share one of the first ``size - t + 1`` shingles of each.
    The order is by how often a shingle's 32-bit fingerprint was sent, then by its hash. A shingle that was sent once has
    no partner, so texts that are mostly their own send nothing further, whatever lines they share with others. Hashes need
    all their 64 bits. ``by_length`` lets sets meet in their own size class and the next larger one only.
    """
    classes = Parts(percent).bounds

    def fingers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            token, to = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token, kind="stable")
            token, to = token[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(first, len(token)))
            times = np.repeat(np.minimum(count, 255), count).astype(np.uint8)
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (to[1:] != to[:-1])
            token, to, times = token[keep], to[keep].astype(np.int32), times[keep]
            order = np.lexsort((to, (token >> U(40)) % U(buckets)))
            token, to, times = token[order], to[order], times[order]
            return _rows_of((token >> U(40)) % U(buckets), (token & U(0xFFFFFFFF)).astype(np.uint32), to, times)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, g, o in sets(batch.column(1)):
                k1, _ = set_keys(g, o)
                sizes = np.diff(o)
                fresh = np.array([bool(n) and k not in seen and not seen.add(k) for k, n in zip(k1.tolist(), sizes.tolist(), strict=True)], bool)
                if fresh.any():
                    held.append((g[np.repeat(fresh, sizes)], np.repeat(home(ids[i : i + len(sizes)], buckets)[fresh], sizes[fresh])))
                    size += len(held[-1][0])
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for batch in batches:
            for blob in batch.column("data").to_pylist():
                got.append((*unpack(blob, np.uint32, np.int32, np.uint8), len(got)))
        if not got:
            return
        finger, to, times = (np.concatenate([g[c] for g in got]) for c in range(3))
        sender = np.repeat(np.array([g[3] for g in got], np.int32), [len(g[0]) for g in got])
        order = np.lexsort((sender, finger))
        finger, to, times, sender = finger[order], to[order], times[order].astype(np.int64), sender[order]
        new = np.concatenate([[True], finger[1:] != finger[:-1]])
        once = new.copy()
        once[1:] |= sender[1:] != sender[:-1]
        first = np.flatnonzero(new)
        total = np.minimum(np.add.reduceat(np.where(once, times, 0), first), 255)
        total = np.repeat(total, np.diff(np.append(first, len(finger))))
        keep = total > 1
        if keep.any():
            # the fingerprints of different buckets are told apart by the bucket's number
            bucket = np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32)
            out = _rows_of(to[keep], finger[keep], total[keep].astype(np.uint8), bucket)
            yield pa.RecordBatch.from_arrays(out.columns, ["home", "data"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, known, totals = [], None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for r in np.flatnonzero(kinds == 0):
                finger, total, bucket = unpack(batch.column("data")[int(r)].as_py(), np.uint32, np.uint8, np.int32)
                got.append(((finger.astype(U) << U(24)) | bucket.astype(U), total))
            docs = np.flatnonzero(kinds == 1)
            if known is None and len(docs):
                known, totals = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, U), np.zeros(0, np.uint8))
                order = np.argsort(known)
                known, totals = known[order], totals[order]
            for r in docs if known is not None and len(known) else ():
                _, length, data = unpack(batch.column("data")[int(r)].as_py(), np.int64, np.int64, np.uint8)
                ends = np.concatenate([[0], np.cumsum(length)])
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                sig, sid = [], []
                for _, _, g, o in sets(texts):
                    sizes = np.diff(o)
                    full = ((g & U(0xFFFFFFFF)) << U(24)) | ((g >> U(40)) % U(buckets))
                    at = np.minimum(np.searchsorted(known, full), len(known) - 1)
                    total = np.where(known[at] == full, totals[at], 1)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    order = np.lexsort((g, total, row))
                    place = np.arange(len(g)) - o[:-1][row]
                    prefix = sizes - -(-percent * sizes // 100) + 1
                    use = (place < prefix[row]) & (total[order] > 1)
                    k1, _ = set_keys(g, o)
                    sent, to = g[order][use], row[use]
                    if by_length:
                        level = np.searchsorted(classes, sizes, "right")[to].astype(U)
                        sent, to = np.concatenate([mix(sent + mix(level + U(up))) for up in (0, 1)]), np.concatenate([to, to])
                    sig.append(sent)
                    sid.append(k1[to])
                sig, sid = np.concatenate(sig), np.concatenate(sid)
                if len(sig):
                    yield heads_of(sig, sid, buckets)

    plain = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    counted = plain.mapInArrow(trimmed(fingers), COUNTED).repartitionById(buckets, "bucket").mapInArrow(trimmed(count), "home int, data binary")
    both = counted.withColumn("kind", F.lit(0)).unionByName(plain.mapInArrow(trimmed(send_texts(buckets)), "home int, data binary").withColumn("kind", F.lit(1)))
    signed = both.repartitionById(buckets, "home").sortWithinPartitions("kind").mapInArrow(trimmed(prefixes), SIGNED)
    return linked(signed, buckets)


def divide_skip(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, mu: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, k) of left and right sets with 100 * |A and B| >= percent * |A or B|; right None: pairs i < k of left.

    The inverted lists cover the indexed sets. For a query with least overlap T, the L = T / (mu log2 M + 1) longest
    lists are put aside; the others are merged, and what occurs T - L times is probed in the long lists by binary
    search over the postings. Of a list that holds more than half of the sets, its complement is read instead.
    """
    index = left if right is None else right
    m = len(index)
    sizes = np.array([len(x) for x in index], np.int64)
    tokens = np.concatenate(index) if m else np.zeros(0, U)
    vocabulary, ids = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    postings = np.sort(ids.astype(np.int64) * m + owner)  # lists in order of token, owners ascending
    start = np.searchsorted(postings, np.arange(len(vocabulary) + 1) * m)
    length = np.diff(start)
    common = np.flatnonzero(2 * length > m)
    common_at = np.full(len(vocabulary), -1)
    common_at[common] = np.arange(len(common))
    held = np.zeros((len(common), m), bool)  # no larger than twice the postings
    row = common_at[ids]
    held[row[row >= 0], owner[row >= 0]] = True
    lack_row, lack_owner = np.nonzero(~held)
    lack_length = np.bincount(lack_row, minlength=len(common))
    lack_start = np.cumsum(lack_length) - lack_length
    out_a, out_b = [], []
    for i, q in enumerate(left):
        s = len(q)
        if not s or not m:
            continue
        at = np.searchsorted(vocabulary, q)
        at = np.minimum(at, len(vocabulary) - 1)
        lists = at[vocabulary[at] == q]
        least = -(-percent * s // 100)  # the smallest partner
        t = max(1, -(-percent * (s + least) // (100 + percent)))
        if len(lists) < t:
            continue
        aside = min(t - 1, int(t / (mu * np.log2(max(2, m)) + 1)))
        order = np.argsort(length[lists], kind="stable")
        short, long = lists[order[: len(order) - aside]], lists[order[len(order) - aside :]]
        runs = length[short]
        step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        who, count = np.unique(postings[np.repeat(start[short], runs) + step] % m, return_counts=True)
        fits = (count >= t - aside) & (sizes[who] * 100 >= percent * s) & (s * 100 >= percent * sizes[who])
        if right is None:
            fits &= who > i
        who, count = who[fits], count[fits]
        if not len(who):
            continue
        full = common_at[long]
        full, long = full[full >= 0], long[full < 0]
        if len(full):
            runs = lack_length[full]
            step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            count += len(full) - np.bincount(lack_owner[np.repeat(lack_start[full], runs) + step], minlength=m)[who]
        if len(long):
            for a in range(0, len(who), 4096):
                probe = long[None, :] * m + who[a : a + 4096, None]
                found = np.searchsorted(postings, probe)
                count[a : a + 4096] += (postings[np.minimum(found, len(postings) - 1)] == probe).sum(axis=1)
        good = (100 + percent) * count >= percent * (s + sizes[who])
        out_a.append(np.full(int(good.sum()), i))
        out_b.append(who[good])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def links_of(left: tuple, right: tuple | None, percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Of one block (ids, copies, sets), or between two: a spanning forest of the links, and each id's number of links."""
    ids, copies, sets = left
    if right is None:
        x, y = divide_skip(sets, None, percent)
        other, times = ids, copies
    else:
        other, times, index = right
        x, y = divide_skip(sets, index, percent)
    more: dict[int, int] = {}
    for own, n in ((ids, np.bincount(x, times[y], len(ids))), (other, np.bincount(y, copies[x], len(other)))) if len(x) else ():
        for k in np.flatnonzero(n).tolist():
            more[int(own[k])] = more.get(int(own[k]), 0) + int(n[k])
    return forest(ids[x], other[y]), more


FOUND = "a long, b long, links long"


def _found(edges: list[tuple[int, int]], more: dict[int, int]) -> dict[str, pa.Array]:
    return {
        "a": pa.array([a for a, _ in edges] + list(more), pa.int64()), "b": pa.array([b for _, b in edges] + [None] * len(more), pa.int64()),
        "links": pa.array([0] * len(edges) + list(more.values()), pa.int64()),
    }


def _own_block(make: Callable, percent: int):
    """mapInArrow function over texts sorted by (cluster, blk): links inside each block, and blocks of larger clusters, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held)
            ids, copies = part.column("doc_id").to_numpy(), part.column("copies").to_numpy()
            sets = [g[o[r] : o[r + 1]] for i, j, g, o in make(part.column("text")) for r in range(j - i)]
            own = np.sort(np.unique(ids, return_index=True)[1])  # of rows with one id, the first
            ids, copies, sets = ids[own], copies[own], [sets[k] for k in own]
            found = _found(*links_of((ids, copies, sets), None, percent))
            n = len(found["a"])
            none = {"cluster": pa.int64(), "nb": pa.int32(), "blk": pa.int32(), "data": pa.binary()}
            if n:
                yield batch_of(**found, **{c: pa.nulls(n, kind) for c, kind in none.items()})
            if now[1] > 1:
                blob = pack(ids, copies, np.array([len(x) for x in sets]), np.concatenate(sets))
                row = {c: pa.array([v], kind) for (c, kind), v in zip(none.items(), (*now, blob), strict=True)}
                yield batch_of(a=pa.nulls(1, pa.int64()), b=pa.nulls(1, pa.int64()), links=pa.nulls(1, pa.int64()), **row)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "nb", "blk")), strict=True))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(cut, cut[1:]):
                if e > s:
                    if held and keys[s] != now:
                        yield from solve()
                        held = []
                    now = keys[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield from solve()

    return run


def _two_blocks(percent: int):
    """mapInArrow function over packed blocks sorted by (cluster, i, j): links between the two blocks of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def block(blob: bytes) -> tuple:
            ids, copies, size, flat = unpack(blob, np.int64, np.int64, np.int64, U)
            return ids, copies, np.split(flat, np.cumsum(size)[:-1])

        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(c)[r].as_py() for c in ("cluster", "i", "j"))
                held = held if key == now else []
                now = key
                held.append(batch.column("data")[r].as_py())
                if len(held) == 2:
                    found = _found(*links_of(block(held[0]), block(held[1]), percent))
                    if len(found["a"]):
                        yield batch_of(**found)

    return run


def ngram_jaccard_join(
    docs: DataFrame, words: int = 5, percent: int = 80, block: int = 200_000, partition_bytes: int = 32 << 20, make: Callable | None = None, by_length: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document of (doc_id, text, ...).

    Texts are lower-cased in A-Z; sets hold distinct ``words``-word shingles, of a shorter text its whole sequence. Two
    documents link when 100 * intersection >= percent * union. Null or empty texts, and texts without words, have an
    empty set, link with nothing and form their own component. Rows with a null doc_id are returned with a null
    component. Repeated rows link with each other. Other columns are ignored. ``make`` may name another kind of sets
    of 64-bit hashes (``block`` is of their number); ``by_length`` has the prefix filter keep to size classes, as the part signatures always do.
    """
    make = make or word_shingles(words)
    parts = max(64, text_bytes(docs) // partition_bytes)
    sets = written(document_sets(docs, make), "sets")
    key = ["k1", "k2", "n_shingles"]
    classes = written(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    # under nine tenths, whole parts hold so few shingles that common lines would join most texts
    edges = coarse_edges(docs, make, percent, parts) if percent >= 90 else rare_edges(docs, make, percent, parts, by_length)
    clusters = connected_components(edges)
    members = written(
        classes.join(clusters.select(F.col("node").alias("k1"), F.col("component").alias("cluster")), "k1").select("rep", "copies", "cluster", "k1", "n_shingles"), "members"
    )
    size = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1")
    size = written(size.select("cluster", F.ceil(F.col("shingles") / block).cast("int").alias("nb")), "sizes")
    # block numbers are random, so that equal shares need no order of a whole cluster
    blocked = written(
        members.join(size, "cluster").withColumn("blk", F.pmod(F.xxhash64("k1", "rep"), "nb").cast("int"))
        .select(F.col("rep").alias("doc_id"), "copies", "cluster", "nb", "blk"),
        "blocked",
    )
    # by shuffle at every size: the members grow with the corpus
    texts = docs.select("doc_id", "text").where("text is not null").join(blocked.hint("merge"), "doc_id")
    rows = texts.select("cluster", "nb", "blk", "doc_id", "copies", "text").repartition(parts, "cluster", "blk").sortWithinPartitions("cluster", "blk", "doc_id", "text")
    inner = written(rows.mapInArrow(trimmed(_own_block(make, percent)), FOUND + ", cluster long, nb int, blk int, data binary"), "links")
    # only the sets of clusters of several blocks meet again, packed: near copies share most of their hashes
    pairs = inner.where("data is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("other <> blk")
    pairs = pairs.select("cluster", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "data")
    pairs = pairs.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "blk")
    outer = written(pairs.select("cluster", "i", "j", "data").mapInArrow(trimmed(_two_blocks(percent)), FOUND), "pairs")
    found = inner.where("data is null").select("a", "b", "links").unionByName(outer)
    reached = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = written(
        classes.join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
        .select(*key, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "named",
    )
    return sets.join(named, key, "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )

