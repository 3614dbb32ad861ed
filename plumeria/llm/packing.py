"""Arrays and texts as compressed blobs, so that a shuffle moves few large rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .textkernels import U, slices, utf8_parts, xxhash64_long  # noqa: F401

#: Bytes of texts that one task packs at a time.
FLUSH = 32 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes or integers as one compressed blob."""
    head = np.array([len(arrays)] + [x.nbytes for x in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, 1 + len(kinds))[1:]
    ends = 8 * (1 + len(kinds)) + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], t) for e, s, t in zip(ends, sizes, kinds, strict=True)]


def runs_of(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    if len(x):
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for s, e in zip(cut, np.append(cut[1:], len(x)), strict=True):
            yield int(x[s]), int(s), int(e)


def home(doc: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), parts), as Spark computes it."""
    return np.mod(xxhash64_long(doc).view(np.int64), parts)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def send_texts(parts: int):
    """Documents, packed for each home: texts travel in large compressed blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, length, text = (np.concatenate(x) for x in zip(*held, strict=True))
            to = home(ids, parts)
            order = np.argsort(to, kind="stable")
            start = (np.cumsum(length) - length)[order]
            ids, length, to = ids[order], length[order], to[order]
            out = [(v, pack(ids[s:e], length[s:e], np.concatenate([text[a : a + n] for a, n in zip(start[s:e], length[s:e])]))) for v, s, e in runs_of(to)]
            return batch_of(home=pa.array([v for v, _ in out], pa.int32()), data=pa.array([b for _, b in out], pa.binary()))

        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, b, o in slices(data, offsets):
                held.append((ids[i:j], np.diff(o), b))
                size += len(b)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run
