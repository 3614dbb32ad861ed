"""Operator 8: SpotSigs fingerprints: common-word anchors, each with the chain of content words that follows it.

A text's fingerprint is the sorted set of 64-bit hashes of its spots, in hexadecimal. Sets are compared by Jaccard
similarity. The self-join partitions sets by length, so that only neighbouring lengths meet, and prunes pairs by the bounds
that their lengths and the overlap found so far set; the fingerprints of documents are compared with those of given
partners and need no join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import ngram_jaccard_join
from .textkernels import U, chain, distinct_by_row, slices, utf8_parts, word_hashes, word_spans, words_of

#: Common words of four languages: the anchors.
ANCHORS = (
    "a an the is are was were be been to of in on at for with by and or that this it as from "
    "der die das ein eine ist sind und zu von mit im den dem auf nicht "
    "le la les un une est sont et de du des en dans que qui pour sur avec "
    "el los las una es son y del por para con se lo"
).split()
CHAIN = 2


def _anchor_hashes() -> np.ndarray:
    b = np.frombuffer(" ".join(ANCHORS).encode(), np.uint8)
    s, e, _ = word_spans(b, np.array([0, len(b)]))
    return np.unique(word_hashes(b, s, e))


def spot_sets(col: pa.Array, length: int = CHAIN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of an Arrow text column: first row, end row, sorted distinct 64-bit spot hashes, offsets.

    A text without a spot has one hash of its whole bytes, an empty one too, so that equal texts match, and others only by
    a collision of 64 bits.
    """
    common = _anchor_hashes()
    data, offsets = utf8_parts(col)
    for i, j, b, o in slices(data, offsets):
        h, first = words_of(b, o)
        n = j - i
        row = np.repeat(np.arange(n), np.diff(first))
        if len(h):
            anchor = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            content = np.flatnonzero(~anchor)
            at = np.flatnonzero(anchor)
            nth = np.cumsum(~anchor)[at]  # content words before each anchor
            ok = nth + length <= len(content)
            at, nth = at[ok], nth[ok]
            last = content[nth + length - 1] if len(content) else nth
            ok = row[last] == row[at]
            at, nth = at[ok], nth[ok]
            spots = chain(h[at], *(h[content[nth + k]] for k in range(length)))
            owner = row[at]
        else:
            spots, owner = np.zeros(0, U), np.zeros(0, np.int64)
        bare = np.setdiff1d(np.arange(n), owner)
        if len(bare):
            whole = np.array([int.from_bytes(hashlib.blake2b(b[o[r] : o[r + 1]].tobytes(), digest_size=8).digest()) for r in bare], U)
            spots, owner = np.concatenate([spots, whole]), np.concatenate([owner, bare])
            order = np.argsort(owner, kind="stable")
            spots, owner = spots[order], owner[order]
        yield i, j, *distinct_by_row(spots, owner, n)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where the lengths alone show that it is under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def all_sets(texts: list[str]) -> list[np.ndarray]:
    return [g[o[r] : o[r + 1]] for i, j, g, o in spot_sets(pa.array(texts, pa.large_string())) for r in range(j - i)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of (doc_id, text, ...); a null text counts as empty, equal texts are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(g[o[r] : o[r + 1]]) for i, j, g, o in spot_sets(batch.column(1)) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def spotsigs_join(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """Classes of documents whose spot sets have a Jaccard similarity of percent / 100 or more, as in the shingle join.

    Each set is in the partition of its length class and of the next one, whose bounds grow by 100 / percent, so two sets
    that can be linked share a partition. There, the prefix filter lets sets meet by one of their rarest spots, and pairs
    are pruned by length and by the least overlap they still need. Texts without a spot are linked with equal texts only.
    """
    return ngram_jaccard_join(docs, percent=percent, make=spot_sets, by_length=True, **options)


def beside_next(docs: DataFrame, rows: int = 4000) -> DataFrame:
    """Partitions of documents by descending doc_id, each followed by the first document of the next one (``guest``).

    The ranges come from approximate quantiles of the ids (a bounded sketch); texts are shuffled once. Rows of one doc_id
    stay together, in order of their texts. A null doc_id comes last.
    """
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"))
    count = docs.count()
    parts = max(1, min(max(64, count // rows), count))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)}, reverse=True) if parts > 1 else []
    # the part is the number of cuts above the id, found in two steps of about sqrt(parts) comparisons
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)] or [[-(1 << 63)]]
    coarse = F.size(F.filter(F.array(*(F.lit(b[-1]) for b in blocks)), lambda c: c > F.col("place")))
    fine = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    inside = F.coalesce(F.size(F.filter(F.get(fine, coarse), lambda c: c > F.col("place"))), F.lit(0))
    placed = docs.withColumn("part", F.least(coarse * step, F.lit(len(cuts))) + F.when(F.get(fine, coarse).isNotNull(), inside).otherwise(0))
    heads = placed.groupBy("part").agg(F.max("place").alias("place"))
    order = Window.orderBy("part")  # one row for each part
    before = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.withColumn("to", before).select("place", "to")
    guests = placed.drop("part").join(F.broadcast(heads), "place").groupBy("to").agg(F.min_by(F.struct("doc_id", "text", "place"), F.coalesce("text", F.lit(""))).alias("x"))
    guests = guests.select("x.*", F.col("to").alias("part"), F.lit(True).alias("guest"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("guest", F.desc("place"), F.coalesce("text", F.lit("")))


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for (doc_id, text, ...).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document by descending doc_id; after the last comes the first, and a lone document is its own next. Null texts count as
    empty. Repeated rows follow each other. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []

        def ready() -> pa.RecordBatch:
            n = len(texts) - 1
            chars = [len(t) for t in texts[:n]]
            edited = [t[: c - c // 3] + texts[k + 1][: c // 3] for k, (t, c) in enumerate(zip(texts, chars))]
            own, new = all_sets(texts), all_sets(edited)
            columns = {
                "doc_id": pa.array(ids[:n], pa.int64()), "n_chars": pa.array(chars, pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([fingerprint(a) for a in own[:n]], pa.string()),
                "edited_fingerprint": pa.array([fingerprint(a) for a in new], pa.string()),
                "near_edited": pa.array([jaccard(a, b) for a, b in zip(own, new)], pa.float64()),
                "near_next": pa.array([jaccard(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids += part.column("doc_id").to_pylist()
                texts += [t or "" for t in part.column("text").to_pylist()]
                if len(texts) > 1:
                    yield ready()
                    ids, texts = ids[-1:], texts[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).select("doc_id", "text").mapInArrow(run, schema)
