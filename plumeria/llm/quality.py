"""Operator 10: a quality classifier by co-training of a text view and a metadata view.

Both views learn from the same labelled sample. In each round each view scores all unlabelled documents, in a Spark job, and
marks those of which it is surest, good and bad, in each class of sources; the other view learns from them too. At the end each view is calibrated on labelled rows that
its last fit did not see, and the calibrated log odds are added (less one prior) to score all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import held_out, logistic, logistic_wide, sample_ids, sigmoid
from .textkernels import U, slices, utf8_parts, words_of

BITS = 11
SHAPES = 12


def text_features(col: pa.Array) -> np.ndarray:
    """Rows of hashed word shares (square roots, so each row's length is one) and of the text's shape."""
    data, offsets = utf8_parts(col)
    out = np.zeros((len(col), (1 << BITS) + SHAPES), np.float32)
    for i, j, b, o in slices(data, offsets):
        h, first = words_of(b, o)
        count = np.diff(first)
        n = j - i
        row = np.repeat(np.arange(n), count)
        cell = row * (1 << BITS) + (h >> U(64 - BITS)).astype(np.int64)
        share = np.bincount(cell, minlength=n << BITS).reshape(n, -1) / np.maximum(count, 1)[:, None]
        out[i:j, : 1 << BITS] = np.sqrt(share)
        size = np.maximum(np.diff(o), 1)

        def per_byte(mask: np.ndarray) -> np.ndarray:
            if n == 1:
                return mask.sum() / size
            sums = np.concatenate([[0], np.cumsum(mask)])
            return (sums[o[1:]] - sums[o[:-1]]) / size

        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        distinct = np.bincount(rs[np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])[: len(hs)]], minlength=n) if len(hs) else np.zeros(n)
        again = np.zeros(len(h), bool)
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        mark = ((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))
        dot = b == 46
        columns = [
            np.log1p(np.diff(o)) / 10, np.log1p(count) / 8, distinct / np.maximum(count, 1), np.bincount(row, again, n) / np.maximum(count, 1),
            per_byte(mark & ~dot) * 5, per_byte(dot) * 5, per_byte((b >= 48) & (b <= 57)) * 5, per_byte((b >= 65) & (b <= 90)) * 5,
            per_byte(b >= 128), per_byte(b == 10) * 10, size / np.maximum(count, 1) / 10, (count == 0).astype(float),
        ]
        out[i:j, 1 << BITS :] = np.clip(np.column_stack(columns), -3, 3)
    return out


META = 256


def meta_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """Rows of hashed source, language and their pair, and size classes; nulls are values of their own."""
    import zlib

    out = np.zeros((len(source), META + 14), np.float32)
    cache: dict[str, int] = {}
    for k, (s, g) in enumerate(zip(source, lang, strict=True)):
        for name in (f"s{s}", f"g{g}", f"p{s}|{g}"):
            cell = cache.get(name)
            if cell is None:
                cell = cache[name] = zlib.crc32(name.encode()) % META
            out[k, cell] = 1
    size = np.where(np.isnan(n_chars), 0, n_chars)
    level = np.clip(np.log2(np.maximum(size, 1)) - 4, 0, 12).astype(int)
    out[np.arange(len(source)), META + level] = 1
    out[:, META + 13] = np.log1p(np.maximum(size, 0)) / 10
    return out


@dataclass
class QualityModel:
    """Each view's coefficients and its calibration (slope, intercept), and the prior's log odds."""

    text: np.ndarray
    meta: np.ndarray
    cal_text: np.ndarray
    cal_meta: np.ndarray
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a = self.cal_text[0] * (text @ self.text[:-1].astype(np.float32) + self.text[-1]) + self.cal_text[1]
        b = self.cal_meta[0] * (meta @ self.meta[:-1].astype(np.float32) + self.meta[-1]) + self.cal_meta[1]
        return sigmoid(a + b - self.prior)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, exchange: Callable, rounds: int = 3) -> QualityModel:
    """Co-train both views on labelled rows, and on what they teach each other.

    ``exchange(models)`` gives the pseudo-labelled rows of a round: for each, the view that is taught, the row's features in
    that view, and the label that the other view is sure of.
    """
    if len(y) == 0 or y.min() == y.max():
        p = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return QualityModel(np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1), np.array([0.0, p]), np.array([0.0, p]), p)
    fold = np.arange(len(y)) % 4 == 3  # kept from the fits, to calibrate
    apart = fold.any() and len(set(y[fold])) == 2 and len(set(y[~fold])) == 2
    fit, cal = (~fold, fold) if apart else (np.ones(len(y), bool),) * 2
    views = [text, meta]
    taught: list[list[tuple[np.ndarray, float]]] = [[], []]

    def train(v: int) -> np.ndarray:
        x = np.concatenate([views[v][fit], *([np.stack([f for f, _ in taught[v]])] if taught[v] else [])])
        t = np.concatenate([y[fit].astype(float), [k for _, k in taught[v]]])
        w = np.concatenate([np.ones(fit.sum()), np.full(len(taught[v]), 0.5)])
        return logistic_wide(x, t, 1e-2, w) if v == 0 else logistic(x, t, 1.0, w)

    models = [train(0), train(1)]
    for _ in range(rounds):
        new = exchange(models)
        if not new:
            break
        for v, features, label in new:
            taught[v].append((features, label))
        models = [train(0), train(1)]
    cals = [logistic((views[v][cal] @ models[v][:-1] + models[v][-1])[:, None], y[cal].astype(float), 1e-2) for v in (0, 1)]
    share = y.mean()
    return QualityModel(models[0], models[1], cals[0], cals[1], float(np.log(share / (1 - share))))


COLUMNS = ["text", "lang", "source", "n_chars"]


def batch_views(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row and both views' features of a batch of COLUMNS, 512 rows at a time."""
    for i in range(0, batch.num_rows, 512):
        part = batch.slice(i, 512)
        n_chars = part.column("n_chars").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        yield i, text_features(part.column("text")), meta_features(part.column("source").to_pylist(), part.column("lang").to_pylist(), n_chars)


def fetch_features(docs: DataFrame, chosen: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both views of the few chosen doc_ids, computed in tasks; of rows with one id, the first in order of their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, meta in batch_views(batch):
                rows = [pa.array([x.astype(np.float16).tobytes() for x in view], pa.binary()) for view in (text, meta)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(text)), *rows], ["doc_id", "text", "meta"])

    rows = docs.select("doc_id", *COLUMNS).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("doc_id", "row.*")
    found = one.mapInArrow(run, "doc_id long, text binary, meta binary").collect()
    return {r.doc_id: tuple(np.frombuffer(x, np.float16).astype(np.float32) for x in (r.text, r.meta)) for r in found}


def surest(docs: DataFrame, labels: DataFrame, models: list[np.ndarray], told: DataFrame, take: int, strata: int, sure: float) -> DataFrame:
    """view, doc_id, label: of all documents without a label that are not held out, those of which each view is surest.

    For each view and side these are the first ``take`` of each of ``strata`` classes of sources, so no source crowds out the
    others; ranks are cut before the shuffle. ``told`` has the (view, doc_id) of earlier rounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, *views in batch_views(batch):
                p = [sigmoid(x @ m[:-1].astype(np.float32) + m[-1]) for x, m in zip(views, shared.value, strict=True)]
                keys = [batch.column(c).slice(i, len(p[0])) for c in ("doc_id", "stratum")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(p[0]), pa.array(p[1])], ["doc_id", "stratum", "p0", "p1"])

    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.pmod(F.xxhash64("source"), F.lit(strata)).cast("int").alias("stratum"), *COLUMNS)
    scored = rows.mapInArrow(run, "doc_id long, stratum int, p0 double, p1 double")
    views = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(f"p{v}").alias("p")) for v in (0, 1)))).alias("x")
    firm = scored.select("doc_id", "stratum", views).select("doc_id", "stratum", "x.*").where((F.col("p") >= sure) | (F.col("p") <= 1 - sure))
    firm = firm.join(labels.where("quality is not null").select("doc_id").distinct(), "doc_id", "left_anti").join(F.broadcast(told), ["view", "doc_id"], "left_anti")
    firm = firm.withColumn("label", (F.col("p") > 0.5).cast("int"))
    order = Window.partitionBy("view", "label", "stratum").orderBy(F.desc(F.abs(F.col("p") - 0.5)), F.xxhash64("doc_id"), "doc_id")
    return firm.withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).select("view", "doc_id", "label")


def score_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, rounds: int = 3, take: int = 8, strata: int = 8, sure: float = 0.9, seed: int = 9
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of (doc_id, text, lang, source, n_chars, ...).

    Learnt from at most ``per_class`` labelled rows of each class that are not held out (a document labelled both ways is not
    learnt from). In each round both views score all documents without a label, and the surest are exchanged; only features
    of rows that are learnt from reach the driver. Nulls in any column count as values of their own; without labels of
    both classes the score is one constant. Repeated rows score alike. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ids = sample_ids(docs, labels, "quality", per_class, seed)
    y = {r.doc_id: r.y for r in ids.collect()}
    known = fetch_features(docs, ids)
    names = sorted(known)
    shapes = text_features(pa.array([], pa.string())).shape[1], META + 14
    text, meta = (np.stack([known[k][v] for k in names]) if names else np.zeros((0, shapes[v]), np.float32) for v in (0, 1))
    told: set[tuple[int, int]] = set()

    def exchange(models: list[np.ndarray]) -> list[tuple[int, np.ndarray, float]]:
        before = spark.createDataFrame(sorted(told), "view int, doc_id long")
        new = sorted({tuple(r) for r in surest(docs, labels, models, before, take, strata, sure).collect()})
        told.update((v, k) for v, k, _ in new)
        features = fetch_features(docs, spark.createDataFrame([(k,) for k in sorted({k for _, k, _ in new})], "doc_id long")) if new else {}
        return [(1 - v, features[k][1 - v], float(label)) for v, k, label in new]

    model = cotrain(text, meta, np.array([y[k] for k in names], int), exchange, rounds)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, text, meta in batch_views(batch):
                score[i : i + len(text)] = shared.value.score(text, meta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = docs.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
