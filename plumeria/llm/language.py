"""Operator 7: language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Posterior log odds of a language are the sum of independent evidence: the text's likelihood under letter n-gram models,
the likelihood of the declared language tag and of the address suffix given the language (from counts of a first pass
that judges by text alone), and the prior of the host. Host priors are smoothed hierarchically: a host's counts are
backed by its suffix's, and those by all rows'. The counts come from one grouped aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkernels import LONG, SPACE, slices, utf8_parts
from .workers import trimmed

CELLS = 1 << 15
#: The evidence of a text never weighs more than that of so many independent n-grams, as its n-grams are not independent.
EFFECTIVE = 200.0


def gram_cells(b: np.ndarray) -> np.ndarray:
    """Cells of the three-byte strings that start at each byte, with lower case, one space, and digits and marks as one."""
    return (_CODE[b[:-2]] * 1024 + _CODE[b[1:-1]] * 32 + _CODE[b[2:]]) % CELLS


def _byte_codes() -> np.ndarray:
    code = np.zeros(256, np.int64)
    for x in range(256):
        if SPACE[x]:
            code[x] = 0
        elif 65 <= x <= 90:
            code[x] = x - 64
        elif 97 <= x <= 122:
            code[x] = x - 96
        elif x >= 128:
            code[x] = 27 + x % 4
        else:
            code[x] = 31
    return code


_CODE = _byte_codes()


@dataclass
class LanguageModel:
    """Log probabilities of n-gram cells for each language, and a flat model for text of no language."""

    languages: list[str]
    table: np.ndarray  # CELLS + 1 rows; the last is for places between texts
    floor: float

    def evidence(self, col: pa.Array, effective: float = EFFECTIVE, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods less the best one's (rows by languages), and the best's mean gain over the flat model.

        n n-grams weigh as n * effective / (n + effective), so longer texts tell more, with a bound, and no two languages tie.
        """
        data, offsets = utf8_parts(col)
        n = len(col)
        out, gain = np.zeros((n, len(self.languages))), np.zeros(n)
        for i, j, b, o in slices(data, offsets):
            if len(b) < 3:
                continue
            grams = np.maximum(np.diff(o) - 2, 0)
            total = np.zeros((j - i, len(self.languages)))
            if len(b) > long and j - i == 1:  # one very long text, in parts
                for at in range(0, len(b) - 2, long):
                    total[0] += self.table[gram_cells(b[at : at + long + 2])].sum(axis=0, dtype=np.float64)
            else:
                cells = gram_cells(b)
                row = np.repeat(np.arange(j - i), np.diff(o))
                cells = np.where(row[:-2] == row[2:], cells, CELLS)
                for k in range(len(self.languages)):
                    sums = np.concatenate([[0.0], np.cumsum(self.table[:, k][cells], dtype=np.float64), [0.0, 0.0]])
                    sums[-2:] = sums[-3]
                    total[:, k] = sums[o[1:]] - sums[o[:-1]]
            best = total.max(axis=1)
            gain[i:j] = np.where(grams > 0, best / np.maximum(grams, 1) - self.floor, 0.0)
            out[i:j] = (total - best[:, None]) * (effective / (grams + effective))[:, None]
        return out, gain


def gram_counts(texts: list[str], langs: list[str]) -> dict[str, np.ndarray]:
    """How often each cell occurs in the texts of each language."""
    counts = {}
    for name in sorted(set(langs)):
        b = np.frombuffer("\n".join(t for t, g in zip(texts, langs, strict=True) if g == name).encode(), np.uint8)
        counts[name] = np.bincount(gram_cells(b), minlength=CELLS) if len(b) >= 3 else np.zeros(CELLS, np.int64)
    return counts


def model_of(counts: dict[str, np.ndarray]) -> LanguageModel:
    names = sorted(counts)
    smooth = np.column_stack([counts[x] for x in names] or [np.zeros(CELLS)]) + 0.05
    table = np.log(smooth / smooth.sum(axis=0))
    return LanguageModel(names or ["und"], np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32), float(np.log(1 / CELLS)))


def fit_languages(texts: list[str], langs: list[str]) -> LanguageModel:
    return model_of(gram_counts(texts, langs))


def primary_subtag(tag: Column) -> Column:
    """The language of a tag in lower case: en of en-US, en_GB and EN; null of a tag without one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), "^[^-_]*", 0)), F.lit(""))


def train_languages(docs: DataFrame, per_language: int = 400, seed: int = 3, at_once: int = 32, longest: int = 1 << 16) -> LanguageModel:
    """Letter models from at most ``per_language`` rows of each declared language, chosen by a hash of their id.

    Every primary subtag with rows of its own has a model; spellings and regions of one language share it. Declared tags
    may be wrong, so rows whose text another language's model explains better are left out of a second fit. The driver
    holds the texts of ``at_once`` languages at a time, each of at most ``longest`` bytes, and the cell counts of all.
    """
    tagged = docs.select("doc_id", "text", primary_subtag(F.col("lang")).alias("tag")).where(F.col("doc_id").isNotNull() & F.col("tag").isNotNull() & (F.octet_length("text") <= longest))
    # the rank is cut to its first rows before the shuffle, so no language is sorted in one task
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    few = written(tagged.select("doc_id", "tag").withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "tag").distinct(), "sampled")
    sample = written(tagged.join(F.broadcast(few), ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.min("text").alias("text")), "sample")
    tags = sorted(r.tag for r in sample.select("tag").distinct().collect())

    def rows() -> Iterator[tuple[list[str], list[str]]]:
        for k in range(0, len(tags), at_once):
            part = sample.where(F.col("tag").isin(tags[k : k + at_once])).toPandas().sort_values(["doc_id", "text"])
            yield part["text"].tolist(), part["tag"].tolist()

    counts = {}
    for texts, langs in rows():
        counts |= gram_counts(texts, langs)
    first, agreed = model_of(counts), {}
    for texts, langs in rows():
        seen, _ = first.evidence(pa.array(texts, pa.string()))
        agree = [k for k, g in enumerate(langs) if first.languages[int(seen[k].argmax())] == g]
        agreed |= gram_counts([texts[k] for k in agree], [langs[k] for k in agree])
    return model_of(agreed) if agreed else first


def identify(docs: DataFrame, model: LanguageModel, strength: float = 20.0, accept: float = 0.5, least_gain: float = 0.6, effective: float = EFFECTIVE, key: str = "doc_id") -> DataFrame:
    """The columns key, declared, host and suffix of the rows, with language, posterior, gain and accepted.

    docs: (key, text, declared, host, suffix), any of which may be null. A null tag, suffix or host gives no evidence. A
    text under three bytes has no text evidence and is judged by the rest. Rejected are rows whose text fits no language
    (its best model gains less than ``least_gain`` nats for each n-gram over a flat one, with three bytes at least) and rows
    whose best posterior is under ``accept``. Repeated rows are judged alike.
    """
    names = model.languages
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ev, gain = shared.value.evidence(batch.column("text"), effective)
            flat = pa.array(ev.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, ev.shape[1]), pa.int32()), flat)
            columns = [batch.column(c) for c in (key, "declared", "host", "suffix")] + [lists, pa.array(gain), pa.array(ev.argmax(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [key, "declared", "host", "suffix", "ev", "gain", "first"])

    schema = f"{key} long, declared string, host string, suffix string, ev array<double>, gain double, first int"
    seen = written(docs.select(key, "text", "declared", "host", "suffix").mapInArrow(trimmed(run), schema), "evidence")
    one_hot = [F.sum(F.when((F.col("first") == k) & (F.col("gain") >= least_gain), 1).otherwise(0)).cast("double") for k in range(len(names))]
    by = seen.groupBy("declared", "host", "suffix").agg(F.array(*one_hot).alias("n"))
    by = written(by, "counts")  # one row for each tag and host

    def add(group: list[str]) -> DataFrame:
        return by.groupBy(*group).agg(F.array(*(F.sum(F.col("n")[k]) for k in range(len(names)))).alias("n"))

    n_all = add([]).first()[0] or [0.0] * len(names)
    n_all = [x or 0.0 for x in n_all]
    root = [(x + 1.0) / (sum(n_all) + len(names)) for x in n_all]
    lit = lambda xs: F.array(*map(F.lit, xs))

    def backed(n, prior):
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, prior, lambda a, p: (a + strength * p) / (total + strength))

    def given(n):
        """Likelihood of a value given the language, up to a factor, smoothed by the same strength."""
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(F.zip_with(n, lit(root), lambda a, p: a + strength * p), lit(n_all), lambda a, m: F.log(a / (m + strength)) - F.log((total + strength) / F.lit(sum(n_all) + strength)))

    suffixes = add(["suffix"]).select(F.col("suffix"), backed(F.col("n"), lit(root)).alias("sp"), given(F.col("n")).alias("sl"))
    hosts = add(["host", "suffix"]).join(suffixes, ["suffix"]).select("host", F.col("suffix"), F.transform(backed(F.col("n"), F.col("sp")), lambda p: F.log(p)).alias("hp"))
    nosuffix = add(["host", "suffix"]).where("suffix is null").select("host", "suffix", F.transform(backed(F.col("n"), lit(root)), lambda p: F.log(p)).alias("hp"))
    hosts = written(hosts.unionByName(nosuffix).where("host is not null"), "hosts")
    suffixes = written(suffixes.where("suffix is not null").select("suffix", "sl"), "suffixes")
    tags = written(add(["declared"]).where("declared is not null").select("declared", given(F.col("n")).alias("dl")), "tags")

    def facts(left: DataFrame, right: DataFrame, on) -> DataFrame:
        few = right.count() <= 10_000
        return left.join(F.broadcast(right) if few else right, on, "left")

    flat = lit([float(np.log(p)) for p in root])
    none = lit([0.0] * len(names))
    host_table = hosts.select(F.col("host").alias("h_host"), F.col("suffix").alias("h_suffix"), "hp")
    out = facts(seen, host_table, (F.col("host") == F.col("h_host")) & F.col("suffix").eqNullSafe(F.col("h_suffix")))
    out = facts(facts(out, suffixes, "suffix"), tags, "declared")
    post = F.zip_with("ev", F.coalesce("hp", flat), lambda a, b: a + b)
    post = F.zip_with(post, F.coalesce("sl", none), lambda a, b: a + b)
    post = F.zip_with(post, F.coalesce("dl", none), lambda a, b: a + b)
    out = out.withColumn("post", post).withColumn("top", F.array_max("post"))
    out = out.withColumn("posterior", 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best = F.element_at(lit(names), F.array_position("post", F.col("top")).cast("int"))
    fits = (F.col("gain") >= least_gain) | (F.col("gain") == 0)
    return out.select(key, "declared", "host", "suffix", best.alias("language"), "posterior", "gain", (fits & (F.col("posterior") >= accept)).alias("accepted"))


def suffix_of(host: Column) -> Column:
    """The last label of a host name of two labels or more, else null."""
    return F.nullif(F.regexp_extract(F.lower(host), r"^[^/\s]+\.([a-z]+)$", 1), F.lit("")).alias("suffix")


def document_languages(docs: DataFrame, **options) -> DataFrame:
    """identify() over (doc_id, text, lang, source, ...): the tag is the declared language, the source stands for the host.

    Where a source is a host name, its last label is the suffix. Nulls in any column give no evidence; repeated rows are
    judged alike; an empty table gives an empty table; other columns are ignored.
    """
    model = train_languages(docs)
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), suffix_of(F.col("source")))
    return identify(rows, model, **options)


def page_languages(pages: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """identify() over (page_id, url, html, ...): the html tag's lang, the host's last label and the host, models from docs.

    A null or empty html has no text evidence; a url without a host has no host and suffix. Repeated rows are judged alike; an
    empty table gives an empty table; other columns are ignored.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    tag = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    rows = pages.select(
        "page_id", plain.alias("text"), F.nullif(tag, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"),
        suffix_of(host),
    )
    return identify(rows, train_languages(docs), key="page_id", **options)
