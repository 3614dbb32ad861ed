"""A corpus pipeline of five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm.language import document_languages
from plumeria.llm.mixing import mix_sources
from plumeria.llm.ngram_join import ngram_jaccard_join
from plumeria.llm.passages import dedup_passages
from plumeria.llm.pieces import encode_documents
from plumeria.llm.store import forget, table, written


def _key() -> Column:
    """A row's own name in a stage: equal for equal rows only."""
    return F.xxhash64("doc_id", "text").alias("own__key")


def _without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return docs.join(written(keys.select(key).where(f"{key} is not null").distinct(), "gone"), key, "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language go on; those that language identification rejects go.

    Every row is judged by itself: rows with a null doc_id too, and rows that share a doc_id apart.
    """
    rows = docs.select(_key().alias("doc_id"), "text", "lang", "source")
    gone = document_languages(rows).where("not accepted").select(F.col("doc_id").alias("own__key"))
    return _without(docs.select(*docs.columns, _key()), gone, "own__key").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8) stays.

    A doc_id names one document: of rows that share it, the first in order of their columns stays, if that document does.
    Rows with a null doc_id have no place in the order and stay.
    """
    kept = _without(docs, ngram_jaccard_join(docs, words=5, percent=80).where("component_id <> doc_id"), "doc_id").select(*docs.columns)
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    others = [c for c in docs.columns if c != "doc_id"]
    one = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the 50-byte strings that start in an earlier document too; n_chars counts what is left.

    A null text is empty from here on. Rows with a null doc_id are left as they are.
    """
    cut = dedup_passages(docs, k=50).withColumn("n_chars", F.char_length("text").cast("long"))
    own = {c.removeprefix("own__") for c in cut.columns if c.startswith("own__")}
    return cut.select(*(F.col(f"own__{c}").alias(c) if c in own else c for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each whole copy that the mix takes; those it does not take, and those without words, go."""
    rows = docs.select(*docs.columns, _key())
    taken = mix_sources(rows, keep=("own__key",)).where("taken > 0").groupBy("own__key").agg(F.max(F.expr("taken div size")).alias("own__copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("own__copies").cast("int"))).alias("own__copy")
    return rows.join(written(taken, "taken"), "own__key").select(*docs.columns, copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix."""
    return encode_documents(docs)


STAGES = [
    ("language identification", keep_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_passages),
    ("mixing", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again for the next.

    Once a stage's result is written, the tables that led to it are deleted.
    """
    docs, start = table(spark, sf_dir, "documents"), forget(spark, 1 << 60)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            forget(spark, start, f"stage{k}")
    return docs


#: Language identification learns models, and components are iterative: SQL can't express these stages.
ORACLE_SQL = None
