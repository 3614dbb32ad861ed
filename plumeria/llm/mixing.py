"""Operator 9 [native]: mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Sources up to this count are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
GRAIN = 1_000_000


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target: shares of all sizes by repeating weights, stopped at ``most`` times a source's size.

    Sources are taken by code point, null last. Resharing the excess by weight until none is above ends where every
    source that is not stopped has ``level * weight``; with the sources in order of size / weight, the level is the
    first at which the next source is not stopped. The table has one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))).cast("int") + 1).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(whole)["level"])
    stop = (most * F.col("source_size")).cast("double")
    return s.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), stop), stop).alias("target"))


def random_unit(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from a digest of the columns: the same in every run, and in other engines."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(16**12)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, tilt: float = 0.25, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, size, source_size, target and taken of every row of (doc_id, text, source, ...).

    Of a source with ``ratio = target / source_size``, each document has floor(ratio) certain whole copies. For the
    rest, document i has the inclusion probability ``p = f * (1 + d * (h - mean h))`` with ``f`` the ratio's fraction and
    ``h = (m - size) / (m + size)`` in terms of the mean size m, so shorter documents are a little likelier; the mean
    is weighted by size, so the expected words are ``f * source_size``. Documents are ranked by
    ``(u / (1 - u)) / (p / (1 - p))`` and the first are selected, as many as bring the words nearest to the target
    without ranking a whole source in one task: ranks are first summed in fine bins, and only the bin where the sum
    passes the target is ranked by rows.

    A null or empty text has size 0 and takes 0; a null source is a source of its own, ordered last. Repeated rows are
    documents of their own that share their random number. An empty table gives an empty table. Other columns are ignored.
    """
    rows = written(docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = written(source_targets(rows, weights, most), "targets")
    mean = rows.where("size > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    mean = mean.select(F.col("source").alias("s0"), (F.col("total") / F.col("n")).alias("m"))

    def with_source(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        few = right.count() <= BROADCAST_SOURCES
        return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right[key]), "left").drop(key)

    mean = written(mean, "means")
    h = F.coalesce(F.round(GRAIN * (F.col("m") - F.col("size")) / (F.col("m") + F.col("size"))), F.lit(0.0)).cast("long")
    tilted = with_source(rows, mean, "s0").withColumn("h", h).drop("m")
    centre = tilted.groupBy("source").agg(F.sum(F.col("h") * F.col("size")).alias("hs"))
    facts = targets.join(centre.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left")
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    facts = facts.select(
        F.col("source").alias("s2"), "source_size", "target", F.coalesce(F.floor(ratio), F.lit(0)).alias("whole"),
        F.coalesce(ratio - F.floor(ratio), F.lit(0.0)).alias("f"),
        F.coalesce(F.col("hs") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("centre"),
    ).withColumn("tilt", F.when(F.col("f") > 0, F.least(F.lit(tilt), (1 - F.col("f")) / (2 * F.col("f")))).otherwise(0.0))
    facts = written(facts, "facts")
    u = random_unit(seed, F.col("doc_id"))
    p = F.col("f") * (1 + F.col("tilt") * (F.col("h") - F.col("centre")) / GRAIN)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = with_source(tilted, facts, "s2").withColumn("p", p)
    drawn = drawn.withColumn("q", F.when(F.col("p") <= 0, 1.0).when(F.col("p") >= 1, 0.0).otherwise(odds / (1 + odds)))
    bins = max(16, int(rows.count() ** 0.5))
    drawn = drawn.withColumn("bin", F.least(F.floor(F.col("q") * bins), F.lit(bins - 1)).cast("int"))
    drawn = written(drawn.select("doc_id", *keep, "source", "size", "source_size", "target", "whole", "f", "q", "bin"), "drawn")
    sums = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    need = facts.select(F.col("s2"), (F.col("f") * F.col("source_size")).alias("need"))
    edge = sums.join(need, sums["source"].eqNullSafe(need["s2"])).where("before < need and before + words >= need")
    edge = written(edge.select(F.col("s2"), F.col("bin").alias("edge_bin"), F.col("before"), "need"), "edges")
    placed = with_source(drawn, edge, "s2")
    below = placed.where("edge_bin is null or bin <> edge_bin").withColumn("more", F.when(F.col("bin") < F.col("edge_bin"), 1).otherwise(0))
    rank = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where("bin = edge_bin").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(rank), F.lit(0)))
    inside = inside.withColumn("more", F.when(F.col("ahead") + F.col("size") / 2 <= F.col("need"), 1).otherwise(0)).drop("ahead")
    out = below.unionByName(inside)
    return out.select("doc_id", *keep, "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"))


#: The same mix for DuckDB; the bins only speed up the ranking, so SQL ranks whole sources.
MIX_SQL = """
WITH rows0 AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows0 GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * COALESCE(sum(source_size) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0) AS DOUBLE) AS lev
  FROM w WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT arg_min(lev, CAST(source_size AS DOUBLE) / weight) AS lev FROM l WHERE lev * weight <= 3 * source_size
), t AS (
  SELECT source, source_size, COALESCE(least(lv.lev * weight, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target FROM w LEFT JOIN lv ON true
), m AS (
  SELECT source, CAST(sum(size) AS DOUBLE) / count(*) AS m FROM rows0 WHERE size > 0 GROUP BY source
), tilted AS (
  SELECT r.*, CAST(COALESCE(round(1000000 * (m.m - r.size) / (m.m + r.size)), 0.0) AS BIGINT) AS h
  FROM rows0 r LEFT JOIN m ON r.source IS NOT DISTINCT FROM m.source
), c AS (
  SELECT source, CAST(sum(h * size) AS DOUBLE) AS hs FROM tilted GROUP BY source
), facts AS (
  SELECT t.source, source_size, target, COALESCE(floor(target / nullif(source_size, 0)), 0) AS whole,
         COALESCE(target / nullif(source_size, 0) - floor(target / nullif(source_size, 0)), 0.0) AS f,
         COALESCE(hs / nullif(source_size, 0), 0.0) AS centre
  FROM t LEFT JOIN c ON t.source IS NOT DISTINCT FROM c.source
), p AS (
  SELECT x.doc_id, x.source, x.size, source_size, target, whole, f,
         f * (1 + (CASE WHEN f > 0 THEN least(0.25::DOUBLE, (1 - f) / (2 * f)) ELSE 0.0 END) * (h - centre) / 1000000) AS p,
         (CAST(('0x' || substr(md5('17|' || COALESCE(CAST(x.doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM tilted x JOIN facts ON x.source IS NOT DISTINCT FROM facts.source
), q AS (
  SELECT *, CASE WHEN p <= 0 THEN 1.0 WHEN p >= 1 THEN 0.0
                 ELSE ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS q FROM p
), ranked AS (
  SELECT *, COALESCE(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (whole + CASE WHEN ahead + size / 2.0::DOUBLE <= f * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ranked
"""
