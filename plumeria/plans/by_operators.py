"""Queries that call the operators of this library, checked against SQL on the same tables.

embeddings are tensors of one row, parts tensors of a catalog, (part, supplier) of lineitem their variants, nations devices and
regions tiers. Where an operator does what a query in SQL does, both have one oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.codecs import decode, encode
from ..functions.metadata import first_value, upsert, with_prefix
from ..functions.texts import isolate, pretokenise
from ..operators import catalog as C
from ..operators import routing as R
from ..operators.tokenizers import Tokenizer, encode_texts
from ..sources.container import open_container, write_container
from ..sources.scratch import scratch
from .dialect import Duck
from .registry import ORACLE, QUERIES, query, table
from .tensors import _absmax_blocks, _routes, f16, f32div

D = Duck()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: Rows of a large table in one partition of a shuffle.
SPREAD = 400_000


def spread(rows: DataFrame, each: int | None = None) -> int:
    """Partitions for the shuffles of a table: as many as its rows call for, so that a task's memory does not grow with it."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (each or SPREAD)))


def by_element(df: DataFrame, y: str, digits: int, name: str = "y") -> DataFrame:
    return df.select("vec_id", F.posexplode(y).alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", digits).alias(name))


def same_as(name: str):
    """A query with the oracle of another one."""
    return query(ORACLE[name])


@same_as("rms_norm")
def rms_norm_arrays(spark, sf_dir):
    """RMS norm on arrays: no shuffle."""
    return by_element(vectors(spark, sf_dir).withColumn("y", V.rms_norm(F.col("x"))), "y", 5)


@same_as("silu_gate")
def swiglu_arrays(spark, sf_dir):
    """SwiGLU of a vector's halves on arrays: no shuffle."""
    return by_element(vectors(spark, sf_dir).withColumn("y", V.swiglu(F.slice("x", 1, 32), F.slice("x", 33, 32))), "y", 6)


@same_as("softmax_stable")
def softmax_arrays(spark, sf_dir):
    """Softmax on arrays, its largest probability and entropy: no shuffle."""
    rows = vectors(spark, sf_dir).withColumn("p", V.softmax(F.col("x")))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(-V.total(F.transform("p", lambda p: p * F.log(p))), 5).alias("entropy"))


@same_as("linear_projection")
def linear_arrays(spark, sf_dir):
    """Each vector times the matrix of the first eight vectors, which is one broadcast row."""
    rows = vectors(spark, sf_dir)
    weights = rows.where("vec_id < 8").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("w"))
    y = rows.crossJoin(F.broadcast(weights)).select("vec_id", F.explode(F.transform("w", lambda r: F.struct(r["vec_id"].alias("o"), V.dot(r["x"], F.col("x")).alias("y")))).alias("r"))
    return y.select("vec_id", "r.o", F.round("r.y", 5).alias("y"))


@same_as("rope_rotate")
def rope_arrays(spark, sf_dir):
    """Rotary positions on arrays, by pair: no shuffle."""
    rows = vectors(spark, sf_dir).withColumn("y", V.rope(F.col("x"), F.col("vec_id") % 32, 8))
    pairs = rows.select("vec_id", F.posexplode("y").alias("dim", "v"), "y").where("dim % 2 = 0")
    return pairs.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("even"), F.round(F.get("y", F.col("dim") + 1), 5).alias("odd"))


@same_as("residual_add_elements")
def residual_add_arrays(spark, sf_dir):
    """Each vector plus its successor, on arrays: one join by key."""
    rows = vectors(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("z"))
    return by_element(rows.join(after, "vec_id").withColumn("y", V.add(F.col("x"), F.col("z"))), "y", 6)


@same_as("vec_dot_norm")
def vec_dot_norm_arrays(spark, sf_dir):
    """Dot product and cosine of each vector with the next, on arrays."""
    rows = vectors(spark, sf_dir).withColumn("n", V.norm(F.col("x")))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("z"), F.col("n").alias("m"))
    out = rows.join(after, "vec_id").withColumn("d", V.dot(F.col("x"), F.col("z")))
    return out.select("vec_id", F.round("d", 5).alias("dot"), F.round("n", 5).alias("norm"), F.round(F.col("d") / (F.col("n") * F.col("m")), 5).alias("cosine"))


def _router(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("label").alias("expert")).agg(F.min_by("x", "vec_id").alias("weights"))


_ROUTES = _routes(D, 2).replace("round(sum(e.v * r.w), 6)", "sum(e.v * r.w)")


@query(_ROUTES + " SELECT vec_id, CAST(expert AS BIGINT) AS expert, CAST(r AS BIGINT) AS place, round(weight, 4) AS weight FROM route")
def route_arrays(spark, sf_dir):
    """Top-2 routing with the router's matrix as one broadcast row."""
    rows = vectors(spark, sf_dir)
    routes = R.route(rows.select(F.col("vec_id").alias("token"), "x"), _router(rows), 2)
    return routes.select(F.col("token").alias("vec_id"), F.col("expert").cast("long").alias("expert"), (F.col("place") + 1).cast("long").alias("place"), F.round("weight", 4).alias("weight"))


@query(_ROUTES + " SELECT CAST(expert AS BIGINT) AS expert, vec_id AS token, round(weight, 4) AS weight FROM route")
def expert_batches(spark, sf_dir):
    """The tokens of each expert in order, with their weights, as rows of its batch."""
    rows = vectors(spark, sf_dir)
    batches = R.batches(R.route(rows.select(F.col("vec_id").alias("token"), "x"), _router(rows), 2))
    return batches.select(F.col("expert").cast("long").alias("expert"), F.explode("tokens").alias("t")).select("expert", "t.token", F.round("t.weight", 4).alias("weight"))


@same_as("causal_attention_heads")
def attention_arrays(spark, sf_dir):
    """Causal attention of eight heads over sequences of 16 tokens: each sequence and head meets its own keys, once."""
    heads = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.slice(F.col("x"), h * 8 + 1, F.lit(8)))).alias("head", "v")
    rows = vectors(spark, sf_dir).select((F.floor(F.col("vec_id") / 16)).cast("long").alias("seq"), (F.col("vec_id") % 16).alias("pos"), heads)
    out = R.causal_attention(rows.select("seq", "pos", "head", F.col("v").alias("q"), F.col("v").alias("k"), "v"))
    flat = out.select("seq", "pos", F.col("head").cast("long").alias("head"), F.posexplode("y").alias("i", "y"))
    return flat.select("seq", "pos", "head", F.col("i").cast("long").alias("i"), F.round("y", 5).alias("y"))


def _attention(spark: SparkSession, sf_dir: str, groups: int) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).cast("long").alias("seq"), (F.col("vec_id") % 16).alias("pos"), F.col("embedding").alias("x"))
    out = R.sequence_attention(tokens, 8, groups, parts=spread(tokens, 4_000))
    return out.select("seq", "pos", F.col("head").cast("long").alias("head"), F.col("i").cast("long").alias("i"), F.round("y", 5).alias("y"))


@same_as("causal_attention_heads")
def causal_attention_heads(spark, sf_dir):
    """Causal attention of every head (8 dimensions) over sequences of 16 tokens: each sequence meets in one row."""
    return _attention(spark, sf_dir, 1)


@same_as("gqa_attention_tokens")
def gqa_attention_tokens(spark, sf_dir):
    """Grouped-query attention, causal: 8 query heads share 2 key and value heads (head / 4), every token of sequences of 16, each in one row."""
    return _attention(spark, sf_dir, 4)


@same_as("nucleus_top_p")
def nucleus_arrays(spark, sf_dir):
    """Nucleus of 0.5 on arrays: no shuffle."""
    p = V.softmax(F.col("x"))
    rows = vectors(spark, sf_dir).withColumn("p", F.transform(p, lambda v: F.round(v, 9))).select("vec_id", F.explode(V.nucleus(F.col("p"), 0.5)).alias("k"))
    return rows.select("vec_id", F.col("k.id").cast("long").alias("dim"), F.round("k.p", 5).alias("p"))


@same_as("all_reduce_sum")
def all_reduce_arrays(spark, sf_dir):
    """Element-wise sum of all vectors of each label."""
    rows = R.all_reduce(vectors(spark, sf_dir).select("label", F.col("vec_id").alias("part"), F.col("x").alias("y")), ("label",))
    flat = rows.select(F.col("label").cast("long").alias("label"), F.posexplode("y").alias("dim", "v"))
    return flat.select("label", F.col("dim").cast("long").alias("dim"), F.round("v", 4).alias("total"))


# codecs: payloads in bytes and back, against the arithmetic in SQL


def _decoded(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", encode(codec)("embedding").alias("b"))
        rows = rows.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), decode(codec)("b").cast("array<double>").alias("y"))
        return rows.select("vec_id", "n_bytes", F.round(V.total(F.slice("y", 1, 64)), 4).alias("total"), F.round(V.norm(F.slice("y", 1, 64)), 4).alias("norm"))

    run.__doc__ = f"Every embedding as {codec} bytes and back: the payload's size, and sum and norm of what is decoded."
    return run


def _blocks_sql(divisor: float, low: int, high: int, width: int, n_bytes: int) -> str:
    q = f"greatest({low}, least({high}, round(CAST({f32div('v', 's')} AS DOUBLE))))"
    return f"""WITH b AS (SELECT vec_id, {q} * {f16(D, 'CAST(s AS DOUBLE)')} AS y FROM {_absmax_blocks(D, divisor, width)} z)
SELECT vec_id, CAST({n_bytes} AS BIGINT) AS n_bytes, round(sum(y), 4) AS total, round(sqrt(sum(y * y)), 4) AS norm FROM b GROUP BY vec_id"""


query(_blocks_sql(127, -127, 127, 32, 68), "q8_0_payloads")(_decoded("q8_0"))
query(_blocks_sql(8, -8, 7, 32, 36), "q4_0_payloads")(_decoded("q4_0"))
query(_blocks_sql(4, -4, 3, 256, 110), "q3_k_payloads")(_decoded("q3_k"))
query(f"SELECT vec_id, CAST(256 AS BIGINT) AS n_bytes, round(sum(v), 4) AS total, round(sqrt(sum(v * v)), 4) AS norm FROM {D.emb} e GROUP BY vec_id", "f32_payloads")(_decoded("f32"))
_SIGN = f"SELECT vec_id, CASE WHEN v < 0 THEN -1 ELSE 1 END * CASE WHEN v = 0 THEN 0 ELSE {f16(D, 'CASE WHEN v = 0 THEN 1 ELSE abs(v) END')} END AS y FROM {D.emb} e"
query(f"SELECT vec_id, CAST(128 AS BIGINT) AS n_bytes, round(sum(y), 4) AS total, round(sqrt(sum(y * y)), 4) AS norm FROM ({_SIGN}) s GROUP BY vec_id", "f16_payloads")(_decoded("f16"))


@query(f"SELECT vec_id, CAST(64 AS BIGINT) AS n, round(sum(v), 3) AS total FROM {D.emb} e GROUP BY vec_id")
def container_round_trip(spark, sf_dir):
    """All embeddings written to a container with a q8_0 variant each, opened again, verified and decoded from their canonical bytes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", encode("f32")("embedding").alias("f32"), encode("q8_0")("embedding").alias("q8_0"))
    pairs = "array<struct<key:string,value:string>>"
    index = (F.col("vec_id") * 2).cast("int")
    tensors = rows.select(
        F.col("vec_id").cast("string").alias("name"), F.col("vec_id").alias("ordinal"), F.lit("f32").alias("dtype"), F.array(F.lit(64).cast("long")).alias("shape"), index.alias("canonical_variant"),
        F.array(index + 1).alias("packed_variants"), F.array().cast(pairs).alias("metadata"),
    )
    variant = lambda i, target, encoding, codec: F.struct(i.alias("variant_index"), F.lit(target).alias("target"), F.lit(encoding).alias("encoding"), F.lit(codec).alias("storage_dtype"), F.array().cast(pairs).alias("extra"), F.col(codec).alias("payload"))
    variants = rows.select(F.explode(F.array(variant(index, "canonical", "raw", "f32"), variant(index + 1, "wgpu", "block_quantized", "q8_0"))).alias("v")).select("v.*")
    path = scratch(spark, "container")
    write_container(path, tensors, variants, level=1, shuffle=True)
    c = open_container(spark, path)
    C.ensure_none(c.verify(), "container")
    return c.floats().select(F.col("name").cast("long").alias("vec_id"), F.size("values").cast("long").alias("n"), F.round(V.total(F.col("values").cast("array<double>")), 3).alias("total"))


# catalog


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


@same_as("residency_totals")
def residency_totals(spark, sf_dir):
    """Bytes, tensors and shards that each device and tier hold: tensors are made distinct and counted in partitions by the table's rows."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tensor"), F.col("l_suppkey").alias("shard"), "l_quantity")
    parts, place = spread(lines), ["tier", "device"]
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    homes = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("shard"), F.col("r_name").alias("tier"), F.col("n_name").alias("device"))
    variants = lines.repartition(parts, "shard").groupBy("tensor", "shard").agg(F.sum("l_quantity").cast("long").alias("bytes"))
    held = variants.join(homes, "shard").select(*place, "tensor", "bytes").repartition(parts, *place, "tensor").groupBy(*place, "tensor").agg(F.sum("bytes").alias("bytes"))
    shards = lines.select("shard").distinct().join(homes, "shard").groupBy(*place).agg(F.count_distinct("shard").alias("shards"))
    totals = held.groupBy(*place).agg(F.sum("bytes").alias("bytes"), F.count("tensor").alias("tensors"))
    both = totals.withColumn("shards", F.lit(0).cast("long")).unionByName(shards.select(*place, F.lit(None).cast("long").alias("bytes"), F.lit(0).cast("long").alias("tensors"), "shards"))
    return both.groupBy(*place).agg(F.sum("bytes").alias("bytes"), F.sum("tensors").alias("tensors"), F.sum("shards").alias("shards"))


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """tensors and variants: the first supplier's variant of each part is canonical."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    # all of a part is in one partition, so that this is the only shuffle here
    index = F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    own = lines.repartition(spread(lines), "l_partkey").groupBy("l_partkey").agg(F.array_sort(F.collect_set(index)).alias("v"))
    tensors = own.select(
        F.col("l_partkey").cast("string").alias("name"), F.col("l_partkey").alias("ordinal"), F.get("v", 0).alias("canonical_variant"), F.slice("v", 2, 1 << 30).alias("packed_variants"),
        F.array(_pair("moe.layer", F.col("l_partkey") % 4), _pair("moe.expert", F.col("l_partkey") % 16)).alias("metadata"),
    )
    names = F.array(*map(F.lit, C.TARGETS))
    each = own.select("l_partkey", F.posexplode("v").alias("place", "variant_index")).withColumn("l_suppkey", F.col("variant_index") - F.col("l_partkey") * 100_000)
    variants = each.select(
        "variant_index", F.when(F.col("place") == 0, "canonical").otherwise(F.get(names, (1 + F.col("l_suppkey") % 12).cast("int"))).alias("target"),
        F.get(F.array(*map(F.lit, ("raw", "cast_f16", "block_quantized"))), (F.col("l_suppkey") % 3).cast("int")).alias("encoding"),
        F.when(F.col("l_suppkey") % 7 == 0, 4096).otherwise(64).alias("alignment"),
        F.when(F.col("l_suppkey") % 2 == 0, F.array(_pair("tier.intent", F.get(F.array(*map(F.lit, C.TIERS)), (F.col("l_suppkey") % 3).cast("int"))))).otherwise(F.array().cast("array<struct<key:string,value:string>>")).alias("extra"),
    )
    return tensors, variants


_TARGETS = "[" + ", ".join(f"'{t}'" for t in C.TARGETS) + "]"
_CATALOG = f"""v0 AS (SELECT DISTINCT l_partkey, l_suppkey, l_partkey * 100000 + l_suppkey AS variant_index FROM lineitem),
v AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS place FROM v0),
c AS (SELECT *, CASE WHEN place = 0 THEN 'canonical' ELSE ({_TARGETS})[2 + l_suppkey % 12] END AS target, ['raw', 'cast_f16', 'block_quantized'][1 + l_suppkey % 3] AS encoding,
  CASE WHEN l_suppkey % 7 = 0 THEN 4096 ELSE 64 END AS alignment, CASE WHEN l_suppkey % 2 = 0 THEN ['vram', 'ram', 'nvme'][1 + l_suppkey % 3] END AS tier FROM v)"""
_CASES = [("cpu_only", frozenset({"avx2", "avx512"}), None, None), ("gpu_only", frozenset(), "cuda", None), ("hybrid", frozenset({"neon"}), "wgpu", "ram")]


def _select_sql(mode: str, cpu: frozenset, gpu: str | None, tier: str | None) -> str:
    scores = ", ".join(f"('{t}', {s})" for t, s in C.base_scores(mode, cpu, gpu).items())
    fits = f"COALESCE(tier = '{tier}', false)" if tier else "true"
    return f"""SELECT '{mode}' AS mode, name, variant_index, target, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, penalty, alignment, place) AS r FROM (
  SELECT CAST(l_partkey AS VARCHAR) AS name, variant_index, c.target, alignment, place, {fits} AS fits, max({fits}) OVER (PARTITION BY l_partkey) AS hit,
    CASE encoding WHEN 'cast_f16' THEN 3 WHEN 'block_quantized' THEN 5 ELSE 0 END AS penalty,
    CAST(COALESCE(s.base, 0) - (CASE WHEN alignment > 256 THEN 10000 ELSE 0 END) - (CASE encoding WHEN 'cast_f16' THEN 3 WHEN 'block_quantized' THEN 5 ELSE 0 END) AS INT) AS score
  FROM c LEFT JOIN (VALUES {scores}) AS s(target, base) ON s.target = c.target) x WHERE fits = hit) y WHERE r = 1"""


@query(f"WITH {_CATALOG} " + " UNION ALL ".join(_select_sql(*x) for x in _CASES))
def select_variants_modes(spark, sf_dir):
    """The best variant of each tensor in all three modes, with CPU features, GPU back-ends and a tier."""
    found = C.select_variants_cases(*catalog(spark, sf_dir), _CASES, 256, parts=spread(table(spark, sf_dir, "lineitem")))
    return found.select("mode", "name", "variant_index", "target", "score")


@query(f"""WITH {_CATALOG}, f AS (SELECT l_partkey, target, min(place) AS first FROM c GROUP BY l_partkey, target),
g AS (SELECT l_partkey, min(CASE WHEN target = 'cuda' THEN place END) AS hit FROM c GROUP BY l_partkey)
SELECT CAST(f.l_partkey AS VARCHAR) AS name, string_agg(f.target, ',' ORDER BY first) AS targets, any_value(g.hit IS NOT NULL) AS found,
  any_value((SELECT variant_index FROM c WHERE c.l_partkey = f.l_partkey AND c.place = COALESCE(g.hit, 0))) AS variant_index FROM f JOIN g ON g.l_partkey = f.l_partkey GROUP BY f.l_partkey""")
def variant_targets(spark, sf_dir):
    """Each tensor's distinct targets in order, and its variant for one target, or else its canonical one."""
    found = C.target_index(*catalog(spark, sf_dir), "cuda", parts=spread(table(spark, sf_dir, "lineitem")))
    return found.select("name", F.array_join("targets", ",").alias("targets"), "found", "variant_index")


@query(f"""WITH {_CATALOG}, t AS (SELECT DISTINCT l_partkey FROM c)
SELECT CAST(l_partkey % 4 AS BIGINT) AS layer, CAST(l_partkey % 16 AS BIGINT) AS expert_id, min(l_partkey) AS first, count(*) AS n, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS names FROM t GROUP BY l_partkey % 4, l_partkey % 16""")
def moe_groups(spark, sf_dir):
    """Tensors by layer and expert of their metadata, names in order."""
    groups = C.moe_index(catalog(spark, sf_dir)[0])
    return groups.select("layer", "expert_id", "first", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", ",").cast("binary")).alias("names"))


@query(f"""WITH {_CATALOG}, t AS (SELECT DISTINCT l_partkey FROM c)
SELECT CAST(l_partkey AS VARCHAR) AS name, 'x' AS expert, CAST(l_partkey % 4 AS VARCHAR) AS layer, CAST(3 AS BIGINT) AS n_pairs, CAST(2 AS BIGINT) AS n_moe FROM t""")
def metadata_upserts(spark, sf_dir):
    """A metadata pair replaced in place, another appended, and the pairs under a prefix."""
    m = upsert(upsert(F.col("metadata"), "moe.expert", F.lit("x")), "note", F.lit("y"))
    rows = catalog(spark, sf_dir)[0].withColumn("m", m)
    size = lambda x: F.size(x).cast("long")
    return rows.select("name", first_value(F.col("m"), "moe.expert").alias("expert"), first_value(F.col("m"), "moe.layer").alias("layer"), size("m").alias("n_pairs"), size(with_prefix(F.col("m"), "moe.")).alias("n_moe"))


@query("""WITH e AS (SELECT p_name AS name, max(p_size) AS size, max(p_brand) AS brand FROM part GROUP BY p_name), a AS (SELECT p_name AS name, min(p_size) AS size, min(p_brand) AS brand FROM part WHERE p_size > 3 GROUP BY p_name),
j AS (SELECT COALESCE(e.name, a.name) AS name, e.name IS NOT NULL AS wanted, a.name IS NOT NULL AS there, e.size <> a.size AS s, e.brand <> a.brand AS b FROM e FULL JOIN a ON e.name = a.name)
SELECT 'missing' AS issue, name FROM j WHERE wanted AND NOT there UNION ALL SELECT 'dtype' AS issue, name FROM j WHERE wanted AND there AND b UNION ALL SELECT 'shape' AS issue, name FROM j WHERE wanted AND there AND s""")
def state_dict_differences(spark, sf_dir):
    """Names, types (brands) and shapes (sizes) of parts against a schema: what is missing or differs."""
    part = table(spark, sf_dir, "part")
    side = lambda df, f: df.groupBy(F.col("p_name").alias("name")).agg(f("p_brand").alias("dtype"), F.array(f("p_size").cast("long")).alias("shape"))
    expected = side(part, F.max).withColumn("required", F.lit(True))
    return C.state_dict_issues(expected, side(part.where("p_size > 3"), F.min)).select("issue", "name")


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS ordinal, CAST(floor(o_totalprice) AS BIGINT) AS length, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 4096 ELSE 64 END AS BIGINT) AS align FROM orders),
r AS (SELECT file, k, ordinal, length, CAST(0 AS BIGINT) AS start FROM s WHERE k = 1 UNION ALL
  SELECT s.file, s.k, s.ordinal, s.length, ((r.start + r.length + s.align - 1) // s.align) * s.align AS start FROM r JOIN s ON s.file = r.file AND s.k = r.k + 1)
SELECT file, ordinal, length, start FROM r""")
def aligned_layout_mixed(spark, sf_dir):
    """Offsets of sections with alignments of their own, file by file."""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("ordinal"), F.floor("o_totalprice").cast("long").alias("length"), F.when(F.col("o_orderkey") % 4 == 0, 4096).otherwise(64).alias("align"))
    return C.aligned_layout(items).select("file", "ordinal", "length", F.col("offset").alias("start"))


@query("""WITH p AS (SELECT COALESCE(source, '') AS arena, doc_id AS ordinal, md5(text) AS digest, n_chars AS length, CASE WHEN doc_id % 3 = 0 THEN 256 ELSE 64 END AS align FROM documents),
f AS (SELECT *, first_value(ordinal) OVER w AS o, first_value(align) OVER w AS a FROM p WINDOW w AS (PARTITION BY arena, digest, length ORDER BY ordinal))
SELECT arena, ordinal, CASE WHEN a % align = 0 THEN o ELSE ordinal END AS stored_at FROM f""")
def dedup_by_arena(spark, sf_dir):
    """Documents as payloads: each source's first one of a digest and length is stored, if its alignment fits the others."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.coalesce("source", F.lit("")).alias("arena"), F.col("doc_id").alias("ordinal"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("n_chars").alias("length"), F.when(F.col("doc_id") % 3 == 0, 256).otherwise(64).alias("align"))
    return C.dedup_payloads(p).select("arena", "ordinal", "stored_at")


_KINDS, _TIERS = "['cpu', 'cuda', 'rocm_hip', 'wgpu', 'metal']", "['vram', 'ram', 'nvme']"


@query(f"""WITH x AS (SELECT l_partkey AS expert_id, l_suppkey AS shard_id, s_nationkey AS device_id, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey, s_nationkey),
d AS (SELECT n_nationkey AS device_id, ({_KINDS})[1 + n_nationkey % 5] AS kind, ({_TIERS})[1 + n_regionkey % 3] AS tier FROM nation),
s AS (SELECT x.device_id, bytes, CASE WHEN kind = 'cpu' OR tier = 'ram' THEN 'none' WHEN tier = 'vram' THEN 'host_to_device' ELSE 'unsupported' END AS kind FROM x JOIN d ON d.device_id = x.device_id)
SELECT device_id, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY device_id, kind""")
def transfer_steps(spark, sf_dir):
    """What has to be copied to each device (nation), by kind of step."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("bytes"))
    experts = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("expert_id"), F.col("l_suppkey").alias("shard_id"), F.col("s_nationkey").alias("device_id"), "bytes")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    devices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), pick(C.DEVICES, F.col("n_nationkey")).alias("kind"), pick(C.TIERS, F.col("n_regionkey")).alias("tier"))
    return C.transfer_plan(experts, devices).groupBy("device_id", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query()
def shards_by_size(spark, sf_dir):
    """Tensors (parts) of each brand's model dealt to four shards by size."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("model"), F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_size").cast("long").alias("bytes"), F.lit(None).cast("string").alias("group"))
    return C.assign_shards(rows, 4, False)


# texts


@same_as("wordlevel_encode")
def wordlevel_encode(spark, sf_dir):
    """Word-level ids: words of the benchmark by frequency are the vocabulary, others are unknown (0).

    The vocabulary is broadcast up to a million words, else joined by shuffle; a document's words are summed up before theirs.
    """
    words = F.explode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("w")
    counts = table(spark, sf_dir, "benchmark").select(words).groupBy("w").agg(F.count("*").alias("n"))
    ranked = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "w"))).alias("v"))
    vocab = ranked.select(F.posexplode("v").alias("k", "x")).select(F.col("x.w").alias("w"), (F.col("k") + 1).cast("long").alias("id"))
    vocab = F.broadcast(vocab) if counts.count() <= 1_000_000 else vocab
    rows = table(spark, sf_dir, "documents").select("doc_id", words).join(vocab, "w", "left")
    unknown = F.sum(F.when(F.col("id").isNull(), 1).otherwise(0)).cast("long")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("id", F.lit(0).cast("long"))).alias("sum_ids"), unknown.alias("unknown"))


@query("""SELECT doc_id, CAST(COALESCE(len(regexp_extract_all(text, 'the end|The|the|and')), 0) AS BIGINT) AS n_special, COALESCE(array_to_string(regexp_extract_all(text, 'the end|The|the|and'), '|'), '') AS specials,
  CAST(COALESCE(length(text), 0) AS BIGINT) AS n_chars FROM documents""")
def special_tokens_isolated(spark, sf_dir):
    """Special tokens apart from the text between them, of those that start at one place the longest; no character is lost."""
    parts = isolate(F.coalesce("text", F.lit("")), ["the", "and", "the end", "The"])
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("p"))
    special = F.transform(F.filter("p", lambda s: s["special"]), lambda s: s["text"])
    chars = F.aggregate("p", F.lit(0).cast("long"), lambda a, s: a + F.char_length(s["text"]))
    return rows.select("doc_id", F.size(special).cast("long").alias("n_special"), F.array_join(special, "|").alias("specials"), chars.alias("n_chars"))


@query(r"""SELECT doc_id, CAST(COALESCE(len(w), 0) AS BIGINT) AS n, md5(COALESCE(array_to_string(w, ' '), '')) AS pieces FROM (SELECT doc_id, regexp_extract_all(text, '[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+') AS w FROM documents) x""")
def pretokenise_whitespace(spark, sf_dir):
    """Pieces of every document between white space, ASCII marks apart."""
    pieces = pretokenise(F.coalesce("text", F.lit("")), {"type": "Whitespace"})
    rows = table(spark, sf_dir, "documents").select("doc_id", pieces.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", " ").cast("binary")).alias("pieces"))


#: A public tokenizer file of byte-pair merges.
BPE_FILE = "/opt/tokenizers/word_bpe_49k.json"


@query()
def bpe_ids(spark, sf_dir, path: str = BPE_FILE):
    """Ids of all benchmark texts and documents by byte-pair merges of a tokenizer file, without its template."""
    with open(path) as f:
        tok = Tokenizer.from_json(f.read())
    plain = Tokenizer("BPE", tok.vocab, tok.merges, unknown=tok.unknown or next(iter(tok.vocab)), pretokeniser={"type": "Whitespace"}, normaliser={"type": "Lowercase"})
    rows = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), plain)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",").cast("binary")).alias("ids"))


assert all(name in QUERIES for name in ORACLE)
