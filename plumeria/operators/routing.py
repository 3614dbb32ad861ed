"""Mixture-of-experts layers as joins and aggregations: routing, batches, expert networks, collectives.

tokens(token, x array<double>), router(expert, weights array<double>), experts(expert, role, row, weights array<double>) with the
roles up, gate (optional) and down. Router and expert tables are models: they are broadcast where Spark's threshold says
so, else joined by shuffle. Tokens stay arrays; nothing is exploded by element but in all_reduce().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, let


def route(tokens: DataFrame, router: DataFrame, k: int = 1, softmax: bool = True) -> DataFrame:
    """token, expert, place, score, weight: the k experts of the largest scores of each token, the lower id on ties.

    NaN scores rank last. Weights are the softmax over the chosen ones, with the largest score subtracted, or all 1.
    """
    if k < 1:
        raise ValueError("k has to be at least 1")
    table = router.agg(F.array_sort(F.collect_list(F.struct("expert", "weights"))).alias("rows"))  # one row: the router's matrix
    scored = tokens.crossJoin(F.broadcast(table)).withColumn("scores", F.transform("rows", lambda r: F.struct(dot(r["weights"], F.col("x")).alias("score"), r["expert"].alias("expert"))))
    ranked = F.array_sort(F.transform("scores", lambda s: F.struct(F.isnan(s["score"]).alias("nan"), (-s["score"]).alias("minus"), s["expert"].alias("expert"), s["score"].alias("score"))))
    top = scored.select("token", F.slice(ranked, 1, k).alias("top"))
    weights = let(F.get("top", 0)["score"], lambda m: F.transform("top", lambda s: F.exp(s["score"] - m) if softmax else F.lit(1.0)))
    out = top.withColumn("w", weights).select("token", "w", F.posexplode(F.arrays_zip("top", "w")).alias("place", "r"))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    weight = F.col("r.w") / total if softmax else F.lit(1.0)
    return out.select("token", F.col("r.top.expert").alias("expert"), "place", F.col("r.top.score").alias("score"), weight.alias("weight"))


def batches(routes: DataFrame) -> DataFrame:
    """expert, first, tokens: the (token, weight) pairs of each expert in order of the tokens; order experts by ``first``.

    One expert's batch is one row; for batches that do not fit one, use batch_rows().
    """
    pairs = F.array_sort(F.collect_list(F.struct("token", "weight")))
    return routes.groupBy("expert").agg(F.min("token").alias("first"), pairs.alias("tokens"))


def batch_rows(routes: DataFrame, size: int = 4096) -> DataFrame:
    """expert, batch, token, weight: batches of about ``size`` tokens as rows; a hot expert's are spread by the token's hash."""
    count = routes.groupBy("expert").agg(F.count("*").alias("n"))
    return routes.join(count, "expert").select("expert", F.pmod(F.xxhash64("token"), F.ceil(F.col("n") / size)).cast("int").alias("batch"), "token", "weight")


def device_batches(routes: DataFrame, placement: DataFrame) -> DataFrame:
    """device_id, experts, n of the batches of each device, by device id (placement: expert, device_id)."""
    rows = routes.join(placement, "expert").groupBy("device_id").agg(F.array_sort(F.collect_set("expert")).alias("experts"), F.count("*").alias("n"))
    return rows.orderBy("device_id")


def _matrix(experts: DataFrame, role: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", "weights"))), lambda r: r["weights"])
    return experts.where(F.col("role") == role).groupBy("expert").agg(rows.alias(role))


def expert_outputs(tokens: DataFrame, routes: DataFrame, experts: DataFrame) -> DataFrame:
    """token, expert, weight, y: down(up(x)), with silu(gate(x)) * up(x) inside where the expert has a gate."""
    nets = _matrix(experts, "up").join(_matrix(experts, "down"), "expert").join(_matrix(experts, "gate"), "expert", "left")
    rows = routes.join(tokens, "token").join(nets, "expert")
    product = lambda m, v: F.transform(m, lambda r: dot(r, v))
    rows = rows.withColumn("u", product(F.col("up"), F.col("x"))).withColumn("g", product(F.col("gate"), F.col("x")))
    inner = F.when(F.col("g").isNull(), F.col("u")).otherwise(F.zip_with("g", "u", lambda g, u: g / (1 + F.exp(-g)) * u))
    return rows.withColumn("h", inner).select("token", "expert", "weight", product(F.col("down"), F.col("h")).alias("y"))


def combine(outputs: DataFrame) -> DataFrame:
    """token and y: the weighted sum of its experts' outputs, added in order of the experts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("expert", "weight", "y"))), lambda p: F.transform(p["y"], lambda v: v * p["weight"]))
    grouped = outputs.groupBy("token").agg(parts.alias("parts"))
    summed = F.aggregate(F.slice("parts", 2, 1 << 30), F.get("parts", 0), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    return grouped.select("token", summed.alias("y"))


def moe_layer(tokens: DataFrame, router: DataFrame, experts: DataFrame, k: int = 1, softmax: bool = True) -> DataFrame:
    """token and y of a routed layer."""
    return combine(expert_outputs(tokens, route(tokens, router, k, softmax), experts))


def all_reduce(partials: DataFrame, by: tuple[str, ...] = ("row",)) -> DataFrame:
    """by and y: the element-wise sum of vectors (by, part, y) of one length; sums are partial before the shuffle.

    Vectors of different lengths in one row are an error.
    """
    flat = partials.select(*by, "part", F.posexplode("y").alias("i", "v"))
    sums = flat.groupBy(*by, "i").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    out = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("y"), F.min("n").alias("low"), F.max("n").alias("high"))
    checked = F.when(F.col("low") == F.col("high"), F.col("y")).otherwise(F.raise_error(F.lit("parts of different lengths")))
    return out.select(*by, checked.alias("y"))


def gather(partials: DataFrame, by: tuple[str, ...] = ("row",)) -> DataFrame:
    """by and y: the vectors (by, part, y) put together in order of their parts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "y"))), lambda p: p["y"])
    return partials.groupBy(*by).agg(F.flatten(parts).alias("y"))


def collective(partials: DataFrame, kind: str, elements: int, by: tuple[str, ...] = ("row",)) -> DataFrame:
    """all_reduce() or gather() by name; a result without ``elements`` elements is an error."""
    if kind not in ("all_reduce_sum", "gather"):
        raise ValueError(f"unknown collective {kind}")
    out = all_reduce(partials, by) if kind == "all_reduce_sum" else gather(partials, by)
    wrong = F.raise_error(F.concat(F.lit(f"{kind}: {elements} elements expected, found "), F.size("y").cast("string")))
    return out.withColumn("y", F.when(F.size("y") == elements, F.col("y")).otherwise(wrong))


def split_batch(merged: DataFrame, sizes: DataFrame) -> DataFrame:
    """request and rows: a merged batch (batch, rows array) cut again by (batch, request, place, n)."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return sizes.withColumn("own__at", before).join(merged, "batch").select("request", F.slice("rows", F.col("own__at") + 1, F.col("n").cast("int")).alias("rows"))


def merge_batch(requests: DataFrame) -> DataFrame:
    """batch and rows: the rows of its requests (batch, request, place, rows array), one after the other."""
    return requests.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "rows"))), lambda r: r["rows"])).alias("rows"))


def max_abs_diff(a: DataFrame, b: DataFrame, key: str = "token", tolerance: float = 1e-5) -> DataFrame:
    """n, max_diff and within of two tables (key, y) of vectors; a key that one side lacks, or another length, is not within."""
    rows = a.select(key, F.col("y").alias("p")).join(b.select(key, F.col("y").alias("q")), key, "full_outer")
    fits = F.coalesce(F.size("p") == F.size("q"), F.lit(False))
    diff = F.when(fits, F.coalesce(F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y))), F.lit(0.0)))
    return rows.agg(F.count("*").alias("n"), F.max(diff).alias("max_diff"), F.coalesce(F.min(fits & (diff <= tolerance)), F.lit(True)).alias("within"))


def speed_up(reference_seconds: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, reference_seconds / seconds)


def causal_attention(tokens: DataFrame, groups: int = 1) -> DataFrame:
    """seq, pos, head, y of tokens (seq, pos, head, q, k, v arrays): softmax over the keys up to each position.

    Query head h reads key and value head h div groups. Each query meets the keys of its own sequence only.
    """
    keys = tokens.select("seq", F.col("pos").alias("kpos"), F.col("head").alias("khead"), "k", "v").where("k is not null")
    own = keys.groupBy("seq", "khead").agg(F.array_sort(F.collect_list(F.struct("kpos", "k", "v"))).alias("kv"))
    rows = tokens.select("seq", "pos", "head", "q", F.floor(F.col("head") / groups).cast("long").alias("khead")).join(own.withColumn("khead", F.col("khead").cast("long")), ["seq", "khead"])
    seen = rows.withColumn("kv", F.filter("kv", lambda r: r["kpos"] <= F.col("pos")))
    seen = seen.withColumn("s", F.transform("kv", lambda r: dot(r["k"], F.col("q")) / F.sqrt(F.size("q"))))
    seen = seen.withColumn("w", let(F.array_max("s"), lambda m: F.transform("s", lambda v: F.exp(v - m))))
    scaled = F.zip_with("kv", "w", lambda r, w: F.transform(r["v"], lambda x: x * w))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    y = F.aggregate(F.slice(scaled, 2, 1 << 30), F.get(scaled, 0), lambda a, p: F.zip_with(a, p, lambda x, z: x + z))
    return seen.select("seq", "pos", "head", let(total, lambda t: F.transform(y, lambda x: x / t)).alias("y"))


def _sum(x: Column) -> Column:
    """The sum of an array's numbers without its nulls; null where there is none."""
    return F.aggregate(x, F.lit(None).cast("double"), lambda a, v: F.coalesce(a + v, a, v))


def sequence_attention(tokens: DataFrame, width: int, groups: int = 1, parts: int | None = None) -> DataFrame:
    """seq, pos, head, i, y of tokens (seq, pos, x array): causal attention of heads that are runs of ``width`` elements, in one shuffle by sequence.

    Query head h reads the elements of head h div groups as keys and values. A token that comes twice counts as the sum of
    its rows; elements that a shorter vector lacks, and null ones, add nothing. One sequence is one row. ``parts`` is the
    number of partitions; the work is large beside the bytes that Spark goes by.
    """
    tokens = tokens.where("seq is not null and pos is not null and size(x) > 0").select("seq", "pos", F.col("x").cast("array<double>").alias("x"))
    one = lambda xs: F.aggregate(F.slice(xs, 2, 1 << 30), F.get(xs, 0), lambda a, x: F.zip_with(a, x, lambda v, w: F.coalesce(v + w, v, w)))
    dealt = tokens.repartition("seq") if parts is None else tokens.repartition(parts, "seq")
    placed = dealt.groupBy("seq", "pos").agg(F.collect_list("x").alias("xs")).select("seq", "pos", one(F.col("xs")).alias("x"))
    rows = placed.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("own"))
    rows = rows.withColumn("heads", F.sequence(F.lit(0), F.ceil(F.array_max(F.transform("own", lambda r: F.size(r["x"]))) / width).cast("int") - F.lit(1)))
    part = lambda x, h: F.slice(x, h * width + 1, F.lit(width))
    rows = rows.select("seq", "own", F.explode("heads").alias("head"))
    cut = lambda head: F.filter(F.transform("own", lambda r: F.struct(r["pos"].alias("pos"), part(r["x"], head).alias("x"))), lambda r: F.size(r["x"]) > 0)
    rows = rows.select("seq", "head", F.explode(cut(F.col("head"))).alias("own"), cut(F.floor(F.col("head") / groups).cast("int")).alias("keys"))
    rows = rows.withColumn("pos", F.col("own.pos")).withColumn("q", F.col("own.x"))
    rows = rows.withColumn("kv", F.filter("keys", lambda r: r["pos"] <= F.col("pos"))).where(F.size("kv") > 0)
    rows = rows.withColumn("s", F.transform("kv", lambda r: _sum(F.zip_with("q", r["x"], lambda a, b: a * b)) / F.sqrt(F.lit(float(width)))))
    rows = rows.withColumn("m", F.array_max("s")).withColumn("w", F.transform("s", lambda v: F.exp(v - F.col("m")))).withColumn("t", _sum(F.col("w")))
    most = F.array_max(F.transform("kv", lambda r: F.size(r["x"])))
    at = lambda i: _sum(F.zip_with("kv", "w", lambda r, w: F.get(r["x"], i) * w / F.col("t")))
    return rows.select("seq", "pos", "head", F.posexplode(F.transform(F.sequence(F.lit(0), most - 1), at)).alias("i", "y"))
