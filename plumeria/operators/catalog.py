"""Catalogs of model files as DataFrames: lookups, selection, indexes, placement, sharding and their checks.

Tables (FIXTURES part C):
tensors(name, ordinal, dtype, shape, canonical_variant, packed_variants, shard_id, metadata),
variants(variant_index, target, encoding, storage_dtype, alignment, section_kind, section_index, offset, length, checksum, extra),
sections(ordinal, kind, align, offset, length), devices(id, kind, tier, capacity_bytes, bandwidth_mbps),
placements(shard_id, primary_device, prefetch_priority, replicas). metadata and extra are arrays of (key, value).

Checks return one row for each violation (rule, subject, detail); ``ensure_none`` makes them an error. Where many files are
in one table, their columns named in ``by`` (such as path) tell them apart. Nulls: a tensor without packed variants may have a
null array; a null target or encoding scores as one that is not known.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metadata import WIDTHS, byte_size, first_value, has_prefix, mapped, unique_value, whole_number, with_key

#: Names of targets, device kinds and memory tiers, in the order of their numbers.
TARGETS = ["canonical", "cpu_generic", "cpu_avx2", "cpu_avx512", "cpu_neon", "wgpu", "cuda", "metal", "vulkan", "rocm_hip", "tpu", "cpu_sve", "cpu_riscv_v"]
DEVICES = ["cpu", "cuda", "rocm_hip", "wgpu", "metal"]
TIERS = ["vram", "ram", "nvme"]
#: Base scores (cpu_only, gpu_only, hybrid), and what each target needs. Targets not named score 0.
SCORES = {
    "canonical": (10, 5, 7), "cpu_generic": (20, 0, 18), "cpu_avx2": (25, 0, 23), "cpu_neon": (25, 0, 23), "cpu_avx512": (28, 0, 26), "wgpu": (0, 25, 24),
    "cuda": (0, 28, 26), "metal": (0, 28, 26),
}
MODES = {"cpu_only": 0, "gpu_only": 1, "hybrid": 2}
#: Ordinals of one run of a running sum.
SPAN = 1 << 16
PENALTIES = {"cast_f16": 3, "block_quantized": 5}


def ensure_none(violations: DataFrame, what: str) -> None:
    """Raises with the first violation, if there is one."""
    bad = violations.limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def owned_variants(tensors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tensor and variant of its own: the canonical one at place 0, then the packed ones."""
    own = F.concat(F.array("canonical_variant"), F.coalesce("packed_variants", F.array().cast("array<int>")))
    return tensors.select(*by, "name", "ordinal", "metadata", F.posexplode(own).alias("place", "variant_index"))


def tensor_variants(tensors: DataFrame, variants: DataFrame, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Tensors with their variants, canonical first; variants that no tensor owns are left out.

    ``parts`` is the number of partitions of the join; without it Spark's own, which does not grow with the catalog.
    """
    keys = [*by, "variant_index"]
    own = owned_variants(tensors, by)
    if parts is None:
        return own.join(variants, keys)
    return own.repartition(parts, *keys).join(variants.repartition(parts, *keys), keys)


def _by_name(rows: DataFrame, parts: int | None):
    return (rows if parts is None else rows.repartition(parts, "name")).groupBy("name")


def tensor_entries(tensors: DataFrame, variants: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each tensor with its canonical variant."""
    return tensors.join(variants.withColumnRenamed("variant_index", "canonical_variant"), [*by, "canonical_variant"])


def plan_entries(plan: DataFrame, tensors: DataFrame, variants: DataFrame) -> DataFrame:
    """A plan's rows (position, name, variant_index) with their variants; ``owned`` is false where the tensor has not that variant."""
    own = owned_variants(tensors).select("name", "variant_index", F.lit(True).alias("owned"))
    return plan.join(own, ["name", "variant_index"], "left").join(variants, "variant_index", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def variant_sections(variants: DataFrame, sections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Variants with the section that holds them: the section_index-th of its kind, in order."""
    order = Window.partitionBy(*by, "kind").orderBy("ordinal")
    numbered = sections.select(
        *by, F.col("kind").alias("section_kind"), (F.row_number().over(order) - 1).alias("section_index"), F.col("ordinal").alias("section"),
        F.col("offset").alias("section_offset"), F.col("length").alias("section_length"),
    )
    return variants.join(numbered, [*by, "section_kind", "section_index"], "left")


def target_index(tensors: DataFrame, variants: DataFrame, target: str, strict: bool = False, parts: int | None = None) -> DataFrame:
    """name, targets, variant_index, found: distinct_targets() and variant_by_target() of each tensor, from one join."""
    rows = tensor_variants(tensors, variants, parts=parts).select("name", "place", "variant_index", "target")
    listed = _by_name(rows, parts).agg(F.array_sort(F.collect_list(F.struct("place", "variant_index", "target"))).alias("o"))
    hit = F.get(F.filter("o", lambda v: v["target"] == target), 0)["variant_index"]
    out = listed.select("name", F.array_distinct(F.transform("o", lambda v: v["target"])).alias("targets"), hit.alias("hit"), F.get("o", 0)["variant_index"].alias("canonical"))
    missing = F.raise_error(F.concat(F.lit(f"no variant for {target} of "), "name")) if strict else F.col("canonical")
    return out.select("name", "targets", F.when(F.col("hit").isNotNull(), F.col("hit")).otherwise(missing).alias("variant_index"), F.col("hit").isNotNull().alias("found"))


def variant_by_target(tensors: DataFrame, variants: DataFrame, target: str, strict: bool = False) -> DataFrame:
    """name, variant_index, found: the tensor's first variant of a target, canonical searched first; else its canonical one.

    ``strict`` makes a tensor without the target an error.
    """
    return target_index(tensors, variants, target, strict).select("name", "variant_index", "found")


def distinct_targets(tensors: DataFrame, variants: DataFrame) -> DataFrame:
    """name and targets: its variants' targets in order of first appearance."""
    return target_index(tensors, variants, TARGETS[0]).select("name", "targets")


def base_scores(mode: str, cpu: set[str] = frozenset(), gpu: str | None = None) -> dict[str, int]:
    """The base score of every target in a mode, with CPU features (avx2, avx512, neon) and a GPU back-end (wgpu, cuda, metal)."""
    out = {}
    for name, row in SCORES.items():
        feature = name.removeprefix("cpu_")
        fits = name in ("canonical", "cpu_generic") or feature in cpu or gpu == name or (name == "wgpu" and mode == "hybrid" and gpu is not None)
        out[name] = row[MODES[mode]] if fits else 0
    return out


def select_variants(
    tensors: DataFrame, variants: DataFrame, mode: str = "hybrid", cpu: set[str] = frozenset(), gpu: str | None = None, max_alignment: int = 1 << 30, tier: str | None = None
) -> DataFrame:
    """name, variant_index, target, encoding, tier_intent, tier_class, score: the best variant of each tensor.

    The score is the target's base score, less 10,000 where the alignment is over the largest one, less 3 for f16 casts and 5
    for block quantisation. Ties go to the smaller penalty, the smaller alignment, then the first. With a tier, only variants
    of that tier.intent are compared, where the tensor has any.
    """
    return select_variants_cases(tensors, variants, [(mode, cpu, gpu, tier)], max_alignment).drop("case", "mode")


def select_variants_cases(
    tensors: DataFrame, variants: DataFrame, cases: list[tuple[str, set[str], str | None, str | None]], max_alignment: int = 1 << 30, parts: int | None = None
) -> DataFrame:
    """case (its place in the list), mode and the columns of select_variants() for each (mode, cpu, gpu, tier), from one join and one grouping."""
    for *_, tier in cases:
        if tier is not None and tier not in TIERS:
            raise ValueError(f"unknown tier {tier}")
    x = F.col("extra")
    rows = tensor_variants(tensors, variants, parts=parts).select(
        "name", "place", "variant_index", "target", "encoding", "alignment", unique_value(x, "tier.intent").alias("tier_intent"), unique_value(x, "tier.class").alias("tier_class"))
    penalty = F.coalesce(mapped(F.col("encoding"), PENALTIES), F.lit(0))
    over = F.when(F.col("alignment") > max_alignment, 10_000).otherwise(0)
    facts = ["variant_index", "target", "encoding", "tier_intent", "tier_class"]

    def best(mode: str, cpu: set[str], gpu: str | None, tier: str | None) -> Column:
        score = F.coalesce(mapped(F.col("target"), base_scores(mode, cpu, gpu)), F.lit(0)) - over - penalty
        # variants of the tier come before all others, so that these count only where there are none
        misses = F.lit(0) if tier is None else F.when(F.col("tier_intent") == tier, 0).otherwise(1)
        return F.min_by(F.struct(*facts, score.alias("score")), F.struct(misses, -score, penalty, F.col("alignment"), F.col("place")))

    found = _by_name(rows, parts).agg(*(best(*case).alias(f"b{i}") for i, case in enumerate(cases)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("case"), F.lit(case[0]).alias("mode"), F.col(f"b{i}").alias("b")) for i, case in enumerate(cases)))).alias("c")
    return found.select("name", each).select("c.case", "c.mode", "name", "c.b.*")


def inspect(tensors: DataFrame, variants: DataFrame, sections: DataFrame, graphs: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: counts of all tables, bytes of all variants, and the graphs' kinds in order."""
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("tensors", tensors), ("variants", variants), ("sections", sections), ("graphs", graphs), ("assets", assets))]
    counts.append(variants.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("payload_bytes")))
    counts.append(graphs.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "kind"))), lambda g: g["kind"]).alias("graph_kinds")))
    return reduce(lambda a, b: a.crossJoin(b), counts)  # rows of aggregates, one each


# checks


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def section_violations(sections: DataFrame, file_bytes: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Sections that are empty, lie past the end of the file, are not aligned (or to no power of two), or overlap the one before."""
    end = F.col("offset") + F.col("length")
    size = F.lit(file_bytes) if isinstance(file_bytes, int) else file_bytes
    rows = sections.withColumn("before", F.lag(end).over(Window.partitionBy(*by).orderBy("ordinal"))) if by else sections.withColumn("before", F.lag(end).over(Window.orderBy("ordinal")))
    subject = F.concat_ws("/", *by, F.col("ordinal").cast("string"))
    power = (F.col("align") > 0) & (F.col("align").bitwiseAND(F.col("align") - 1) == 0)
    return _all([
        _rows(rows.where("length <= 0"), "empty section", subject, F.col("length")), _rows(rows.where(end > size), "past the end", subject, end),
        _rows(rows.where(~power), "alignment", subject, F.col("align")), _rows(rows.where(power & (F.col("offset") % F.col("align") != 0)), "misaligned section", subject, F.col("offset")),
        _rows(rows.where(F.col("before") > F.col("offset")), "overlap", subject, F.col("before")),
    ])


def manifest_violations(tensors: DataFrame, variants: DataFrame, sections: DataFrame) -> DataFrame:
    """Duplicate names; variants without a section or out of it; canonical alignment under 64; lengths and offsets that do not fit."""
    twice = tensors.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    placed = variant_sections(variants, sections)
    canonical = tensor_entries(tensors, variants)
    width = mapped(F.col("dtype"), WIDTHS)
    raw = canonical.where(F.coalesce(F.col("encoding"), F.lit("raw")) == "raw")
    index = F.col("variant_index")
    return _all([
        _rows(twice, "duplicate name", F.col("name"), F.col("n")), _rows(placed.where("section is null"), "missing arena", index, F.col("section_index")),
        _rows(placed.where("offset < 0 or length < 0 or offset + length > section_length"), "out of arena", index, F.col("offset") + F.col("length")),
        _rows(canonical.where("alignment < 64"), "canonical alignment", F.col("name"), F.col("alignment")),
        _rows(raw.where(F.coalesce(F.col("length") != byte_size(F.col("shape"), F.col("dtype")), F.lit(True))), "length", F.col("name"), F.col("length")),
        _rows(canonical.where(F.col("length") % width != 0), "length of elements", F.col("name"), F.col("length")),
        _rows(variants.where("alignment > 0 and offset % alignment <> 0"), "misaligned", index, F.col("offset")),
        _rows(owned_variants(tensors).join(variants, "variant_index", "left_anti"), "missing variant", F.col("name"), index),
    ])


def placement_violations(placements: DataFrame, devices: DataFrame, shards: DataFrame) -> DataFrame:
    """Devices or placements that come twice, unknown shards, primary devices and replicas, unknown kinds and tiers, priorities out of range."""
    ids = devices.select(F.col("id").alias("device"))
    replicas = placements.select("shard_id", F.explode("replicas").alias("device"))
    return _all([
        _rows(devices.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate device", F.col("id"), F.col("n")),
        _rows(placements.groupBy("shard_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate placement", F.col("shard_id"), F.col("n")),
        _rows(placements.join(shards.select("shard_id").distinct(), "shard_id", "left_anti"), "unknown shard", F.col("shard_id"), F.lit(None)),
        _rows(placements.select("shard_id", F.col("primary_device").alias("device")).join(ids, "device", "left_anti"), "unknown primary", F.col("shard_id"), F.col("device")),
        _rows(replicas.join(ids, "device", "left_anti"), "unknown replica", F.col("shard_id"), F.col("device")),
        _rows(devices.where(~F.col("kind").isin(DEVICES)), "unknown kind", F.col("id"), F.col("kind")), _rows(devices.where(~F.col("tier").isin(TIERS)), "unknown tier", F.col("id"), F.col("tier")),
    ])


def tier_violations(variants: DataFrame) -> DataFrame:
    """tier.intent that comes twice or is not known, tier.class that comes twice or is empty."""
    intent, kind = with_key(F.col("extra"), "tier.intent"), with_key(F.col("extra"), "tier.class")
    index = F.col("variant_index")
    return _all([
        _rows(variants.where(F.size(intent) > 1), "duplicate tier.intent", index, F.size(intent)),
        _rows(variants.where(F.exists(intent, lambda m: ~m["value"].isin(TIERS))), "unknown tier.intent", index, F.get(intent, 0)["value"]),
        _rows(variants.where(F.size(kind) > 1), "duplicate tier.class", index, F.size(kind)), _rows(variants.where(F.exists(kind, lambda m: m["value"] == "")), "empty tier.class", index, F.lit("")),
    ])


# indexes over metadata


def moe_index(tensors: DataFrame) -> DataFrame:
    """layer, expert_id, shared, role, names (in order) and first ordinal of the tensors with moe.* metadata; first-seen order is by ``first``.

    Tensors without such metadata are left out; broken ones are in moe_violations().
    """
    m = F.col("metadata")
    rows = tensors.where(has_prefix(m, "moe.")).select(
        "name", "ordinal", whole_number(first_value(m, "moe.layer")).alias("layer"), whole_number(first_value(m, "moe.expert")).alias("expert_id"),
        F.coalesce(first_value(m, "moe.shared") == "1", F.lit(False)).alias("shared"), F.coalesce(first_value(m, "moe.role"), F.lit("")).alias("role"),
    )
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    return rows.groupBy("layer", "expert_id", "shared", "role").agg(F.min("ordinal").alias("first"), names.alias("names"))


def moe_violations(tensors: DataFrame) -> DataFrame:
    m = F.col("metadata")
    rows = tensors.where(has_prefix(m, "moe.")).select("name", *(first_value(m, f"moe.{k}").alias(k) for k in ("layer", "expert", "shared")))
    return _all([
        _rows(rows.where("layer is null"), "no moe.layer", F.col("name"), F.lit(None)),
        _rows(rows.where(F.col("layer").isNotNull() & whole_number(F.col("layer")).isNull()), "invalid moe.layer", F.col("name"), F.col("layer")),
        _rows(rows.where(F.col("expert").isNotNull() & whole_number(F.col("expert")).isNull()), "invalid moe.expert", F.col("name"), F.col("expert")),
        _rows(rows.where("shared <> '1'"), "invalid moe.shared", F.col("name"), F.col("shared")),
    ])


def adapter_index(tensors: DataFrame) -> DataFrame:
    """adapter, kind, rank, alpha, scale (alpha / rank), first, entries (name, role, target) in order, and conflict.

    ``conflict`` names what its tensors do not agree on: kind, rank or alpha (further apart than single precision's epsilon).
    """
    m = F.col("metadata")
    rows = tensors.where(first_value(m, "adapter.name").isNotNull()).select(
        first_value(m, "adapter.name").alias("adapter"), "ordinal", "name", F.coalesce(first_value(m, "adapter.role"), F.lit("")).alias("role"), first_value(m, "adapter.target").alias("target"),
        F.coalesce(first_value(m, "adapter.kind"), F.lit("lora")).alias("kind"), whole_number(first_value(m, "adapter.rank")).alias("rank"), first_value(m, "adapter.alpha").try_cast("float").alias("alpha"),
    )
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "role", "target"))), lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"), x["target"].alias("target")))
    conflict = F.when(F.count_distinct("kind") > 1, "kind").when(F.count_distinct("rank") > 1, "rank").when(F.max("alpha") - F.min("alpha") > 1.1920929e-7, "alpha")
    out = rows.groupBy("adapter").agg(
        F.min_by("kind", "ordinal").alias("kind"), F.max_by("rank", F.when(F.col("rank").isNotNull(), F.col("ordinal"))).alias("rank"),
        F.max_by("alpha", F.when(F.col("alpha").isNotNull(), F.col("ordinal"))).alias("alpha"), F.min("ordinal").alias("first"), entries.alias("entries"), conflict.alias("conflict"),
    )
    return out.withColumn("scale", F.when(F.col("rank") > 0, F.col("alpha").cast("double") / F.col("rank")))


def prefetch_index(tensors: DataFrame, variants: DataFrame) -> DataFrame:
    """group, members (name, variant_index) in order, and its affinity: distinct comma-separated words in order of first appearance."""
    x = F.col("extra")
    rows = tensor_variants(tensors, variants).where(has_prefix(x, "prefetch."))
    group = F.coalesce(unique_value(x, "prefetch.group"), F.raise_error(F.concat(F.lit("no prefetch.group of "), "name")))
    words = F.transform(F.split(unique_value(x, "prefetch.affinity"), ","), lambda w: F.trim(w))
    words = F.when(F.exists(words, lambda w: w == ""), F.raise_error(F.concat(F.lit("empty prefetch.affinity word of "), "name"))).otherwise(words)
    rows = rows.select(group.alias("group"), "ordinal", "place", "name", "variant_index", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "place", "name", "variant_index", "words")))
    out = rows.groupBy("group").agg(ordered.alias("o"))
    return out.select("group", F.transform("o", lambda r: F.struct(r["name"].alias("name"), r["variant_index"].alias("variant_index"))).alias("members"), F.array_distinct(F.flatten(F.transform("o", lambda r: r["words"]))).alias("affinity"))


# placement


def devices_of(placements: DataFrame) -> DataFrame:
    """shard_id and devices: the primary one, then the replicas, each once."""
    return placements.select("shard_id", F.array_distinct(F.concat(F.array("primary_device"), F.coalesce("replicas", F.array().cast("array<bigint>")))).alias("devices"))


def device_union(placements: DataFrame) -> list[int]:
    """All devices of the placements in order of first appearance (by shard); as many as there are devices."""
    rows = devices_of(placements).select("shard_id", F.posexplode("devices").alias("pos", "device"))
    return [r.device for r in rows.groupBy("device").agg(F.min(F.struct("shard_id", "pos")).alias("first")).orderBy("first").collect()]


def resolve_placement(tensors: DataFrame, placements: DataFrame, devices: DataFrame) -> DataFrame:
    """Each tensor with its shard's placement and primary device; ``status`` tells which step is missing."""
    rows = tensors.join(placements, "shard_id", "left").join(devices.withColumnRenamed("id", "primary_device").withColumnRenamed("kind", "device_kind"), "primary_device", "left")
    status = F.when(F.col("shard_id").isNull(), "no shard").when(F.col("primary_device").isNull(), "no placement").when(F.col("device_kind").isNull(), "no device").otherwise("ok")
    return rows.withColumn("status", status)


def residency_totals(experts: DataFrame) -> DataFrame:
    """device_id, bytes and the sorted shards, experts and groups of planned experts (device_id, bytes, shard_id, expert_id, group)."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    return experts.groupBy("device_id").agg(F.sum("bytes").alias("bytes"), ids("shard_id").alias("shards"), ids("expert_id").alias("experts"), ids("group").alias("groups"))


def transfer_plan(experts: DataFrame, devices: DataFrame) -> DataFrame:
    """expert_id, device_id, kind (none, host_to_device, unsupported) and bytes of each planned expert.

    CPU devices and RAM tiers keep the host's bytes; VRAM is copied to; other tiers of other devices are not supported.
    """
    kind = F.when((F.col("device_kind") == "cpu") | (F.col("tier") == "ram"), "none").when(F.col("tier") == "vram", "host_to_device").otherwise("unsupported")
    named = devices.select(F.col("id").alias("device_id"), F.col("kind").alias("device_kind"), "tier")
    return experts.join(named, "device_id").select("expert_id", "shard_id", "device_id", kind.alias("kind"), "bytes")


def transfer_totals(steps: DataFrame) -> DataFrame:
    return steps.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "host_to_device", F.col("bytes"))), F.lit(0)).alias("planned_bytes"),
        F.count(F.when(F.col("kind") == "unsupported", 1)).alias("unsupported"),
    )


def adapter_status(requested: Column, available: Column, active: Column) -> Column:
    """How many GPU adapters serve the requested devices: available, partial, or one for all."""
    return F.when(requested <= active, "available").when(active > 1, "partial").otherwise("logical_single_adapter")


# state dictionaries


def state_dict_issues(expected: DataFrame, actual: DataFrame, strict: bool = True) -> DataFrame:
    """issue, name, expected, actual: what a state dict (name, dtype, shape) lacks or has against its schema (name, dtype, shape, required)."""
    rows = expected.select("name", F.struct("dtype", "shape", "required").alias("e")).join(actual.select("name", F.struct("dtype", "shape").alias("a")), "name", "full_outer")
    text = lambda side, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias(c)))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    issue = lambda kind, when, c=None: F.when(when, F.struct(F.lit(kind).alias("issue"), (text("e", c) if c else F.lit(None).cast("string")).alias("expected"), (text("a", c) if c else F.lit(None).cast("string")).alias("actual")))
    found = F.array_compact(F.array(
        issue("missing", F.col("e").isNotNull() & F.col("a").isNull() & F.col("e.required")), issue("unexpected", F.col("e").isNull() & F.lit(strict)),
        issue("dtype", both & (F.col("e.dtype") != F.col("a.dtype")), "dtype"), issue("shape", both & (F.col("e.shape") != F.col("a.shape")), "shape"),
    ))
    return rows.select("name", F.explode(found).alias("x")).select("x.issue", "name", "x.expected", "x.actual")


def missing_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select("name").distinct().join(actual.select("name").distinct(), "name", "left_anti")


def unexpected_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_keys(actual, expected)


def binding_issues(bindings: DataFrame, inputs: DataFrame) -> DataFrame:
    """tensor, input, issue of bindings (tensor, input, dtype, shape) against a graph's inputs (input, dtype, shape)."""
    rows = bindings.join(inputs.select("input", F.col("dtype").alias("want_dtype"), F.col("shape").alias("want_shape")), "input", "left")
    issue = F.when(F.col("want_dtype").isNull(), "undeclared").when(F.col("dtype") != F.col("want_dtype"), "dtype").when(F.col("shape") != F.col("want_shape"), "shape")
    return rows.withColumn("issue", issue).where("issue is not null").select("tensor", "input", "issue")


def decoder_tensors(config: DataFrame) -> DataFrame:
    """name and shape of every tensor that a decoder's configuration (columns of model_config()) calls for."""
    layer = config.select("*", F.explode(F.sequence(F.lit(0), F.col("num_hidden_layers") - 1)).alias("layer"))
    hidden, inner = F.col("hidden_size"), F.col("intermediate_size")
    kv = F.col("num_key_value_heads") * (hidden / F.col("num_attention_heads")).cast("long")
    parts = {
        "input_layernorm": F.array(hidden), "self_attn.q_proj": F.array(hidden, hidden), "self_attn.k_proj": F.array(kv, hidden), "self_attn.v_proj": F.array(kv, hidden),
        "self_attn.o_proj": F.array(hidden, hidden), "post_attention_layernorm": F.array(hidden), "mlp.gate_proj": F.array(inner, hidden), "mlp.up_proj": F.array(inner, hidden), "mlp.down_proj": F.array(hidden, inner),
    }
    name = lambda p: F.concat(F.lit("model.layers."), F.col("layer").cast("string"), F.lit(f".{p}.weight"))
    each = F.explode(F.array(*(F.struct(name(p).alias("name"), s.alias("shape")) for p, s in parts.items()))).alias("t")
    vocab = F.array(F.col("vocab_size"), hidden)
    heads = [F.struct(F.lit("model.embed_tokens.weight").alias("name"), vocab.alias("shape")), F.struct(F.lit("model.norm.weight").alias("name"), F.array(hidden).alias("shape"))]
    own = F.when(~F.col("tie_word_embeddings"), F.struct(F.lit("lm_head.weight").alias("name"), vocab.alias("shape")))
    return layer.select(each).select("t.*").unionByName(config.select(F.explode(F.array_compact(F.array(*heads, own))).alias("t")).select("t.*"))


# layout and sharding


def aligned_layout(items: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """items (by, ordinal, length, align) with the offset of each: the end of the one before, aligned to its own alignment.

    With one alignment a file it is a running sum; mixed ones are folded over the file's own list of (ordinal, length, align).
    """
    rows = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("length").cast("long").alias("length"), F.col("align").cast("long").alias("align")))).alias("list"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("at"))

    def put(a: Column, x: Column) -> Column:
        at = F.floor((a["end"] + x["align"] - 1) / x["align"]).cast("long") * x["align"]
        return F.struct((at + x["length"]).alias("end"), F.concat(a["at"], F.array(at)).alias("at"))

    placed = rows.withColumn("at", F.aggregate("list", start, put)["at"])
    return placed.select(*by, F.explode(F.arrays_zip("list", "at")).alias("x")).select(*by, "x.list.ordinal", "x.list.length", "x.list.align", F.col("x.at").alias("offset"))


def even_layout(items: DataFrame, align: int, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """items (by, ordinal, length) with the offset of each, all with one alignment: what aligned_layout() gives for it.

    A running sum over runs of SPAN ordinals, then over the runs' sums, so that no task holds a file's list.
    """
    run = F.floor(F.col("ordinal") / SPAN)
    rows = items.withColumns({"own__run": run, "own__step": F.ceil(F.col("length") / align).cast("long") * align})
    sums = rows.groupBy(*by, "own__run").agg(F.sum("own__step").alias("own__sum"))
    before = F.sum("own__sum").over(Window.partitionBy(*by).orderBy("own__run").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("own__step").over(Window.partitionBy(*by, "own__run").orderBy("ordinal", "length").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, "own__run", F.coalesce(before, F.lit(0)).alias("own__start"))
    placed = rows.withColumn("own__inside", F.coalesce(inside, F.lit(0))).join(starts, [*by, "own__run"])
    return placed.select(*by, "ordinal", "length", F.lit(align).alias("align"), (F.col("own__start") + F.col("own__inside")).alias("offset"))


def dedup_payloads(payloads: DataFrame) -> DataFrame:
    """payloads (arena, ordinal, digest, length, align) with ``stored_at``: the ordinal whose bytes it shares, else its own.

    In each arena the first payload of a digest and length is stored; a later one shares it if the stored payload's alignment
    is a multiple of its own.
    """
    first = F.first(F.struct("ordinal", "align")).over(Window.partitionBy("arena", "digest", "length").orderBy("ordinal"))
    return payloads.withColumn("own__first", first).withColumn("stored_at", F.when(F.col("own__first.align") % F.col("align") == 0, F.col("own__first.ordinal")).otherwise(F.col("ordinal"))).drop("own__first")


def expert_group(metadata: Column) -> Column:
    """What an expert sharding keeps together: layer and expert, layer and shared, or a layer's dense tensors; null without a layer."""
    layer, expert = first_value(metadata, "moe.layer"), first_value(metadata, "moe.expert")
    kind = F.when(expert.isNotNull(), F.concat(F.lit("expert="), expert)).when(first_value(metadata, "moe.shared") == "1", F.lit("shared=1")).otherwise(F.lit("dense"))
    return F.when(layer.isNotNull(), F.concat(F.lit("layer="), layer, F.lit(";"), kind))


def assign_shards(tensors: DataFrame, shards: int, grouped: bool, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """by, name, shard_id (from 1) of tensors (by, name, ordinal, bytes, group), each model by itself.

    By size (``grouped`` false): the largest first, to the shard with the least bytes, the lowest on ties. Grouped: in order, a
    group that is first seen takes the next shard in turn; tensors without a group go where the least bytes are at that
    point. One model's list of tensors is folded in one task; models are spread over tasks.
    """
    schema = T.StructType([tensors.schema[c] for c in by] + [tensors.schema["name"], T.StructField("shard_id", T.LongType())])

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ordinal" if grouped else ["bytes", "ordinal"], ascending=True if grouped else [False, True])
        loads = [(0, k) for k in range(1, shards + 1)]
        taken: dict[str, int] = {}
        out = []
        for size, group in zip(own["bytes"].tolist(), own["group"].tolist() if grouped else [None] * len(own), strict=True):
            if group is not None and group == group:
                shard = taken.setdefault(group, len(taken) % shards + 1)
                loads = [(b + size * (k == shard), k) for b, k in loads]
                heapq.heapify(loads)
            else:
                load, shard = loads[0]
                heapq.heapreplace(loads, (load + size, shard))
            out.append(shard)
        return own[[*by, "name"]].assign(shard_id=out)

    return tensors.groupBy(*by).applyInPandas(fold, schema)


# tensor parallelism


def partition_specs(tensors: DataFrame) -> DataFrame:
    """name, ordinal, shape, layer, expert_id, partition_index, partition_count, axis, collective of tensors with moe.partition_* metadata."""
    m = F.col("metadata")
    return tensors.where(has_prefix(m, "moe.partition_")).select(
        "name", "ordinal", "shape", whole_number(first_value(m, "moe.layer")).alias("layer"), whole_number(first_value(m, "moe.expert")).alias("expert_id"),
        whole_number(first_value(m, "moe.partition_index")).alias("partition_index"), whole_number(first_value(m, "moe.partition_count")).alias("partition_count"),
        first_value(m, "moe.partition_axis").alias("axis"), first_value(m, "moe.collective").alias("collective"),
    )


def partition_issues(specs: DataFrame, hidden: int) -> DataFrame:
    """layer, expert_id, issue of partition sets: count, duplicate or missing indices, axes or collectives that differ, and widths.

    Column partitions have to cover the hidden width with one number of rows; row partitions have to be as wide as it, and with
    a sum, of one number of rows.
    """
    rows, cols = F.get("shape", 0), F.get("shape", 1)
    g = specs.groupBy("layer", "expert_id").agg(
        F.count("*").alias("n"), F.min("partition_count").alias("low"), F.max("partition_count").alias("high"), F.count_distinct("partition_index").alias("different"), F.min("partition_index").alias("least"),
        F.max("partition_index").alias("most"), F.count_distinct(F.struct("axis", "collective")).alias("kinds"), F.min("axis").alias("axis"), F.min("collective").alias("collective"),
        F.sum(cols).alias("width"), F.min(cols).alias("least_cols"), F.max(cols).alias("most_cols"), F.count_distinct(rows).alias("row_kinds"),
    )
    bad = lambda kind, when: F.when(when, F.lit(kind))
    by_rows = F.col("axis") == "rows"
    found = F.array_compact(F.array(
        bad("count", (F.col("low") != F.col("high")) | (F.col("low") != F.col("n"))), bad("duplicate index", F.col("different") < F.col("n")),
        bad("not contiguous", (F.col("least") != 0) | (F.col("most") + 1 != F.col("different"))), bad("axis or collective differs", F.col("kinds") > 1),
        bad("width", F.when(by_rows, (F.col("least_cols") != hidden) | (F.col("most_cols") != hidden)).otherwise(F.col("width") != hidden)),
        bad("rows differ", (~by_rows | (F.col("collective") == "all_reduce_sum")) & (F.col("row_kinds") > 1)),
    ))
    return g.select("layer", "expert_id", F.explode(found).alias("issue"))


def parallel_plan(specs: DataFrame) -> DataFrame:
    """layer, expert_id, status, collective and steps of each expert: not_required with one partition, else cpu_reference for whole row gathers, else unavailable."""
    g = specs.groupBy("layer", "expert_id").agg(F.count("*").alias("n"), F.max("partition_count").alias("parts"), F.min("axis").alias("axis"), F.min("collective").alias("collective"))
    whole = (F.col("axis") == "rows") & (F.col("collective") == "gather") & (F.col("n") == F.col("parts"))
    status = F.when(F.col("parts") <= 1, "not_required").when(whole, "cpu_reference").otherwise("unavailable")
    return g.select("layer", "expert_id", status.alias("status"), "collective", F.when(F.col("parts") <= 1, 0).otherwise(1).alias("steps"))
