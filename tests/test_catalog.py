"""Catalog operators on small tables, with the results worked out by hand or by plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumeria.functions import metadata as M
from plumeria.operators import catalog as C

PAIRS = "array<struct<key:string,value:string>>"


def meta(**kv):
    return [(k.replace("__", "."), v) for k, v in kv.items()]


def tables(spark, rows):
    """rows: (name, dtype, shape, metadata, [(index, target, encoding, alignment, extra)])."""
    t = [(n, k, d, s, v[0][0], [x[0] for x in v[1:]], 0, m) for k, (n, d, s, m, v) in enumerate(rows)]
    v = [(x[0], x[1], x[2], "f32", x[3], 1, 0, 64 * x[0], 16, "d", x[4]) for *_, vs in rows for x in vs]
    return (
        spark.createDataFrame(t, f"name string, ordinal int, dtype string, shape array<bigint>, canonical_variant int, packed_variants array<int>, shard_id long, metadata {PAIRS}"),
        spark.createDataFrame(v, f"variant_index int, target string, encoding string, storage_dtype string, alignment int, section_kind int, section_index int, offset long, length long, checksum string, extra {PAIRS}"),
    )


def one(spark, value, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {PAIRS if isinstance(v, list) and v and isinstance(v[0], tuple) else 'array<bigint>' if isinstance(v, list) else 'string'}" for k, v in columns.items()))
    return df.select(value).first()[0]


def test_metadata(spark):
    m, c = [("a", "1"), ("b", "2"), ("a", "3")], F.col("m")
    pairs = lambda x: [tuple(p) for p in one(spark, x, m=m)]
    assert one(spark, M.first_value(c, "a"), m=m) == "1" and one(spark, M.first_value(c, "z"), m=m) is None and one(spark, M.unique_value(c, "b"), m=m) == "2"
    with pytest.raises(Exception, match="duplicate a"):
        one(spark, M.unique_value(c, "a"), m=m)
    assert pairs(M.upsert(c, "a", F.lit("9"))) == [("a", "9"), ("b", "2"), ("a", "3")] and pairs(M.upsert(c, "z", F.lit("9"))) == [*m, ("z", "9")]
    assert pairs(M.replaced(c, "a", F.lit("9"))) == [("b", "2"), ("a", "9")] and pairs(M.with_prefix(c, "b")) == [("b", "2")] and pairs(M.without_prefix(c, "a")) == [("b", "2")]
    assert one(spark, M.element_count(F.col("s")), s=[3, 4]) == 12 and one(spark, M.element_count(F.col("s")), s=[1 << 40, 1 << 40]) is None and one(spark, M.element_count(F.col("s")), s=[]) == 1
    assert one(spark, M.byte_size(F.col("s"), F.lit("bf16")), s=[3, 4]) == 24
    assert [one(spark, M.whole_number(F.col("t")), t=t) for t in ("7", "+7", "-7", "4294967296", "x", "07")] == [7, 7, None, None, None, 7]
    kinds = {"[1,2]": "array", "[1,": "string", "true": "bool", "12": "int", "-3": "int", "1.5": "float", "1e3": "float", "inf": "string", "llama": "string", "99999999999999999999": "float"}
    assert {t: one(spark, M.typed(F.col("t")), t=t)[0] for t in kinds} == kinds


def test_config(spark):
    base = {"model_type": "llama", "hidden_size": 8, "intermediate_size": 16, "num_hidden_layers": 2, "num_attention_heads": 4, "vocab_size": 10, "max_position_embeddings": 32}
    of = lambda **kv: one(spark, M.model_config(F.col("t")), t=json.dumps(base | kv))
    c = of(eos_token_id=[1, 2])
    assert (c.num_key_value_heads, c.rms_norm_eps, c.rope_theta, c.tie_word_embeddings, c.eos_token_ids, c.problem) == (4, 1e-6, 10000.0, False, [1, 2], None)
    assert of(eos_token_id=7).eos_token_ids == [7] and of().eos_token_ids == [] and "divisible" in of(hidden_size=9).problem and "positive" in of(vocab_size=0).problem and "num_key_value_heads" in of(num_key_value_heads=3).problem
    config = spark.createDataFrame([(json.dumps(base | {"num_key_value_heads": 2}),)], "t string").select(M.model_config(F.col("t")).alias("c")).select("c.*")
    want = {r.name: r["shape"] for r in C.decoder_tensors(config).collect()}
    assert len(want) == 2 * 9 + 3 and want["model.layers.1.self_attn.k_proj.weight"] == [4, 8] and want["model.layers.0.mlp.down_proj.weight"] == [8, 16] and want["lm_head.weight"] == [10, 8]


def plain_select(rows, mode, cpu, gpu, most, tier):
    scores = C.base_scores(mode, cpu, gpu)
    out = {}
    for name, _, _, _, vs in rows:
        fit = [v for v in vs if dict(v[4]).get("tier.intent") == tier] if tier else []
        best = None
        for v in fit or vs:
            pen = {"cast_f16": 3, "block_quantized": 5}.get(v[2], 0)
            score = scores.get(v[1], 0) - (10000 if v[3] > most else 0) - pen
            key = (-score, pen, v[3])
            if best is None or key < best[0]:
                best = (key, v[0], score)
        out[name] = best[1:]
    return out


def test_selection(spark):
    r = random.Random(4)
    rows, k = [], 0
    for n in range(60):
        vs = []
        for j in range(r.randrange(1, 6)):
            extra = [("tier.intent", r.choice(C.TIERS))] if r.random() < 0.5 else []
            vs.append((k, "canonical" if j == 0 else r.choice(C.TARGETS[1:] + ["other"]), r.choice(["raw", "cast_f16", "block_quantized"]), r.choice([64, 256, 4096]), extra))
            k += 1
        rows.append((f"t{n}", "f32", [4], [], vs))
    t, v = tables(spark, rows)
    for mode, cpu, gpu, most, tier in [("cpu_only", {"avx2"}, None, 1024, None), ("gpu_only", set(), "cuda", 1 << 20, None), ("hybrid", {"neon", "avx512"}, "wgpu", 256, "ram"), ("hybrid", set(), "metal", 64, "nvme")]:
        got = {x.name: (x.variant_index, x.score) for x in C.select_variants(t, v, mode, cpu, gpu, most, tier).collect()}
        assert got == plain_select(rows, mode, cpu, gpu, most, tier)
    assert C.base_scores("hybrid", gpu="cuda")["wgpu"] == 24 and C.base_scores("gpu_only", gpu="cuda")["wgpu"] == 0 and C.base_scores("cpu_only")["cpu_avx2"] == 0
    small = tables(spark, [("a", "f32", [4], [], [(0, "canonical", "raw", 64, []), (1, "wgpu", "cast_f16", 64, [("tier.intent", "vram"), ("tier.class", "hot")]), (2, "wgpu", "block_quantized", 64, [("tier.intent", "nvme"), ("tier.class", "cold")])])])
    pick = lambda tier: tuple(C.select_variants(*small, "hybrid", gpu="wgpu", tier=tier).first()[c] for c in ("variant_index", "tier_class"))
    assert pick(None) == (1, "hot") and pick("nvme") == (2, "cold") and pick("ram") == (1, "hot")
    found = {x.name: (x.variant_index, x.found) for x in C.variant_by_target(*small, "wgpu").collect()}
    assert found == {"a": (1, True)} and C.variant_by_target(*small, "cuda").first().variant_index == 0
    with pytest.raises(Exception, match="no variant"):
        C.variant_by_target(*small, "cuda", strict=True).collect()
    assert C.distinct_targets(*small).first().targets == ["canonical", "wgpu"]
    plan = spark.createDataFrame([(0, "a", 2), (1, "a", 9)], "position int, name string, variant_index int")
    assert [x.owned for x in C.plan_entries(plan, *small).orderBy("position").collect()] == [True, False]


def test_structure_checks(spark):
    s = spark.createDataFrame([(0, 1, 64, 0, 100), (1, 1, 64, 64, 0), (2, 2, 64, 130, 10), (3, 2, 3, 192, 9000)], "ordinal int, kind int, align int, offset long, length long")
    got = {(r.rule, r.subject) for r in C.section_violations(s, 1000).collect()}
    assert got == {("empty section", "1"), ("overlap", "1"), ("misaligned section", "2"), ("alignment", "3"), ("past the end", "3")}
    t, v = tables(spark, [("a", "f32", [4], [], [(0, "canonical", "raw", 64, [])]), ("a", "f32", [3], [], [(1, "canonical", "raw", 32, []), (9, "cuda", "raw", 48, [])])])
    sections = spark.createDataFrame([(0, 1, 64, 0, 70)], "ordinal int, kind int, align int, offset long, length long")
    assert {(r.rule, r.subject) for r in C.manifest_violations(t, v, sections).collect()} == {
        ("duplicate name", "a"), ("out of arena", "1"), ("out of arena", "9"), ("canonical alignment", "a"), ("length", "a")}
    with pytest.raises(ValueError, match="duplicate name"):
        C.ensure_none(C.manifest_violations(t, v, sections).where("rule = 'duplicate name'"), "catalog")


def test_indexes(spark):
    v1 = lambda k, **x: [(k, "canonical", "raw", 64, meta(**x))]
    rows = [
        ("r", "f32", [4], meta(moe__layer="0", moe__role="router"), v1(0, prefetch__group="g1", prefetch__affinity="x, y")), ("e1u", "f32", [4], meta(moe__layer="0", moe__expert="1", moe__role="up"), v1(1, prefetch__group="g2")),
        ("e0u", "f32", [4], meta(moe__layer="0", moe__expert="0", moe__role="up"), v1(2, prefetch__group="g1", prefetch__affinity="y,z")), ("sh", "f32", [4], meta(moe__layer="0", moe__shared="1", moe__role="up"), v1(3)),
        ("e1u2", "f32", [4], meta(moe__layer="0", moe__expert="1", moe__role="up"), v1(4)), ("bad", "f32", [4], meta(moe__expert="x", moe__shared="2"), v1(5)),
        ("la", "f32", [4], meta(adapter__name="A", adapter__rank="8", adapter__alpha="16", adapter__role="a"), v1(6)), ("lb", "f32", [4], meta(adapter__name="A", adapter__role="b"), v1(7)),
        ("lc", "f32", [4], meta(adapter__name="B", adapter__rank="4", adapter__alpha="8"), v1(8)), ("ld", "f32", [4], meta(adapter__name="B", adapter__rank="5"), v1(9)),
    ]
    t, v = tables(spark, rows)
    groups = [(r.expert_id, r.shared, r.role, r.names) for r in C.moe_index(t).where("layer = 0").orderBy("first").collect()]
    assert groups == [(None, False, "router", ["r"]), (1, False, "up", ["e1u", "e1u2"]), (0, False, "up", ["e0u"]), (None, True, "up", ["sh"])]
    assert {(r.rule, r.subject) for r in C.moe_violations(t).collect()} == {("no moe.layer", "bad"), ("invalid moe.expert", "bad"), ("invalid moe.shared", "bad")}
    adapters = {r.adapter: r for r in C.adapter_index(t).collect()}
    assert adapters["A"].scale == 2.0 and adapters["A"].conflict is None and [e.name for e in adapters["A"].entries] == ["la", "lb"] and adapters["B"].conflict == "rank"
    groups = {r.group: ([m.name for m in r.members], r.affinity) for r in C.prefetch_index(t, v).collect()}
    assert groups == {"g1": (["r", "e0u"], ["x", "y", "z"]), "g2": (["e1u"], [])}
    broken = tables(spark, [("a", "f32", [4], [], v1(0, prefetch__affinity="x"))])
    with pytest.raises(Exception, match="no prefetch.group"):
        C.prefetch_index(*broken).collect()
    tiers = tables(spark, [("a", "f32", [4], [], [(0, "canonical", "raw", 64, [("tier.intent", "vram"), ("tier.intent", "x"), ("tier.class", "")])])])[1]
    assert {r.rule for r in C.tier_violations(tiers).collect()} == {"duplicate tier.intent", "unknown tier.intent", "empty tier.class"}


def test_placement(spark):
    devices = spark.createDataFrame([(0, "cpu", "ram"), (1, "cuda", "vram"), (2, "wgpu", "nvme"), (2, "gpu", "x")], "id long, kind string, tier string")
    placements = spark.createDataFrame([(5, 1, [0, 1, 0]), (6, 9, [7]), (7, 2, None)], "shard_id long, primary_device long, replicas array<bigint>")
    shards = spark.createDataFrame([(5,), (6,)], "shard_id long")
    assert {(r.rule, r.subject, r.detail) for r in C.placement_violations(placements, devices, shards).collect()} == {
        ("duplicate device", "2", "2"), ("unknown shard", "7", None), ("unknown primary", "6", "9"), ("unknown replica", "6", "7"), ("unknown kind", "2", "gpu"), ("unknown tier", "2", "x")}
    assert {r.shard_id: r.devices for r in C.devices_of(placements).collect()} == {5: [1, 0], 6: [9, 7], 7: [2]} and C.device_union(placements) == [1, 0, 9, 7, 2]
    t = spark.createDataFrame([("a", 5), ("b", 6), ("c", 99), ("d", None)], "name string, shard_id long")
    assert {r.name: r.status for r in C.resolve_placement(t, placements, devices).collect()} == {"a": "ok", "b": "no device", "c": "no placement", "d": "no shard"}
    experts = spark.createDataFrame([(0, 5, 0, 10, "g"), (1, 5, 1, 20, "h"), (2, 6, 2, 30, "g"), (3, 6, 1, 40, "g")], "expert_id int, shard_id long, device_id long, bytes long, group string")
    steps = C.transfer_plan(experts, devices.limit(3))
    assert {r.expert_id: r.kind for r in steps.collect()} == {0: "none", 1: "host_to_device", 2: "unsupported", 3: "host_to_device"} and tuple(C.transfer_totals(steps).first()) == (60, 1)
    total = {r.device_id: (r.bytes, r.shards, r.experts, r.groups) for r in C.residency_totals(experts).collect()}
    assert total[1] == (60, [5, 6], [1, 3], ["g", "h"])
    s = spark.createDataFrame([(2, 4, 2), (3, 4, 2), (3, 1, 1)], "r int, a int, b int").select(C.adapter_status(F.col("r"), F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in s] == ["available", "partial", "logical_single_adapter"]


def test_state_dict(spark):
    e = spark.createDataFrame([("a", "f32", [2], True), ("b", "f32", [2], True), ("c", "f32", [2], False), ("d", "f32", [2], True)], "name string, dtype string, shape array<bigint>, required boolean")
    a = spark.createDataFrame([("a", "f16", [2]), ("d", "f32", [3]), ("x", "f32", [1])], "name string, dtype string, shape array<bigint>")
    issues = lambda s: {(r.issue, r.name) for r in C.state_dict_issues(e, a, s).collect()}
    assert issues(True) == {("dtype", "a"), ("shape", "d"), ("missing", "b"), ("unexpected", "x")} and issues(False) == issues(True) - {("unexpected", "x")}
    assert {r.name for r in C.missing_keys(e, a).collect()} == {"b", "c"} and [r.name for r in C.unexpected_keys(e, a).collect()] == ["x"]
    b = spark.createDataFrame([("t", "in1", "f32", [2]), ("u", "in2", "f16", [2]), ("w", "zz", "f32", [1])], "tensor string, input string, dtype string, shape array<bigint>")
    i = spark.createDataFrame([("in1", "f32", [2]), ("in2", "f32", [2])], "input string, dtype string, shape array<bigint>")
    assert {(r.tensor, r.issue) for r in C.binding_issues(b, i).collect()} == {("u", "dtype"), ("w", "undeclared")}


def test_layout_and_dedup(spark):
    r = random.Random(1)
    rows = [(f, k, r.randrange(0, 300), r.choice([1, 64, 256])) for f in range(5) for k in range(40)]
    got = {(x.file, x.ordinal): x.offset for x in C.aligned_layout(spark.createDataFrame(rows, "file int, ordinal int, length long, align int")).collect()}
    for f in range(5):
        end = 0
        for _, k, n, a in (x for x in rows if x[0] == f):
            end = -(-end // a) * a
            assert got[f, k] == end
            end += n
    p = spark.createDataFrame([("c", 0, "x", 4, 64), ("c", 1, "x", 4, 64), ("c", 2, "x", 4, 256), ("p", 3, "x", 4, 64), ("c", 4, "x", 5, 64)], "arena string, ordinal int, digest string, length int, align int")
    assert {x.ordinal: x.stored_at for x in C.dedup_payloads(p).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("grouped", [False, True])
def test_sharding(spark, grouped):
    r = random.Random(9)
    rows = [(m, f"t{k}", k, r.randrange(1, 50), r.choice([None, "a", "b", "c"])) for m in ("m1", "m2") for k in range(80)]
    got = {(x.model, x.name): x.shard_id for x in C.assign_shards(spark.createDataFrame(rows, "model string, name string, ordinal int, bytes long, group string"), 3, grouped).collect()}
    for m in ("m1", "m2"):
        own, loads, taken = [x for x in rows if x[0] == m], [0, 0, 0], {}
        for x in own if grouped else sorted(own, key=lambda x: -x[3]):
            k = loads.index(min(loads))
            if grouped and x[4] is not None:
                k = taken.setdefault(x[4], len(taken) % 3)
            loads[k] += x[3]
            assert got[m, x[1]] == k + 1
    m = spark.createDataFrame([(meta(moe__layer="1", moe__expert="2"),), (meta(moe__layer="1", moe__shared="1"),), (meta(moe__layer="1"),), (meta(a="b"),)], f"m {PAIRS}")
    assert [x[0] for x in m.select(C.expert_group(F.col("m"))).collect()] == ["layer=1;expert=2", "layer=1;shared=1", "layer=1;dense", None]


def test_tensor_parallel(spark):
    part = lambda n, e, i, c, axis, coll, shape: (n, "f32", shape, meta(moe__layer="0", moe__expert=str(e), moe__partition_index=str(i), moe__partition_count=str(c), moe__partition_axis=axis, moe__collective=coll), [(hash((n, i)) % 10**6, "canonical", "raw", 64, [])])
    t, _ = tables(spark, [
        part("a0", 0, 0, 2, "rows", "gather", [2, 8]), part("a1", 0, 1, 2, "rows", "gather", [3, 8]), part("b0", 1, 0, 2, "cols", "all_reduce_sum", [4, 4]), part("b1", 1, 0, 2, "cols", "all_reduce_sum", [4, 3]),
        part("c0", 2, 1, 3, "rows", "gather", [2, 8]), part("c1", 2, 2, 3, "cols", "gather", [2, 8]), part("d0", 3, 0, 1, "rows", "gather", [2, 8]),
    ])
    specs = C.partition_specs(t)
    issues = {}
    for r in C.partition_issues(specs, 8).collect():
        issues.setdefault(r.expert_id, set()).add(r.issue)
    assert 0 not in issues and 3 not in issues and issues[1] == {"duplicate index", "width"}
    assert {"count", "not contiguous", "axis or collective differs"} <= issues[2]
    assert {r.expert_id: r.status for r in C.parallel_plan(specs).collect()} == {0: "cpu_reference", 1: "unavailable", 2: "unavailable", 3: "not_required"}


def test_even_layout_is_the_aligned_layout_without_a_list(spark):
    r = random.Random(5)
    rows = [(f, k, r.randrange(0, 300)) for f in (1, 2) for k in r.sample(range(-100_000, 5 * C.SPAN), 300)]
    items = spark.createDataFrame(rows, "file int, ordinal int, length long")
    got = {(x.file, x.ordinal): x.offset for x in C.even_layout(items, 64).collect()}
    want, end = {}, {1: 0, 2: 0}
    for f, k, n in sorted(rows):
        want[f, k] = -(-end[f] // 64) * 64
        end[f] = want[f, k] + n
    assert got == want
    assert "collect_list" not in C.even_layout(items, 64)._jdf.queryExecution().toString()
