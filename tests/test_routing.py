"""Routed layers on given values and against numpy."""

import numpy as np
import pytest

from plumeria.operators import routing as R


def matrix(e, role, m):
    return [(e, role, k, [float(x) for x in row]) for k, row in enumerate(m)]


@pytest.fixture(scope="module")
def small(spark):
    one = np.eye(2)
    tokens = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate([(2, 1), (1, 3), (4, 0), (0, 5)])], "token int, x array<double>")
    router = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "expert int, weights array<double>")
    experts = spark.createDataFrame(matrix(0, "up", one) + matrix(0, "down", one) + matrix(1, "up", 2 * one) + matrix(1, "down", one), "expert int, role string, row int, weights array<double>")
    return tokens, router, experts


def result(df):
    return {r.token: r.y for r in df.collect()}


def test_given_layers(spark, small):
    assert result(R.moe_layer(*small)) == {0: [2, 1], 1: [2, 6], 2: [4, 0], 3: [0, 10]}
    assert result(R.moe_layer(*small, k=2, softmax=False)) == {0: [6, 3], 1: [3, 9], 2: [12, 0], 3: [0, 15]}
    routes = R.route(*small[:2])
    assert [(r.expert, [t.token for t in r.tokens]) for r in R.batches(routes).orderBy("first").collect()] == [(0, [0, 2]), (1, [1, 3])]
    placed = spark.createDataFrame([(0, 5), (1, 5)], "expert int, device_id int")
    assert [(r.device_id, r.experts, r.n) for r in R.device_batches(routes, placed).collect()] == [(5, [0, 1], 4)]
    assert R.batch_rows(routes, 1).count() == 4


def test_routes(spark):
    tokens = spark.createDataFrame([(0, [1000.0]), (1, [float("nan")])], "token int, x array<double>")
    router = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [0.999])], "expert int, weights array<double>")
    got = {(r.token, r.place): (r.expert, r.weight) for r in R.route(tokens, router, 3).collect()}
    w = np.exp(np.array([0, 0, -1.0]))
    assert [got[0, k][0] for k in range(3)] == [1, 3, 2] and np.allclose([got[0, k][1] for k in range(3)], w / w.sum()) and got[1, 0][0] == 1


def test_gated_experts_against_numpy(spark):
    r = np.random.default_rng(2)
    x, gate = r.normal(size=(6, 3)), r.normal(size=(2, 3))
    nets = {e: {k: r.normal(size=s) for k, s in (("up", (4, 3)), ("gate", (4, 3)), ("down", (3, 4)))} for e in range(2)}
    rows = [m for e in nets for k, v in nets[e].items() for m in matrix(e, k, v)]
    got = result(R.moe_layer(
        spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "token int, x array<double>"), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(gate)], "expert int, weights array<double>"),
        spark.createDataFrame(rows, "expert int, role string, row int, weights array<double>"), 2))
    for k, v in enumerate(x):
        s = gate @ v
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        y = sum(w[e] * n["down"] @ ((g := n["gate"] @ v) / (1 + np.exp(-g)) * (n["up"] @ v)) for e, n in nets.items())
        assert np.allclose(got[k], y)


def test_collectives(spark):
    p = spark.createDataFrame([(0, 1, [4.0, 5.0, 6.0]), (0, 0, [1.0, 2.0, 3.0])], "row int, part int, y array<double>")
    assert R.collective(p, "all_reduce_sum", 3).first().y == [5, 7, 9] and R.collective(p, "gather", 6).first().y == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="elements expected"):
        R.collective(p, "gather", 5).collect()
    with pytest.raises(Exception, match="different lengths"):
        R.all_reduce(p.unionByName(spark.createDataFrame([(0, 2, [1.0])], p.schema))).collect()
    q = spark.createDataFrame([(0, "a", 0, [1, 2]), (0, "b", 1, [3])], "batch int, request string, place int, rows array<int>")
    whole = R.merge_batch(q)
    assert whole.first()["rows"] == [1, 2, 3]
    assert {r.request: r["rows"] for r in R.split_batch(whole, q.selectExpr("batch", "request", "place", "size(rows) n")).collect()} == {"a": [1, 2], "b": [3]}


def test_differences(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "token int, y array<double>")
    b = spark.createDataFrame([(0, [1.0, 2.5]), (1, [1.0])], "token int, y array<double>")
    d = R.max_abs_diff(a, b)
    assert tuple(d.first()) == (2, 0.5, False) and tuple(R.max_abs_diff(a, a).first()) == (2, 0.0, True) and not R.max_abs_diff(a, b.limit(0)).first().within


def test_attention(spark):
    rows = [(0, p, h, [1.0], [0.0] if h < 1 else None, [2.0 + 2 * p] if h < 1 else None) for p in range(2) for h in range(2)]
    df = spark.createDataFrame(rows, "seq int, pos int, head int, q array<double>, k array<double>, v array<double>")
    assert {(r.pos, r.head): r.y for r in R.causal_attention(df, groups=2).collect()} == {(0, 0): [2], (1, 0): [3], (0, 1): [2], (1, 1): [3]}
