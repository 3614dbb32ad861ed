"""Vector functions on given inputs and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeria.functions import vectors as V


def one(spark, value, **columns):
    kinds = {list: "array<double>", int: "bigint", float: "double"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {'array<array<double>>' if isinstance(v, list) and v and isinstance(v[0], list) else kinds[type(v)]}" for c, v in columns.items()))
    return df.select(value).first()[0]


def test_given_values(spark):
    c = F.col
    assert one(spark, V.rms_norm(c("x"), c("w")), x=[3.0, 4.0], w=[1.0, 0.5]) == pytest.approx([0.8485281, 0.5656854], abs=1e-6)
    assert one(spark, V.matvec(c("m"), c("x")), m=[[3.0, 4.0], [5.0, 6.0]], x=[1.0, 2.0]) == [11, 17]
    assert one(spark, V.rope(c("x"), F.lit(1), 2), x=[1.0, 0.0]) == pytest.approx([np.cos(1), np.sin(1)])
    assert one(spark, V.argmax_last(V.repetition_penalty(c("x"), F.array(F.lit(0)), 2.0)), x=[10.0, 9.0]) == 1
    assert one(spark, V.argmax_last(c("x")), x=[1.0, 7.0, 7.0]) == 2 and one(spark, V.argmax_first(c("x")), x=[1.0, 7.0, 7.0]) == 1


def test_against_numpy(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=8), r.normal(size=8)
    c = F.col
    cases = [
        (V.dot(c("x"), c("y")), x @ y), (V.norm(c("x")), np.linalg.norm(x)), (V.add(c("x"), c("y")), x + y), (V.silu(c("x")), x / (1 + np.exp(-x))),
        (V.swiglu(c("x"), c("y")), x / (1 + np.exp(-x)) * y), (V.softmax(c("x") if True else None), np.exp(x - x.max()) / np.exp(x - x.max()).sum()), (V.temperature(c("x"), 2.0), x / 2),
    ]
    for got, want in cases:
        assert np.allclose(one(spark, got, x=x.tolist(), y=y.tolist()), want)
    big = one(spark, V.softmax(c("x")), x=[1000.0, 1000.0])
    assert big == [0.5, 0.5]
    with pytest.raises(Exception, match="arrays of 2 and 1"):
        one(spark, V.dot(c("x"), c("y")), x=[1.0, 2.0], y=[1.0])


def test_nucleus_and_draw(spark):
    c = F.col
    kept = one(spark, V.nucleus(c("x"), 0.7), x=[0.1, 0.5, 0.4])
    assert [k.id for k in kept] == [1, 2] and [k.p for k in kept] == pytest.approx([5 / 9, 4 / 9])
    assert [one(spark, V.draw(V.nucleus(c("x"), 0.7), F.lit(u)), x=[0.1, 0.5, 0.4]) for u in (0.0, 0.5555, 0.56, 1.0)] == [1, 1, 2, 2]
    assert [k.id for k in one(spark, V.top_k(c("x"), 2), x=[1.0, 3.0, 3.0])] == [1, 2]


def test_generator_against_integers(spark):
    def plain(seed, n):
        state, out = seed ^ V.SEED_MASK, []
        for _ in range(n):
            state ^= state >> 12
            state = (state ^ (state << 25)) & (1 << 64) - 1
            state ^= state >> 27
            out.append((state * V.MULTIPLIER % (1 << 64) >> 40) / (1 << 24))
        return out

    for seed in (0, 1, 42, 1 << 62, 123456789):
        assert one(spark, V.draws(F.col("s"), 6), s=seed) == plain(seed, 6)
