"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest

import plumeria.plans.all_queries  # noqa: F401
from plumeria.plans import by_operators
from plumeria.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].astype(float).round(9) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, want = norm(QUERIES[name](spark, SF).toPandas()), norm(duck.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.astype(want.dtypes.to_dict()).astype(str).equals(want.astype(str))


def differs(spark, duck, path, name, vectors):
    """What a query over embeddings (vec_id, label, embedding) gives otherwise than its SQL."""
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    c = duck.cursor()
    c.execute(f"create temp view embeddings as select * from read_parquet('{path}/embeddings.parquet/*.parquet')")
    got, want = norm(QUERIES[name](spark, str(path)).toPandas()), norm(c.execute(ORACLE[name]).df())
    assert len(got) == len(want) == len(vectors)
    return (got.astype(want.dtypes.to_dict()).astype(str) != want.astype(str)).sum().sum()


def test_draw_between_six_digits_and_the_exact_number(spark, duck, tmp_path):
    # of two tokens, the likelier one's probability is 60/101 plus or minus 2e-7: a threshold of six digits (0.594059) is below both
    gap = lambda p: np.float32(np.log(p / (1 - p)))
    k = next(k for k in range(101) if k * 37 % 101 == 60)
    vectors = [(k + 101 * j, 0, [0.0, -float(gap(60 / 101 + (j - 4) * 1e-7))]) for j in range(9)]
    assert differs(spark, duck, tmp_path, "inverse_cdf_draw", vectors) == 0


@pytest.mark.parametrize("name", ["q3_k_payloads", "q3_k_roundtrip_error"])
def test_codes_next_to_a_half(spark, duck, tmp_path, name):
    below = float(np.nextafter(np.float32(0.125), np.float32(0)))
    assert differs(spark, duck, tmp_path, name, [(1, 0, [1.0, below, -below] + [0.0] * 61), (2, 0, [-1.0, 0.125, below] + [0.25] * 61)]) == 0


def star(spark, duck, path, **tables):
    """A cursor of DuckDB over tables written to a folder; the others are those of sf0.001."""
    c = duck.cursor()
    for name in ("nation", "region", "supplier", "part", "lineitem"):
        if name in tables:
            tables[name].write.parquet(f"{path}/{name}.parquet")
            c.execute(f"create temp view {name} as select * from read_parquet('{path}/{name}.parquet/*.parquet')")
        else:
            os.symlink(f"{SF}/{name}.parquet", f"{path}/{name}.parquet")
    return c


def exchanges(df):
    """The partition counts of the shuffles by a key in a query's plan."""
    return [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def test_residency_of_equal_names_and_missing_keys(spark, duck, tmp_path, monkeypatch):
    nation = [(0, "A", 0), (1, "A", 0), (2, None, 0), (3, "B", 1), (3, "B", 1)]
    lines = [(p, s, float(q)) for p, s, q in [(1, 1, 5), (1, 1, 6), (1, 2, 7), (2, 2, 1), (2, 3, 1), (3, 3, 2), (3, 4, 9), (4, 5, 9)]] + [(None, 1, 3.0), (5, None, 3.0), (6, 1, None)]
    c = star(
        spark, duck, tmp_path, nation=spark.createDataFrame(nation, "n_nationkey int, n_name string, n_regionkey int"),
        supplier=spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 9)], "s_suppkey long, s_nationkey int"),
        lineitem=spark.createDataFrame([(p, s, 1, q) for p, s, q in lines], "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
    )
    monkeypatch.setattr(by_operators, "SPREAD", 1)
    got, want = QUERIES["residency_totals"](spark, str(tmp_path)), norm(c.execute(ORACLE["residency_totals"]).df())
    assert norm(got.toPandas()).astype(str).equals(want.astype(str)) and len(want) == 3
    assert exchanges(got).count(len(lines)) >= 2, "the large shuffles have partitions by the table's rows"


PAIRS = [(p, s, n) for p in range(1, 41) for n, s in enumerate((p, p + 7, 3 * p + 1, 5 * p + 2, p), 1)]


def pairs_of(spark):
    return spark.createDataFrame(PAIRS, "l_partkey long, l_suppkey long, l_linenumber int")


def spread_result(spark, duck, path, monkeypatch, name):
    """A query over a catalog with repeated lines gives its SQL's rows; the partition counts of its shuffles."""
    c = star(spark, duck, path, lineitem=pairs_of(spark))
    monkeypatch.setattr(by_operators, "SPREAD", 4)
    got = QUERIES[name](spark, str(path))
    plan = exchanges(got)
    got, want = norm(got.toPandas()), norm(c.execute(ORACLE[name]).df())
    assert got.astype(want.dtypes.to_dict()).astype(str).equals(want.astype(str)) and len(want) >= 40
    return plan


def test_variant_targets_from_one_join(spark, duck, tmp_path, monkeypatch):
    # one shuffle of the table for either side, two of the join, one by name, all with partitions by the table's rows
    assert spread_result(spark, duck, tmp_path, monkeypatch, "variant_targets") == [len(PAIRS) // 4] * 5


def test_modes_from_one_join(spark, duck, tmp_path, monkeypatch):
    # three modes take no more shuffles than one
    assert spread_result(spark, duck, tmp_path, monkeypatch, "select_variants_modes") == [len(PAIRS) // 4] * 5


@pytest.mark.parametrize("name", ["causal_attention_heads", "gqa_attention_tokens"])
def test_attention_of_odd_vectors_in_one_shuffle(spark, duck, tmp_path, name):
    # cut, empty, null, wide and repeated vectors, null elements, a whole head of nulls, and gaps between tokens
    vector = lambda k, n: [((k * 7 + i * 5) % 23 - 11) / 7 for i in range(n)]
    rows = [(k, 0, vector(k, 64)) for k in (0, 1, 3, 15, 16, 40)] + [(2, 0, vector(2, 60)), (4, 0, vector(4, 3)), (5, 0, []), (6, 0, None), (7, 0, vector(7, 128)), (3, 0, vector(9, 64)), (3, 0, vector(5, 20))]
    rows += [(8, 0, [None] * 8 + vector(8, 56)), (9, 0, vector(8, 5) + [None, 1.0, None] + vector(3, 56)), (33, 0, [None] * 10), (None, 0, vector(1, 64))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duck.cursor()
    c.execute(f"create temp view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    assert len(exchanges(df)) == 1
    got, want = (sorted(map(repr, x)) for x in ([tuple(r[c] for c in ("seq", "pos", "head", "i", "y")) for r in df.collect()], c.execute(f"select seq, pos, head, i, y from ({ORACLE[name]})").fetchall()))
    assert [r.replace("-0.0)", "0.0)") for r in got] == [r.replace("-0.0)", "0.0)") for r in want] and len(want) > 700
