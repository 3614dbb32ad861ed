"""The whole forms of cut queries against plain computations on the tables, not against their own SQL."""

import os

import numpy as np
import pytest

import plumeria.plans.all_queries  # noqa: F401
from plumeria.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_whole_prefixes(spark, tmp_path):
    items = [(5, "alpha beta gamma delta"), (3, "alpha beta gamma"), (9, "alpha beta gamma delta"), (7, "zé"), (8, ""), (10, None)]
    docs = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gXX"), (3, "alpha beta gamma"), (4, "zéro"), (5, "none"), (6, ""), (7, None), (8, "alpha beta gamma dX")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = {tuple(r) for r in QUERIES["prefix_longest_match_whole"](spark, str(tmp_path)).collect()}
    assert got == {(1, 22, 5), (2, 12, 3), (3, 16, 3), (4, 2, 7), (8, 18, 5)}


def test_all_documents_are_validated(spark):
    want, have = dict(rows(spark, "labels", "doc_id", "quality")), dict(rows(spark, "documents", "doc_id", "n_chars"))
    issue = lambda k: "missing" if k not in have else "unexpected" if k not in want else "ok" if want[k] == (have[k] > 100) else "differs"
    assert dict(map(tuple, QUERIES["state_dict_validate_all"](spark, SF).collect())) == {k: issue(k) for k in want.keys() | have.keys()}


def test_all_keys_are_compared(spark):
    orders, items = ({x for (x,) in rows(spark, t, c)} for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    got = sorted(map(tuple, QUERIES["unexpected_keys_all"](spark, SF).collect()))
    assert got == sorted([("childless", k) for k in orders - items] + [("orphan", k) for k in items - orders])


def test_all_nations_are_resolved(spark):
    nation = {k: (n, r) for k, n, r in rows(spark, "nation", "n_nationkey", "n_name", "n_regionkey")}
    home, region = dict(rows(spark, "supplier", "s_suppkey", "s_nationkey")), dict(rows(spark, "region", "r_regionkey", "r_name"))
    got = {(r.tensor, r.shard): (r.device, r.tier, r.status) for r in QUERIES["placement_resolve_all"](spark, SF).collect()}
    assert got == {(p, s): (nation[home[s]][0], region[nation[home[s]][1]], "ok") for p, s in rows(spark, "lineitem", "l_partkey", "l_suppkey")}


@pytest.mark.parametrize("name,shared", [("causal_attention_heads", 1), ("gqa_attention_tokens", 4)])
def test_attention_of_all_heads_and_tokens(spark, name, shared):
    e = {k: np.array(v, np.float64).reshape(8, 8) for k, v in rows(spark, "embeddings", "vec_id", "embedding")}
    got = {(r.seq * 16 + r.pos, r.head, r.i): r.y for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == 64 * len(e)
    for k, q in e.items():
        keys = [e[j] for j in range(k - k % 16, k + 1)]
        for h in range(8):
            s = np.array([q[h] @ x[h // shared] for x in keys]) / np.sqrt(8)
            a = np.exp(s - s.max())
            y = a / a.sum() @ np.array([x[h // shared] for x in keys])
            assert np.allclose([got[k, h, i] for i in range(8)], y, atol=2e-5)
