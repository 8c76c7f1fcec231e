"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import queries, topk
from tests.llm.helpers import clashing
from tests.oracle import DATA, connection, same

KIND = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=10):
    q = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in e])
    out = set()
    for i, vs in q.items():
        if i % 100:
            continue
        for v in {tuple(x) for x in vs}:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, ws in q.items() if j != i for w in ws if len(w) == len(v))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def found(df, **how):
    return {tuple(r) for r in topk.top_k(df, **how).collect()}


@pytest.mark.parametrize(("scale", "k", "dim"), [(1, 10, 6), (5, 3, 6), (1, 10, 1), (1e5, 4, 5), (0.01, 10, 8)])
def test_random_vectors(spark, scale, k, dim):
    rng = np.random.default_rng(int(scale * 10) + k)
    rows = [(i * 10, [float(x) for x in rng.normal(size=dim) * scale * rng.choice([0.1, 1, 3])], 0) for i in range(300)]
    rows += [(5, None, 0), (7, [None] * dim, 0), (8, [float("nan")] * dim, 0), (9, [float("inf")] * dim, 0), (None, [1.0] * dim, 0), (200, [0.5] * dim, 0), (11, [0.0] * dim, 0), (300, [0.0] * dim, 0), (12, [1.0] * (dim + 1), 0)]
    df = clashing(spark.createDataFrame(rows, KIND))
    rows = [(i, e and [x if x is None else float(np.float32(x)) for x in e]) for i, e, _ in rows]
    assert found(df, k=k, block_numbers=64 * dim, query_numbers=8 * dim) == brute(rows, k)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0], 0) for i in (0, 9, 3, 5, 7, 1)]
    assert found(spark.createDataFrame(rows, KIND), k=3) == {(0, 1, 1, 1048576), (0, 2, 3, 1048576), (0, 3, 5, 1048576)}


def test_few_rows_and_none(spark):
    empty = spark.createDataFrame([], KIND)
    assert found(empty) == set()
    assert found(spark.createDataFrame([(100, [1.0], 0)], KIND)) == set()
    assert found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], KIND)) == set()
    assert len(found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], KIND), query=F.col("vec_id") == 1)) == 1


def test_very_large_components_stay_exact():
    rng = random.Random(1)
    v = np.array([[rng.randrange(-(2**40), 2**40) for _ in range(4)] for _ in range(60)], dtype=np.int64)
    got, _ = topk.search_block(v, np.arange(60), v[:5], np.arange(5), 7, bucket=16)
    for i, best in enumerate(got):
        want = sorted(((-sum(int(a) * int(b) for a, b in zip(v[i], w)), j) for j, w in enumerate(v) if j != i))[:7]
        assert [(-int(s), int(j)) for s, j in zip(best.score, best.id)] == want


def test_both_prunings_lose_nothing():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 16))
    v = np.floor(1000 * (centre[rng.integers(0, 5, 800)] + 0.05 * rng.normal(size=(800, 16))) * rng.choice([0.2, 1, 1.1], 800)[:, None]).astype(np.int64)
    got, _ = topk.search_block(v, np.arange(800), v[::40], np.arange(0, 800, 40), 10, bucket=32)
    exact = v[::40] @ v.T
    for row, best in enumerate(got):
        want = sorted((-int(s), j) for j, s in enumerate(exact[row]) if j != 40 * row)[:10]
        assert [(-int(s), int(j)) for s, j in zip(best.score, best.id)] == want


def test_short_blocks_are_not_sent(spark, monkeypatch):
    # lengths differ widely: bounds from the longest block rule most others out, and nothing is lost
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * np.exp(1.5 * rng.normal())], 0) for i in range(1200)]
    sent = []
    written = topk.table
    monkeypatch.setattr(topk, "table", lambda df, name: (sent.append(written(df, name)), sent[-1])[1] if name == "pairs" else written(df, name))
    assert found(spark.createDataFrame(rows, KIND), block_numbers=64 * 8) == brute([r[:2] for r in rows])
    blocks, asked = -(-1200 // 64), 12
    assert 0 < sent[0].count() < 0.7 * asked * (blocks - 1)


def test_bounds_spare_products():
    rng = np.random.default_rng(4)
    v = np.floor(100 * rng.normal(size=(2000, 12)) * np.exp(rng.normal(size=2000))[:, None]).astype(np.int64)
    ids, q, own = np.arange(2000), v[:20], np.arange(20)
    whole, most = topk.search_block(v, ids, q, own, 5)
    bounds = np.array([float(b.score[-1]) for b in whole])
    again, fewer = topk.search_block(v, ids, q, own, 5, bounds)
    assert [(b.score.tolist(), b.id.tolist()) for b in whole] == [(b.score.tolist(), b.id.tolist()) for b in again]
    assert fewer < most < 20 * 2000


def test_query_matches_sql(spark):
    same(queries.op4_top_k(spark, DATA), connection(), queries.OP4_SQL)
