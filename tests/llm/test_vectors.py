"""Hard negatives and exact top-k against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows_of

from scanfuse.llm import hard_negatives, topk, vectors
from scanfuse.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int, row string, block int, v int"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_topk"])
def test_oracle(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows_of(got) == rows_of(want)


def made(n, seed, width=8):
    """Vectors with copies, ties, gaps, zeros, other lengths, repeated and null ids."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.3, 0.5]) for _ in range(width)]
        v = [0.25] * width if k % 3 == 0 else v[: width - 2] if k % 17 == 0 else [] if k % 29 == 0 else [*v[:2], None] if k % 23 == 0 else [*v[:2], math.nan] if k % 31 == 0 else [math.inf, *v] if k % 37 == 0 else v
        rows.append((None if k % 41 == 0 and k else k % 190 + 10 * (k % 2), None if k % 43 == 0 else v, None if k % 13 == 0 else rng.randint(0, 3), "x", 1, 2))
    return rows


def valid(rows, scale, labelled):
    keep = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and (r[2] is not None or not labelled)]
    width = max((len(r[1]) for r in keep), default=0)
    return [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in keep]


def by_id(i):
    return (i is None, i or 0)


def brute_top(rows, k, scale, every):
    rows, out = valid(rows, scale, False), []
    for a, (q, x, _) in enumerate(rows):
        if q is not None and q % every == 0:
            best = sorted(((-sum(map(int.__mul__, x, y)), by_id(i), i) for b, (i, y, _) in enumerate(rows) if b != a), key=lambda t: t[:2])[:k]
            out += [(q, nr + 1, i, -s) for nr, (s, _, i) in enumerate(best)]
    return sorted(out, key=str)


def brute_negatives(rows, scale, every):
    rows, out = valid(rows, scale, True), []
    for a, (q, x, label) in enumerate(rows):
        if q is not None and q % every == 0:
            s = sorted(((-sum(map(int.__mul__, x, y)), by_id(i), b) for b, (i, y, _) in enumerate(rows) if b != a), key=lambda t: t)
            for p, _, b in [t for t in s if rows[t[2]][2] == label][:5]:
                near = [t for t in s if rows[t[2]][2] != label and -80 * p <= -100 * t[0] <= -100 * p][:5]
                out += [(q, rows[b][0], nr + 1, rows[t[2]][0], -p, -t[0]) for nr, t in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [64, 1 << 16])
def test_top_k(spark, block_rows):
    rows = made(400, 1)
    got = topk.top_k(vectors.quantised(spark.createDataFrame(rows, SHAPE), 1024, "vectors"), vectors.is_query(20), 7, block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 7, 1024, 20)


def test_top_k_of_few_or_no_rows(spark):
    few = [(0, [1.0, 2.0], 1, "", 0, 0), (100, [0.5, -1.0], 1, "", 0, 0), (7, [], 1, "", 0, 0)]
    run = lambda rows: sorted(map(tuple, topk.top_k(vectors.quantised(spark.createDataFrame(rows, SHAPE), 1024, "vectors"), vectors.is_query(100)).collect()))
    assert run(few) == sorted(brute_top(few, 10, 1024, 100)) and len(run(few)) == 4
    assert run(few[:1]) == [] and run([]) == []


def test_bit_slices_choose_as_products_do():
    rng = np.random.default_rng(3)
    values = rng.integers(-3000, 3000, (700, 24))
    values[100:400] = values[0]
    index, ids = topk.BitSlices(values), rng.permutation(700)
    for q in [*rng.integers(-3000, 3000, (15, 24)), np.zeros(24, np.int64), values[0]]:
        s = values @ q
        want = np.lexsort((ids, -s))
        want = want[want != 5][:9]
        found, scores = index.top(q, 9, ids, np.array([5]))
        assert found.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_components_of_any_size_or_an_error(spark):
    rows = [(0, [1e5, -1e5], 0, "", 0, 0), (1, [1.2e5, 3.0], 0, "", 0, 0), (2, [-1e5, 1e5], 1, "", 0, 0), (3, [9e4, 1.0], 1, "", 0, 0)]
    df = spark.createDataFrame(rows, SHAPE)
    assert sorted(map(tuple, topk.top_k(vectors.quantised(df, 1024, "vectors"), vectors.is_query(100)).collect()), key=str) == brute_top(rows, 10, 1024, 100)
    with pytest.raises(Exception, match="too large"):
        vectors.quantised(spark.createDataFrame([(0, [1e30], 0, "", 0, 0)], SHAPE), 1024, "vectors")


@pytest.mark.parametrize("how", [{}, {"ways": 4, "chunk_rows": 40}])
def test_hard_negatives(spark, how):
    rows = made(500, 2)
    at = vectors.quantised(spark.createDataFrame(rows, SHAPE).where("label IS NOT NULL"), 256, "vectors", label=vectors.F.col("label"))
    got = hard_negatives.mine_hard_negatives(at, at.where(vectors.is_query(20)), **how)
    got, want = sorted(map(tuple, got.collect()), key=str), brute_negatives(rows, 256, 20)
    assert got == want and got


def test_hard_negatives_of_no_rows(spark):
    at = vectors.quantised(spark.createDataFrame([], SHAPE), 256, "vectors", label=vectors.F.col("label"))
    assert hard_negatives.mine_hard_negatives(at, at).collect() == []


def test_tree_rules_out_what_no_window_meets():
    """Clusters far apart: most leaves are never scored, and what is found is what all leaves hold."""
    rng = np.random.default_rng(4)
    v = (rng.integers(-1000, 1000, (12, 6)).repeat(200, axis=0) + rng.integers(-5, 5, (2400, 6))).astype(np.int64)
    n = len(v)
    tree = hard_negatives.Tree(v, np.arange(n), np.arange(n), np.zeros(n, np.int32), leaf=50)
    scored = []
    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1 and at.dtype == np.int64:
                scored.append(len(at))
            return super().__getitem__(at)
    ids = tree.vec_id
    tree.vec_id = ids.view(Counting)
    q = v[:1]
    s = (v @ v[0]).astype(int)
    top = int(np.sort(s)[-20])
    found = tree.search(q, np.array([0]), np.zeros(1, np.int32), np.array([True]), np.array([top - 1000]), np.array([top]), 5, np.array([hard_negatives.LOWEST]), np.array([(1 << 63) - 1]))[0]
    want = sorted((-int(s[j]), j, j) for j in range(1, n) if top - 1000 <= s[j] <= top)[:5]
    assert found == want and sum(scored) < n / 2
