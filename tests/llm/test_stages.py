"""Stages that drop rows judge rows, not ids; the classifier, the shards and the tilings against plain versions."""

from __future__ import annotations

import struct
import time

import numpy as np
import pytest
import xxhash
from test_llm import brute_leaks

from scanfuse.llm import decontaminate, exact_dedup, quality, sharding, simhash

SHAPE = "doc_id long, text string, row_number string, fp int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, f"x{k}", k) for k, r in enumerate(rows)], SHAPE)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_copies_that_share_or_lack_an_id(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "x"), (2, "alpha  beta"), (None, "x"), (None, "x"), (None, "only one"), (3, None), (4, "")]
    got = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "row_number", "fp"]
    assert left(got) == sorted([(2, "alpha  beta"), (2, "x"), (None, "only one"), (3, None)], key=str)


def test_near_copies_that_share_or_lack_an_id(spark):
    long = " ".join(f"word{k}" for k in range(400))
    rows = [(5, long), (5, long + " end"), (5, "something else entirely here"), (None, long), (None, "quite another text than these are"), (7, None), (8, " ")]
    got = left(simhash.drop_near_copies(frame(spark, rows)))
    assert len(got) == 4 and sum(t is not None and t.startswith("word0") for _, t in got) == 1
    assert (5, "something else entirely here") in got and (None, "quite another text than these are") in got and (7, None) in got
    assert simhash.drop_near_copies(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_leaks_of_rows_that_share_or_lack_an_id(spark, size):
    item = "one two three four five six seven eight"
    rows = [(1, item), (1, "clean text"), (None, "so " + item), (None, "clean too"), (2, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.drop_contaminated(frame(spark, rows), bench, index_bytes=size)
    assert left(got) == sorted([(1, "clean text"), (None, "clean too"), (2, None)], key=str)
    assert decontaminate.drop_contaminated(frame(spark, rows), bench.limit(0), index_bytes=size).count() == 5


def test_low_quality_of_rows_that_share_or_lack_an_id(spark):
    good, bad = "A calm sentence with plain words in it. " * 20, "#$%^ &*( @@@ 0x!! ~~~ " * 20
    rows = [(k, good if k % 2 else bad) for k in range(200)] + [(1, bad), (None, good), (None, bad), (2, good)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id long, quality int")
    got = left(quality.drop_low_quality(frame(spark, rows), labels))
    assert len(got) == 102 and all(t == good for _, t in got) and (2, good) in got and (None, good) in got


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_the_clipped_risk_is_minimal(spark, prior):
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.3
    x = rng.normal(0, 1, (600, 2)) + np.where(y[:, None], 0.8, -0.4)
    p = y & (rng.random(600) < 0.5)
    model = quality.fit(spark.createDataFrame([(v.tolist(), bool(q)) for v, q in zip(x, p)], "x array<double>, positive boolean"), prior)
    a = quality._design(x, model.mean, model.scale)
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w):
        z = a @ w
        negatives = loss(-z).mean() - prior * loss(-z[p]).mean()
        return prior * loss(z[p]).mean() + max(0.0, negatives) + 0.5e-2 * (w[:2] ** 2).sum(), negatives

    # the plain way: subgradient steps that shrink
    w, best = np.zeros(3), np.inf
    for k in range(20_000):
        z = a @ w
        s = 1 / (1 + np.exp(-z))
        g = prior * ((s[p] - 1) @ a[p]) / p.sum() + 1e-2 * np.r_[w[:2], 0]
        if risk(w)[1] > 0:
            g = g + s @ a / len(a) - prior * (s[p] @ a[p]) / p.sum()
        w = w - 2 / np.sqrt(k + 1) * g
        best = min(best, risk(w)[0])
    mine, _ = risk(model.weights)
    assert mine <= best + 1e-3


def plain_place(key: int, leaves, capacity=(8, 4, 5), top=1.0) -> int:
    """The descent the plain way, a key at a time, with Spark's XXH64 of the key."""
    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    tree = {}
    for region, rack, shard, weight in leaves:
        tree.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
    tree = [list(racks.values()) for racks in tree.values()]
    hashed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for n in range(100_000):
        h, node = mixed(hashed ^ mixed(n)), tree
        for width in capacity:
            k = (h >> 32) * width >> 32
            h = mixed(h ^ k)
            node = node[k] if node is not None and k < len(node) else None
        if node is not None and (h >> 11) / 2**53 < node[1] / top:
            return node[0]


def test_shards_equal_the_plain_version_and_grow_by_one(spark):
    from pyspark.sql import functions as F

    keys = spark.range(-300, 700)
    got = {r["id"]: r["s"] for r in keys.select("id", sharding.place(F.col("id"), sharding.layout(40)).alias("s")).collect()}
    assert got == {k: plain_place(k, sharding.layout(40)) for k in range(-300, 700)}
    hashed = keys.select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy().view(np.uint64)
    before = None
    for n in range(1, 161):  # up to the tree's capacity
        weights, shards = np.zeros((8, 4, 5)), np.arange(160).reshape(8, 4, 5)
        weights.reshape(-1)[:n] = 1
        now = sharding.descend(hashed, weights, shards)
        assert before is None or np.all((now == before) | (now == n - 1))
        before = now
    at = [sharding.place(F.col("id"), sharding.layout(n)).alias(f"n{n}") for n in (7, 8, 40, 41, 100, 101)]
    for r in keys.select(*at).collect():
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for n in (7, 40, 100))
    docs = keys.select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old = {r["doc_id"]: r for r in sharding.shard_documents(docs, 23).collect()}
    assert all(r["shard"] == old[r["doc_id"]]["grown_shard"] for r in sharding.shard_documents(docs, 24).collect())
    with pytest.raises(ValueError, match="fit"):
        sharding.place(F.col("id"), sharding.layout(161))


def test_the_tree_decides(spark):
    """The same shards in other racks take other keys; each gets its share; a changed weight moves keys only into or out of its shard."""
    from pyspark.sql import functions as F

    keys = spark.range(20_000)
    flat = [(f"region{s % 8}", f"rack{s % 8}-{s // 8 % 4}", s, 1.0) for s in range(40)]
    heavy = [(r, k, s, 3.0 if s == 7 else w) for r, k, s, w in sharding.layout(40)]
    at = {"a": (sharding.layout(40), 1.0), "b": (flat, 1.0), "c": (sharding.layout(40), 4.0), "d": (heavy, 4.0)}
    df = keys.select(*(sharding.place(F.col("id"), leaves, top=top).alias(k) for k, (leaves, top) in at.items())).toPandas()
    assert (df["a"] != df["b"]).mean() > 0.9
    assert all(df[k].value_counts().reindex(range(40)).between(380, 620).all() for k in "abc")
    moved = df[df["c"] != df["d"]]
    assert len(moved) and (moved["d"] == 7).all() and 1250 < (df["d"] == 7).sum() < 1600


def test_tiles_of_texts_that_repeat_themselves():
    start = time.time()
    assert decontaminate.tiles(np.ones(10_000, np.int64), np.ones(1_000, np.int64), 5) == [(0, 0, 1_000)]
    assert time.time() - start < 1
    rng = np.random.default_rng(8)
    for _ in range(60):
        item = np.concatenate([rng.integers(1, 4, rng.integers(1, 6))] * int(rng.integers(1, 6)))
        doc = np.concatenate([item[rng.integers(0, len(item)) :], rng.integers(1, 4, rng.integers(0, 30)), item[: rng.integers(0, len(item))]])
        assert sum(n for _, _, n in decontaminate.tiles(doc, item, 3)) == brute_leaks(list(doc), list(item), 3)
    ids = rng.integers(0, 9, 50)
    for width in (1, 2, 3, 5, 7, 8, 13, 50):
        h = decontaminate.rolling(ids, width)
        want = [sum(int(t) * int(decontaminate._BASE) ** (width - 1 - k) for k, t in enumerate(ids[a : a + width])) % 2**64 for a in range(51 - width)]
        assert h.tolist() == want


def test_both_ways_of_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 12, n)]
    items = [(k, words(rng.integers(1, 30))) for k in range(12)]
    docs = []
    for k in range(40):
        item = items[rng.integers(0, 12)][1]
        cut = rng.integers(0, len(item))
        docs.append((k, words(rng.integers(0, 20)) + item[cut:] + words(rng.integers(0, 10)) + item[:cut]))
    want = {}
    for d, doc in docs:
        for i, item in items:
            share = brute_leaks(doc, item, 5) / len(item)
            if share >= 0.6:
                want[d, i] = round(share, 9)
    make = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    for size in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in decontaminate.leaks(make(docs, "doc_id"), make(items, "item_id"), index_bytes=size).collect()}
        assert got == want


def test_leaks_of_rows_that_share_or_lack_an_id(spark):
    """A benchmark of any size gives the same rows, null ids and repeated ids on both sides included."""
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, item), (1, item), (1, "zzz " + item), (2, "quite another text of some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, item), (7, item + " eleven")], "item_id long, text string")
    found = [sorted(map(str, decontaminate.leaks(docs, bench, **how).select("doc_id", "item_id", "coverage").collect())) for how in ({}, {"index_bytes": 0})]
    assert found[0] == found[1] and len(found[0]) == 9
