"""Line dedup against a plain version, its two ways, and documents that share an id."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from scanfuse.llm import line_dedup

DOC = "doc_id long, text string"


def plain(rows: list[tuple[int | None, str | None]]) -> dict[tuple[int | None, str], list[int]]:
    """Numbers of the lines that go, for each (doc_id, text). Documents of one id must differ in no line that ties."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen: dict[str, list] = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line := " ".join(line.lower().split()):
                seen.setdefault(line, []).append((i, text, k))
    lines = list(seen)
    sets = [frozenset(x[k : k + 6] for k in range(max(1, len(x) - 5))) for x in lines]
    root = list(range(len(lines)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            n, m = sorted((len(sets[a]), len(sets[b])))
            if n >= 0.8 * m and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    at = {r: k for k, r in enumerate(rows)}
    groups: dict[int, list] = {}
    for k, x in enumerate(lines):
        groups.setdefault(find(k), []).extend(seen[x])
    gone: dict[tuple, list[int]] = {}
    for places in groups.values():
        for i, text, k in sorted(places, key=lambda p: (at[p[:2]], p[2]))[1:]:
            gone.setdefault((i, text), []).append(k)
    return {key: sorted(v) for key, v in gone.items()}


def corpus(n: int, seed: int) -> list[tuple[int | None, str | None]]:
    """Lines of templates with small edits, so that classes are large, and a bucket holds more lines than one block."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    templates = [[word() for _ in range(rng.integers(4, 25))] for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(None, "only here, quite alone\n" + " ".join(templates[0])), (None, None), (10**6, "")]
    for i in range(n):
        lines = []
        for _ in range(rng.integers(1, 6)):
            t = list(templates[rng.integers(0, 12)])
            for k in rng.integers(0, len(t), rng.integers(0, 3)):
                t[k] = word()
            lines.append(("  " if rng.random() < 0.2 else "") + " ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
        rows.append((i, "\n".join(lines)))
    return rows


def found(df) -> dict[tuple[int | None, str], list[int]]:
    return {(r["doc_id"], r["text"]): sorted(r["__dropped"]) for r in line_dedup._with_dropped(df).collect() if r["__dropped"]}


def test_equals_the_plain_version_both_ways(spark):
    rows = corpus(450, 1)
    want = plain(rows)
    df = spark.createDataFrame(rows + rows[5:9], DOC)
    got = found(df)
    # banding finds a pair at 0.8 with probability 0.99 and more above, so that some lines may be missed, and none dropped without cause
    lines = lambda d: {(key, k) for key, v in d.items() for k in v}
    assert lines(got) <= lines(want) and len(lines(got)) >= 0.995 * len(lines(want))
    joined = {(r["doc_id"], r["mark"]): r["dropped"] for r in line_dedup.line_classes(df, sent_keys=0).collect()}
    assert joined == {(r["doc_id"], r["mark"]): r["dropped"] for r in line_dedup.line_classes(df).collect()}


def test_documents_that_share_an_id(spark):
    rows = [(1, "unique line A of the first\nshared line of both rows"), (1, "shared line of both rows\nunique line B of the second"), (None, "shared line of both rows"), (None, None), (2, "a row twice"), (2, "a row twice")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    texts = [r["text"] for r in got]
    assert sum("unique line A" in (t or "") for t in texts) == sum("unique line B" in (t or "") for t in texts) == 1
    assert sum("shared line" in (t or "") for t in texts) == 1 and sum(r["doc_id"] is None and r["text"] == "" for r in got) == 1
    assert texts.count("a row twice") == 2 and None in texts


def test_shared_buckets_in_little_memory():
    rng = np.random.default_rng(2)
    pairs = np.stack([rng.integers(0, 300, 4000), rng.integers(0, 50, 4000)], axis=1).astype(np.int64)
    pairs[:1500, 0] = 7
    batches = [pa.RecordBatch.from_arrays([pa.array([k // 300], pa.int32()), pa.array([pairs[(pairs[:, 0] // 300 == k // 300)][k % 300 :: 300].tobytes()], pa.binary())], ["cell", "pairs"]) for k in range(300)]
    want = pd.DataFrame(pairs, columns=["b", "k"]).drop_duplicates()
    want = {tuple(r) for r in want[want.groupby("b")["k"].transform("size") > 1].to_numpy().tolist()}
    for most in (1 << 22, 50, 500):
        got = {(b, k) for out in line_dedup._shared(iter(batches), most) for b, k in zip(*(c.to_pylist() for c in out.columns))}
        assert got == want


def test_white_space_and_case():
    for line in ("  A  b ", "a\xa0b", "x y\x1cz", "\t", "", "plain", "Éİ q"):
        assert line_dedup.normalised(line) == " ".join(line.lower().split())


def test_columns_of_any_name_stay(spark):
    shape = "doc_id long, text string, __dropped string, id_ int, mark string, key int"
    df = spark.createDataFrame([(1, "a line of some length\nanother line of the text", "x", 1, "m", 2), (2, "a line of some length\nthird", "y", 2, "n", 3)], shape)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["__dropped"]) for r in got.collect()) == [(1, "a line of some length\nanother line of the text", "x"), (2, "third", "y")]
