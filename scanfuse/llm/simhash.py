"""SimHash near-dedup by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.llm.common import UnionFind, components, numbered, staged, table

BITS = 64


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all word shingles, A-Z lower-cased; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65536):  # a very long text in slices
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py() or "") for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _fingerprint("text").alias("fp"))


def _blocks(errors: int, extra: int = 2) -> list[int]:
    """Masks of errors + extra blocks of the 64 bits, as equal in width as can be."""
    n = errors + extra
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def trie_join(group: np.ndarray, code: np.ndarray, errors: int, chunk: int = 1 << 20) -> UnionFind:
    """Joins codes of the same group that differ in at most `errors` bits. (group, code) must be sorted and distinct; codes are unsigned.

    A group's codes, sorted, are the leaves of a binary trie whose nodes are ranges. Node pairs descend together, first the pair of each
    root with itself: a pair's children with unequal bits add one differing bit, and a pair beyond the budget is pruned. The budget
    grows from 1 to `errors`; a pair of nodes that earlier budgets have put into one set is not opened again, so that dense clusters
    cost what connecting them costs and not all their pairs.
    """
    n = len(code)
    sets = UnionFind(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[starts[1:], n]
    wide = ends - starts > 1
    roots = np.stack([starts[wide], ends[wide]], axis=1)
    for budget in range(1, errors + 1):
        label = sets.roots().copy()
        change = np.r_[label[1:] != label[:-1], True]
        at = np.flatnonzero(change)
        same_until = at[np.searchsorted(at, np.arange(n))] + 1
        stack = [(BITS - 1, roots[:, 0], roots[:, 1], roots[:, 0], roots[:, 1], np.zeros(len(roots), np.int8))]
        while stack:
            bit, a0, a1, b0, b1, err = stack.pop()
            keep = ~((same_until[a0] >= a1) & (same_until[b0] >= b1) & (label[a0] == label[b0]))
            a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
            if not len(a0):
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if bit < 0 or single.any():  # leaves: the rest of the bits at once
                x, y = a0[single] if bit >= 0 else a0, b0[single] if bit >= 0 else b0
                near = np.bitwise_count(code[x] ^ code[y]) <= budget
                sets.join_all(x[near], y[near])
                if bit < 0:
                    continue
                a0, a1, b0, b1, err = a0[~single], a1[~single], b0[~single], b1[~single], err[~single]
                if not len(a0):
                    continue
            if len(a0) > chunk:
                for k in range(0, len(a0), chunk):
                    stack.append((bit, *(v[k : k + chunk] for v in (a0, a1, b0, b1, err))))
                continue
            am, bm = _split(code, a0, a1, bit), _split(code, b0, b1, bit)
            own = a0 == b0
            left = [(a0, am, b0, bm, err, np.ones(len(a0), bool)), (am, a1, bm, b1, err, np.ones(len(a0), bool)), (a0, am, bm, b1, err + 1, err < budget), (am, a1, b0, bm, err + 1, (err < budget) & ~own)]
            new = [np.concatenate([part[c][(part[0] < part[1]) & (part[2] < part[3]) & part[5]] for part in left]) for c in range(5)]
            lone = (new[0] == new[2]) & (new[1] - new[0] == 1)
            stack.append((bit - 1, *(v[~lone] for v in new)))
    return sets


def _split(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First leaf in [lo, hi) whose bit is 1: a binary search over all nodes at once."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (code[np.minimum(mid, len(code) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _links(batches: Iterator[pd.DataFrame], errors: int, at_once: int = 100_000) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by group, so a group can go on only from one batch into the next; about at_once rows of whole groups are joined together."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []

    def join(parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        key, code = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((code, key))
        key, code = key[order], code[order]
        root = trie_join(key, code, errors).roots()
        far = root != np.arange(len(root))
        return pd.DataFrame({"u": code[far].view(np.int64), "v": code[root[far]].view(np.int64)})

    for pdf in batches:
        key, code = pdf["bucket"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if rest and len(key) and (cut or rest[-1][0][-1] != key[0]) and sum(len(k) for k, _ in rest) + cut >= at_once:
            yield join([*rest, (key[:cut], code[:cut])])
            rest, key, code = [], key[cut:], code[cut:]
        if len(key):
            rest.append((key, code))
    if rest:
        yield join(rest)


def links(fps: DataFrame, errors: int = 4, hot: int = 20_000) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints (column fp, signed 64 bits) with at most `errors` differing bits.

    Two such fingerprints agree on at least two of errors + 2 blocks. Each pair of blocks is one trie whose upper levels are those two
    blocks with budget zero, dealt out by their value; below, a task traverses node pairs of its tries with the whole budget.
    A trie of more than `hot` leaves is not one task: its next 8 bits name 256 nodes, and each pair of nodes within the budget is dealt out
    on its own, every leaf going to the pairs its node is in.
    """
    masks = _blocks(errors)
    pairs = list(combinations(range(len(masks)), 2))
    trie = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(masks[a] | masks[b]))) for a, b in pairs))).alias("k", "top")
    rows = fps.select("fp", trie)
    sizes = rows.groupBy("k", "top").agg(F.count("*").alias("leaves")).where("leaves > 1")
    sizes = staged(sizes, "tries")
    big = sizes.where(F.col("leaves") > hot).select("k", "top", F.lit(True).alias("big"))
    rows = rows.join(sizes.where(F.col("leaves") <= hot).select("k", "top"), ["k", "top"], "left_semi").select(F.xxhash64("k", "top").alias("bucket"), "fp")
    n_big = big.count()
    if n_big:
        rows = rows.unionByName(_big_tries(fps.select("fp", trie), big, masks, pairs, errors))
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartition(int(n), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(lambda batches: _links(batches, errors), "u long, v long")


def _big_tries(rows: DataFrame, big: DataFrame, masks: list[int], pairs: list[tuple[int, int]], errors: int) -> DataFrame:
    """Leaves of large tries, one row for each pair of level-8 nodes that they take part in."""
    shifts = []
    for a, b in pairs:  # eight bits outside the two blocks: the low ends of two other blocks
        free = [m for k, m in enumerate(masks) if k not in (a, b)][:2]
        shifts.append([(m & -m).bit_length() - 1 for m in free])
    node = F.coalesce(*(F.when(F.col("k") == k, F.shiftrightunsigned("fp", s).bitwiseAND(15).bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", t).bitwiseAND(15), 4))) for k, (s, t) in enumerate(shifts)))
    flips = F.array(*(F.lit(x).cast("long") for x in range(256) if x.bit_count() <= errors))
    rows = rows.join(big, ["k", "top"], "left_semi").select("k", "top", "fp", node.alias("node"), F.explode(flips).alias("flip"))
    other = F.col("node").bitwiseXOR(F.col("flip"))
    return rows.select(F.xxhash64("k", "top", F.least("node", other), F.greatest("node", other)).alias("bucket"), "fp")


def _roots(prints: DataFrame, errors: int) -> DataFrame:
    """Of each fingerprint of prints (fp, doc_id, row; a written table): root, its smallest doc_id (first; nulls last) and a row that has it."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min_by("row", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("row")), "distinct-prints")
    comp = components(links(distinct.select("fp"), errors))
    return distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "row", F.coalesce("component", "fp").alias("root"))


def near_groups(docs: DataFrame, errors: int = 4) -> DataFrame:
    """Near-duplicate groups by SimHash: documents are linked when their fingerprints differ in at most `errors` bits.

    docs: doc_id (long), text; other columns are not read. Null text counts as empty; texts without words have fingerprint zero and are linked like any
    others. Repeated rows each appear. An empty table gives an empty result.
    Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable; of null ids alone, null).
    Copies meet as one fingerprint before the join, so that a group of copies is one leaf; links are spanning links, never all pairs.
    """
    prints = staged(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()), "prints")
    joined = staged(_roots(prints, errors), "roots")
    low = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = joined.join(low, "root").select("fp", "component_id")
    return prints.join(linked, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, errors: int = 4) -> DataFrame:
    """One row of each group stays, with all its columns: the one with the smallest doc_id (nulls last), whether or not rows share a doc_id or have none."""
    rows, row, more = numbered(docs, "numbered", fp=_fingerprint("text"))
    roots = _roots(rows.select(F.col(more["fp"]).alias("fp"), "doc_id", F.col(row).alias("row")), errors)
    keep = roots.groupBy("root").agg(F.min_by("row", F.struct(F.col("first").isNull(), "first", "row")).alias(row)).select(row)
    return rows.join(keep, row, "left_semi").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
