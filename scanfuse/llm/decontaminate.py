"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import numbered, table

SEED_WORDS = 5
COVERAGE = 0.6
#: Bytes of benchmark text up to which its index is sent to every task; a larger benchmark takes the shuffled way.
INDEX_BYTES = 32 << 20
#: ASCII: capitals become small letters, marks become spaces. Other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = "".join(chr(b) for b in range(65, 91)) + "".join(chr(b) for b in range(128) if not chr(b).isalnum() and b != 32)
_TO = "".join(chr(b) for b in range(97, 123)) + " " * (len(_MARKS) - 26)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` tokens, over 64 bits; windows of twice a width come from two neighbours."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, power = ids.astype(np.uint64), 1, _BASE
    h, done = np.zeros(n, np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                h = h * power + part[done : done + n]
                done += size
            if 2 * size > width:
                return h
            part = part[:-size] * power + part[size:]
            power, size = power * power, 2 * size


def _matches(doc: np.ndarray, item: np.ndarray, width: int, used_d: np.ndarray, used_i: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal matches of at least `width` free tokens: (length, start in doc, start in item)."""

    def free(used: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(used)]
        return np.flatnonzero(total[width:] == total[:-width]) if len(used) >= width else np.empty(0, np.int64)

    at_d, at_i = free(used_d), free(used_i)
    if not len(at_d) or not len(at_i):
        return
    hd, hi = rolling(doc, width)[at_d], rolling(item, width)[at_i]
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    many = up - lo
    if not many.any():
        return
    d = np.repeat(at_d, many)
    i = at_i[order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]]
    line = np.lexsort((d, d - i))
    d, i = d[line], i[line]
    begins = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(d - i) != 0)])
    for n, x, y in zip((np.diff(np.r_[begins, len(d)]) + width - 1).tolist(), d[begins].tolist(), i[begins].tolist()):
        edges = np.flatnonzero(np.diff(np.r_[False, doc[x : x + n] == item[y : y + n], False]))  # equal hashes are not yet equal tokens
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= width:
                yield b - a, x + a, y + a


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length) of the longest matches that overlap neither side, longest first.

    Windows with equal running hashes seed the matches; seeds in line form maximal ones. The longest is marked first; one that meets marked
    tokens is cut down to what is free and waits its turn anew. Windows start as long as the item and are halved down to `least` tokens, each
    time over what is still free, so that texts that repeat themselves do not meet at all their places.
    """
    least = min(least, len(item))
    width = min(len(doc), len(item))
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    while least and width >= least:
        waiting = [(-n, d, i) for n, d, i in _matches(doc, item, width, used_d, used_i)]
        heapq.heapify(waiting)
        while waiting:
            n, d, i = heapq.heappop(waiting)
            taken = used_d[d : d - n] | used_i[i : i - n]
            if not taken.any():
                used_d[d : d - n] = used_i[i : i - n] = True
                found.append((d, i, -n))
                continue
            edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= width:
                    heapq.heappush(waiting, (int(a - b), d + int(a), i + int(a)))
        if width == least:
            break
        width = max(least, width // 2)
    return found


class Index:
    """The benchmark's token ids and seeds; token id 0 is any token that the benchmark lacks."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.items = [np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), np.int64) for _, words in items]
        self.width = width
        grams = [rolling(x, width) for x in self.items]
        gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        where = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.which, self.where = gram[order], which[order], where[order]
        self.short = [k for k, x in enumerate(self.items) if 0 < len(x) < width]
        self.seeds = np.unique(self.gram)

    def matches(self, text: str | None, coverage: float) -> Iterator[tuple[object, float, list[tuple[int, int, int]]]]:
        """Items of which tiles cover enough in the text."""
        ids = np.fromiter(map(self.vocab.get, tokens(text), repeat(0)), np.int64) if text else np.empty(0, np.int64)
        if not len(ids) or not ids.any():
            return
        h = rolling(ids, self.width)
        at = np.searchsorted(self.seeds, h)
        hit = np.unique(h[self.seeds[np.minimum(at, len(self.seeds) - 1)] == h]) if len(self.seeds) and len(h) else h[:0]
        wanted: set[int] = set()
        if len(hit):
            lo, up = np.searchsorted(self.gram, hit, "left"), np.searchsorted(self.gram, hit, "right")
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, up)])
            # no tiling covers more than all seeds together do
            for k in np.unique(self.which[rows]):
                mark = np.zeros(len(self.items[k]) + 1, np.int64)
                start = self.where[rows[self.which[rows] == k]]
                mark[start] += 1
                np.add.at(mark, start + self.width, -1)
                if (np.cumsum(mark[:-1]) > 0).mean() >= coverage:
                    wanted.add(int(k))
        wanted |= {k for k in self.short if np.isin(self.items[k], ids).all()}
        for k in sorted(wanted):
            found = tiles(ids, self.items[k], self.width)
            share = sum(n for _, _, n in found) / len(self.items[k])
            if share >= coverage:
                yield self.names[k], share, found


_SPANS = "item_id {item}, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"


def _pairs(batches: Iterator[pa.RecordBatch], index: Index, coverage: float, kinds: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
    for batch in batches:
        rows = [(d, name, share, found) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for name, share, found in index.matches(text.as_py(), coverage)]
        d, name, share, found = zip(*rows) if rows else ((), (), (), ())
        spans = [[dict(zip(("doc_word", "item_word", "words"), t)) for t in f] for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(d, kinds[0]), pa.array(name, kinds[1]), pa.array(share, pa.float64()), pa.array(spans, span)], ["doc_id", "item_id", "coverage", "tiles"])


def _by_shuffle(docs: DataFrame, bench: DataFrame, width: int, coverage: float) -> DataFrame:
    """For a benchmark of any size: shared seeds by an equi-join of hashes, then tiling of the candidate pairs."""
    from pyspark.sql.pandas.types import to_arrow_type

    # rows that share an id, or have none, are told apart by numbers
    docs, row, _ = numbered(docs.select("doc_id", "text"), "leak-docs")
    bench, item = numbered(bench.select("item_id", "text"), "leak-items")[0].withColumnRenamed("row_number", "item_number"), "item_number"
    words = lambda text: F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _MARKS, _TO), " +"), lambda w: w != "")
    grams = lambda w: F.when(F.size(w) < width, F.array(F.concat_ws(" ", w))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda k: F.concat_ws(" ", F.slice(w, k + 1, width))))
    seeds = bench.select(item, words(F.col("text")).alias("w")).where(F.size("w") > 0).select(item, F.explode(grams(F.col("w"))).alias("g")).groupBy(item, F.xxhash64("g").alias("h")).agg(F.count("*").alias("places"))
    d = docs.select(row, words(F.col("text")).alias("w"))
    short = bench.select(F.size(words(F.col("text"))).alias("n")).where(f"n BETWEEN 1 AND {width - 1}").distinct()
    own = d.where(F.size("w") >= width).select(row, F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
    few = d.select(row, "w", F.explode(F.array(*map(F.lit, range(1, width)))).alias("n")).where("size(w) >= n").join(short, "n", "left_semi").select(row, F.explode(F.expr("array_distinct(transform(sequence(0, size(w) - n), k -> concat_ws(' ', slice(w, k + 1, n))))")).alias("g"))
    pairs = own.unionByName(few).select(row, F.xxhash64("g").alias("h")).join(seeds, "h").groupBy(row, item).agg(F.sum("places").alias("shared"))
    # each place of the item that a shared seed has covers at most `width` words, so no tiling covers more
    size = bench.select(item, F.size(words(F.col("text"))).alias("n"))
    pairs = pairs.join(size, item).where(F.col("shared") * width >= F.lit(coverage) * F.col("n")).select(row, item)
    both = pairs.join(docs.select(row, "doc_id", "text"), row).join(bench.select(item, "item_id", F.col("text").alias("item_text")), item)
    kinds = [to_arrow_type(both.schema[c].dataType) for c in ("doc_id", "item_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1).to_pylist()[0]
                row = pa.RecordBatch.from_arrays([pa.array([one["doc_id"]], kinds[0]), pa.array([one["text"]], pa.string())], ["doc_id", "text"])
                yield from _pairs(iter([row]), Index([(one["item_id"], tokens(one["item_text"]))], width), coverage, (kinds[0], kinds[1]))

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SPANS.format(item=bench.schema['item_id'].dataType.simpleString())}")


def _bytes(bench: DataFrame) -> int:
    return bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _sent_index(bench: DataFrame, width: int) -> Broadcast[Index]:
    """The index of a benchmark whose size has been checked, in every task."""
    return bench.sparkSession.sparkContext.broadcast(Index([(r["item_id"], tokens(r["text"])) for r in bench.select("item_id", "text").collect()], width))


def leaks(docs: DataFrame, bench: DataFrame, width: int = SEED_WORDS, coverage: float = COVERAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, wholly, in part or reordered.

    docs: doc_id, text; bench: item_id, text; other columns are not read. Texts are compared as words, ASCII case and marks ignored.
    Returns doc_id, item_id, coverage (share of the item's words that non-overlapping matches of at least `width` words cover; of an item
    shorter than that, all of it in one match) and tiles (word positions and lengths, longest first), for coverage of at least `coverage`.
    Null and empty texts match nothing; repeated rows each give their pairs; empty tables give an empty result.

    A benchmark of at most index_bytes of text is indexed once and sent to every task, which keeps documents where they are: no shuffle.
    A larger one is joined by the hashes of shared seeds.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if _bytes(bench) > index_bytes:
        return _by_shuffle(docs, bench, width, coverage)
    shared = _sent_index(bench, width)
    kinds = (to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(bench.schema["item_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, shared.value, coverage, kinds)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SPANS.format(item=bench.schema['item_id'].dataType.simpleString())}")


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = SEED_WORDS, coverage: float = COVERAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows without any leak, with all their columns; each row is judged by its own text, whether or not rows share a doc_id or have none."""
    if _bytes(bench) > index_bytes:
        rows, row, _ = numbered(docs, "numbered")
        gone = _by_shuffle(rows.select(F.col(row).alias("doc_id"), "text"), bench, width, coverage).select(F.col("doc_id").alias(row)).distinct()
        return rows.join(gone, row, "left_anti").select(*docs.columns)
    shared = _sent_index(bench, width)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([next(shared.value.matches(t.as_py(), coverage), None) is None for t in texts], pa.bool_())

    return docs.where(clean("text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
