"""Line dedup: fuzzy lines by MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import components, fresh, staged, table

SHINGLE = 6
BANDS, ROWS = 12, 5  # at a similarity of 0.8 a pair meets in some band with probability 0.99
SIMILARITY = 0.8
#: Candidate keys (8 bytes each) up to which they are broadcast to pick the candidates' texts; more are joined by a shuffle.
SENT_KEYS = 4_000_000
BLOCK = 256
_RNG = np.random.default_rng(20_240_229)
_MUL = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def normalised(line: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    low = line.lower()
    # printable text has no white space but the plain space
    return low.strip(" ") if low.isprintable() and "  " not in low else " ".join(low.split())


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _joined(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the lines as numbers, which positions start a shingle, and how many shingles each line has; a line shorter than a shingle is its own."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\uffff") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    valid = np.ones(len(code), bool)
    ends = np.cumsum(size)
    for k in range(1, SHINGLE):
        valid[ends - k] = False
    return code, valid[: len(code) - SHINGLE + 1], size - SHINGLE + 1


def _polynomial(code: np.ndarray, base: np.integer) -> np.ndarray:
    with np.errstate(over="ignore"):
        three = (code[:-2] * base + code[1:-1]) * base + code[2:]
        return three[:-3] * (base * base * base) + three[3:]


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all shingles of the lines, and how many each line has."""
    code, valid, many = _joined(lines)
    return _polynomial(code.astype(np.uint64), np.uint64(0x100000001B3))[valid], many


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Of each line its distinct shingles' codes, sorted."""
    if not lines:
        return []
    code, many = shingle_codes(lines)
    out = []
    for part in np.split(code, np.cumsum(many)[:-1]):
        part = np.sort(part)
        out.append(part[np.r_[True, part[1:] != part[:-1]]])
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least SIMILARITY."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SIMILARITY * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def band_keys(lines: list[str]) -> np.ndarray:
    """One row per line: the keys of its bands, 64 bits. Lines are normalised and not empty."""
    out = np.empty((len(lines), BANDS), np.uint64)
    start, chars = 0, 0
    for k, line in enumerate(lines):  # slices that fit a cache
        chars += len(line)
        if chars > 60_000 or k == len(lines) - 1:
            out[start : k + 1] = _band_keys(lines[start : k + 1])
            start, chars = k + 1, 0
    return out


def _band_keys(lines: list[str]) -> np.ndarray:
    code, valid, many = _joined(lines)
    with np.errstate(over="ignore"):
        # 32 bits are enough to choose candidates and half the work; verification has codes of 64
        h = _polynomial(code, np.uint32(0x9E3779B1))[valid]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        at = np.cumsum(many) - many
        low, turned = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(h)
        for k, mul in enumerate(_MUL):
            np.minimum.reduceat(np.multiply(h, mul, out=turned), at, out=low[k])
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
        for k in range(ROWS):
            key = (key ^ low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key.T


def _occurrences(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per line that is not empty: its document, number and digest; band keys and text where the slice has the line for the first time."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            doc, no, digest, fresh, new = [], [], [], [], {}
            for d, text in enumerate(batch.column(2)):
                for k, line in enumerate(lines_of(text.as_py())):
                    if line := normalised(line):
                        x = xxhash.xxh128_digest(line.encode("utf-8", "replace"))
                        fresh.append(x not in new)
                        new.setdefault(x, line)
                        doc.append(d)
                        no.append(k)
                        digest.append(x)
            fresh = np.array(fresh, bool)
            rows, width = np.ascontiguousarray(band_keys(list(new.values()))).tobytes(), BANDS * 8
            at = (np.cumsum(fresh) - 1) * width
            bands = pa.array([rows[a : a + width] if f else None for a, f in zip(at.tolist(), fresh.tolist())], pa.binary())
            texts = pa.array([new[x] if f else None for x, f in zip(digest, fresh)], pa.string())
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            own = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(no, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), bands, texts],
                ["doc_id", "mark", "line", "key", "rest", "bands", "text"],
            )


def _celled(batches: Iterator[pa.RecordBatch], cells: int, at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Pairs (bucket, key) of every line's bands, packed by cell: one row holds what a task has for one of `cells` equal ranges of buckets, so that few rows are dealt out."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        pairs = np.concatenate(held) if held else np.empty((0, 2), np.int64)
        held.clear()
        pairs = pairs[np.argsort(pairs[:, 0].view(np.uint64))]
        edges = np.searchsorted(pairs[:, 0].view(np.uint64), np.arange(cells, dtype=np.uint64) * np.uint64((1 << 64) // cells))
        ends = np.r_[edges[1:], len(pairs)]
        some = np.flatnonzero(edges < ends)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pairs[edges[c] : ends[c]].tobytes() for c in some], pa.binary())], ["cell", "pairs"])

    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            held.append(np.stack([bands, np.repeat(batch.column(0).to_numpy(), BANDS)], axis=1))
            if sum(map(len, held)) >= at_once:
                yield out()
    yield out()


def _shared(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell: passes on what stands in a bucket with more than one key.

    Whenever a cell's pairs come to `most`, shared buckets are passed on and one key of each bucket is kept, so that a bucket of any size
    takes no memory; a key may pass more than once.
    """
    cell, held, size = None, [], 0
    none = np.empty((0, 2), np.int64), np.empty(0, bool)

    def settle(retain: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], pa.RecordBatch]:
        """One key of each bucket, marked where the bucket has passed already; and what passes now."""
        pairs, sent = (np.concatenate(x) for x in zip(*held)) if held else none
        order = np.argsort(pairs[:, 0])
        pairs, sent = pairs[order], sent[order]
        if not retain:  # a bucket's only pair needs no further look
            same = pairs[1:, 0] == pairs[:-1, 0]
            some = np.r_[same, False] | np.r_[False, same]
            pairs, sent = pairs[some[: len(pairs)]], sent[some[: len(pairs)]]
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, sent = pairs[order], sent[order]
        first = np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)]
        starts = np.flatnonzero(first)
        sent = np.logical_or.reduceat(sent, starts) if len(starts) else sent
        pairs = pairs[first]
        bucket = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]][: len(pairs)]
        starts = np.flatnonzero(bucket)
        many = np.diff(np.r_[starts, len(pairs)])
        shared = (many > 1) | (np.logical_or.reduceat(sent, starts) if len(starts) else sent)
        go = np.repeat(shared, many) & ~sent
        return (pairs[starts], shared), pa.RecordBatch.from_arrays([pa.array(pairs[go, 0]), pa.array(pairs[go, 1])], ["bucket", "key"])

    for batch in batches:
        for c, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if c != cell and held:
                yield settle()[1]
                held, size = [], 0
            cell = c
            pairs = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2)
            held.append((pairs, np.zeros(len(pairs), bool)))
            size += len(pairs)
            if size >= most:
                kept, passed = settle(retain=True)
                yield passed
                held, size = [kept], 0
    yield settle()[1]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(dict.fromkeys([*pdf["u_text"], *pdf["v_text"]]))
        sets = dict(zip(texts, shingle_sets(texts)))
        near = [similar(sets[a], sets[b]) for a, b in zip(pdf["u_text"], pdf["v_text"])]
        yield pdf.loc[np.array(near, bool), ["u", "v"]]


def _crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by group: links components that lines of one group show to be similar. A group has at most two blocks of lines."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf])
        if len(rest):
            ends = rest["grp"] == rest["grp"].iloc[-1]
            yield _cross(rest[~ends])
            rest = rest[ends]
    if rest is not None:
        yield _cross(rest)


def _cross(pdf: pd.DataFrame) -> pd.DataFrame:
    texts = list(dict.fromkeys(pdf["text"]))
    sets, row = shingle_sets(texts), {t: k for k, t in enumerate(texts)}
    links, grp = [], pdf["grp"].to_numpy()
    starts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.empty(0, np.int64)
    labels, rows = pdf["label"].to_numpy(), [row[t] for t in pdf["text"]]
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(grp)]):
        order = first + np.argsort(labels[first:last], kind="stable")
        at = labels[order]
        if at[0] == at[-1]:
            continue
        own, mine = at.copy(), [sets[rows[k]] for k in order.tolist()]
        size = np.fromiter(map(len, mine), np.int64, len(mine))
        begins = np.cumsum(size) - size
        code = np.unique(np.concatenate(mine), return_inverse=True)[1]
        marks = np.zeros(int(code.max()) + 1, bool)
        for j, m in enumerate(np.searchsorted(at, at).tolist()):  # the m lines of smaller labels
            if not m:
                continue
            shingles = code[begins[j] : begins[j] + size[j]]
            marks[shingles] = True
            both = np.add.reduceat(marks[code[: begins[m]]], begins[:m], dtype=np.int64)
            marks[shingles] = False
            for i in np.flatnonzero(both >= SIMILARITY * (size[:m] + size[j] - both)).tolist():
                if own[i] != own[j]:
                    links.append((at[j], at[i]))
                    own[own == own[j]] = own[i]
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _mark() -> Column:
    """With doc_id, what tells rows apart: rows with the same doc_id and the same text count as one document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_classes(docs: DataFrame, sent_keys: int = SENT_KEYS) -> DataFrame:
    """For each document the numbers (from 0) of its lines that go: doc_id, mark (xxhash64 of the text, null as empty), dropped array<int>; documents that keep all have no row.

    Lines are compared in lower case with white space collapsed; empty ones are never dropped. Lines are linked at a Jaccard similarity of
    at least 0.8 of their 6-character shingles (a shorter line is its own shingle); of each component of linked lines the first
    occurrence by (doc_id, mark, line) stays. Rows that repeat a doc_id with other texts are documents of their own; rows that repeat doc_id and
    text count as the same occurrences. A null doc_id sorts last. doc_id is an integer.

    Equal lines are one key from the start. Candidates share a band; a bucket's lines are first verified against its smallest, which
    connects dense buckets in linear work; then, in buckets of three and more that are not one component, all lines of different
    components are verified, in pairs of blocks where a bucket is large, so no link inside a bucket is missed. Only candidates' texts move.
    Candidate keys are broadcast up to `sent_keys` of 8 bytes; more are joined by a shuffle, with the same result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    seen = staged(
        docs.select("doc_id", _mark().alias("mark"), "text").mapInArrow(lambda it: _occurrences(it, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, mark long, line int, key long, rest long, bands binary, text string"),
        "lines",
        dictionary=False,
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = 16 * n
    packed = seen.where("bands IS NOT NULL").select("key", "bands").mapInArrow(lambda it: _celled(it, cells), "cell int, pairs binary").repartition(n, "cell").sortWithinPartitions("cell")
    near = staged(packed.mapInArrow(_shared, "bucket long, key long"), "buckets")
    keys = staged(near.select("key").distinct(), "keys")
    few = keys.count() <= sent_keys
    found = seen.where("text IS NOT NULL").select("key", "rest", "text").join(F.broadcast(keys) if few else keys, "key", "left_semi")
    cand = staged(found.groupBy("key", "rest").agg(F.first("text").alias("text")).select(F.monotonically_increasing_id().alias("lid"), "key", "rest", "text"), "candidates")

    member = staged(near.join(cand.select("lid", "key"), "key").select("bucket", "lid"), "members")
    least = member.groupBy("bucket").agg(F.min("lid").alias("v"))
    pairs = member.join(least, "bucket").where("lid <> v").select(F.col("lid").alias("u"), "v").distinct()
    text = cand.select("lid", "text")
    pairs = pairs.join(text.select(F.col("lid").alias("u"), F.col("text").alias("u_text")), "u").join(text.select(F.col("lid").alias("v"), F.col("text").alias("v_text")), "v")
    star = staged(pairs.mapInPandas(_verified, "u long, v long"), "star-links")
    label = staged(components(star), "star-components")

    marked = member.join(label.withColumnRenamed("node", "lid"), "lid", "left").select("bucket", "lid", F.coalesce("component", "lid").alias("label"))
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("lid").cast("decimal(38,0)")).alias("same")).where("a <> b AND n > 2")
    open_ = open_.groupBy("n", "same", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    rows = marked.join(open_, "bucket").join(text, "lid").withColumns({"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "block": F.pmod(F.xxhash64("lid"), F.ceil(F.col("n") / BLOCK)).cast("int")})
    rows = rows.select("lid", "label", "text", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("label", "text", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("grp"))
    more = rows.repartition(n, "grp").sortWithinPartitions("grp").mapInPandas(_crossed, "u long, v long")
    over = staged(components(more).select(F.col("node").alias("component"), F.col("component").alias("over")), "over-components")
    comp = label.join(over, "component", "left").select(F.col("node").alias("lid"), F.coalesce("over", "component").alias("component"))
    alone = over.join(label, "component", "left_anti").select(F.col("component").alias("lid"), F.col("over").alias("component"))  # lines without a star link
    comp = comp.unionByName(alone)

    # (doc_id, part of the mark, line) as one number that a hash aggregate holds in place; nulls last
    place = F.expr("cast((coalesce(cast(doc_id AS decimal(20,0)), 9223372036854775808BD) * 1073741824BD + shiftrightunsigned(mark, 34)) * 2147483648BD + line AS decimal(38,0))")
    # lines that occur once and are like no other stay; one aggregate finds the others, with their classes
    classes = cand.select("key", "rest", "lid").join(comp, "lid").select("key", "rest", F.lit(None).cast("decimal(38,0)").alias("place"), F.col("component").alias("class"))
    first = seen.select("key", "rest", place.alias("place"), F.lit(None).cast("long").alias("class")).unionByName(classes)
    first = first.groupBy("key", "rest").agg(F.min("place").alias("first"), F.count("place").alias("n"), F.max("class").alias("class")).where("class IS NOT NULL OR n > 1")
    first = staged(first, "first-lines")
    linked = first.where("class IS NOT NULL")
    keep = linked.join(linked.groupBy("class").agg(F.min("first").alias("keep")), "class").select("key", "rest", "keep")
    keep = staged(keep.unionByName(first.where("class IS NULL").select("key", "rest", F.col("first").alias("keep"))), "kept-lines")
    gone = seen.select("doc_id", "mark", "line", "key", "rest").join(keep.hint("shuffle_hash"), ["key", "rest"]).where(place != F.col("keep"))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def _with_dropped(docs: DataFrame, name: str = "__dropped") -> DataFrame:
    """docs with `name`, the numbers of the lines that go, or null."""
    id_, mark = fresh(docs, "id_"), fresh(docs, "mark")
    gone = line_classes(docs).withColumnsRenamed({"doc_id": id_, "mark": mark, "dropped": name})
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & (_mark() == gone[mark]), "left").drop(id_, mark)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` rid of repeated lines; other columns stay, whatever their names. A document all of whose lines go keeps an empty text; a null text stays null."""
    name = fresh(docs, "__dropped")
    on = _with_dropped(docs, name)
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(name, k)), "\n"))
    return on.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped and their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    n = docs.select("doc_id", _mark().alias("mark"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    gone = line_classes(docs).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    out = n.join(gone, n["doc_id"].eqNullSafe(gone["__id"]) & (n["mark"] == gone["__mark"]), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))
