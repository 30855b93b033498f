"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import SPACES, numbered, staged, table

#: A rank packs (code points, smallest id first) into one decimal, so that a hash aggregate can hold it in place.
_RANK = "cast(n_cp AS decimal(10,0)) * cast(18446744073709551616 AS decimal(20,0)) + (9223372036854775807 - cast(coalesce(doc_id, 9223372036854775807) AS decimal(20,0)))"
_ID = "cast(9223372036854775807 - rank % cast(18446744073709551616 AS decimal(20,0)) AS bigint)"


def _normalised() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), SPACES, "")


def _digests() -> dict[str, Column]:
    return {"digest": F.unhex(F.sha2(_normalised(), 256)), "probe": F.xxhash64(_normalised())}


def _winners(docs: DataFrame, salts: int, hot_share: int) -> DataFrame:
    """digest, probe, keep, group_size and the row that stays (keep_row) of each group of docs (row, doc_id, text, digest, probe), a written table."""
    counts = docs.groupBy("digest").count()
    hot = counts.where(F.col("count") * hot_share > docs.count()).select("digest", F.lit(True).alias("hot"))
    salted = (
        docs.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_cp"), _normalised().alias("norm"), "digest", "probe")
        .join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")))
        .withColumn("rank", F.expr(_RANK))
        .groupBy("digest", "probe", "salt", "norm")
        .agg(F.max("rank").alias("rank"), F.max_by("row", "rank").alias("row"), F.count("*").alias("n"))
    )
    # a cold digest has one salt, so its text need not travel on
    part = staged(salted.withColumn("norm", F.when(F.col("salt").isNotNull(), F.col("norm"))), "salted", dictionary=False)
    merged = part.where("salt IS NOT NULL").groupBy("digest", "probe", "norm").agg(F.max(F.struct("rank", "row")).alias("x"), F.sum("n").alias("n"))
    best = part.where("salt IS NULL").select("digest", "probe", "rank", "row", "n").unionByName(merged.select("digest", "probe", "x.rank", "x.row", "n"))
    return best.select("digest", "probe", F.expr(_ID).alias("keep"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = 16, hot_share: int = 1000) -> DataFrame:
    """Groups documents whose texts are equal after white space is deleted.

    docs: doc_id (an integer), text; other columns, whatever their names, are not read. Null text counts as empty.
    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the one with the most code points in the
    original text stays, then the smallest doc_id; of rows that are equal in both, one of them. A null doc_id ranks last; where it wins,
    keep_id is null. An empty table gives an empty result.

    Texts meet by digest and full content: first inside each map task, then in salted groups, then the salts' winners; only digests
    holding more than 1/hot_share of the rows (fewer than hot_share of them, so they may be broadcast) take more than one salt.
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(c.alias(k) for k, c in _digests().items())), "digests", dictionary=False)
    out = rows.select("row", "doc_id", "digest", "probe").join(_winners(rows, salts, hot_share), ["digest", "probe"])
    return out.select("doc_id", F.expr("nullif(keep, 9223372036854775807)").alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, salts: int = 16, hot_share: int = 1000) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, whether or not rows share a doc_id or have none."""
    rows, row, more = numbered(docs, "numbered", **_digests())
    own = rows.select(F.col(row).alias("row"), "doc_id", "text", *(F.col(n).alias(k) for k, n in more.items()))
    keep = _winners(own, salts, hot_share).select(F.col("keep_row").alias(row))
    return rows.join(keep, row, "left_semi").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
