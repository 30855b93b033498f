"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.operators.components import UnionFind, components, discard, staged

__all__ = ["SPACES", "UnionFind", "components", "discard", "fresh", "numbered", "staged", "table"]

#: The characters of `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, label: str, **more: Column) -> tuple[DataFrame, str, dict[str, str]]:
    """docs written with a number for each row and `more` columns; the names that number and columns got, none of docs' own.

    Written, because a number must stay what it is: rows that share an id, or have none, are told apart by it.
    """
    row = fresh(docs, "row_number")
    names = {k: fresh(docs, k) for k in more}
    return staged(docs.select("*", F.monotonically_increasing_id().alias(row), *(c.alias(names[k]) for k, c in more.items())), label, dictionary=False), row, names
