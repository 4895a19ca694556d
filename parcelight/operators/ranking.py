"""Top rows, distinct-on, modal values and arg-max within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn", cut: str | None = None) -> DataFrame:
    """The first n rows of each group with their rank; `cut` counts the rows left out of the group.

    Without `cut` Spark prunes rows before the shuffle already.
    """
    w = W.partitionBy(*keys)
    ranked = df.withColumn(rank, F.row_number().over(w.orderBy(*order)))
    if cut:
        ranked = ranked.withColumn(cut, F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)).over(w) - n))
    return ranked.filter(F.col(rank) <= n)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order (DISTINCT ON)."""
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def modal_value(df: DataFrame, keys: list[str], value: str, out: str = "modal", count: str = "modal_count") -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones; nulls don't count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return best_per_key(counted, keys, [F.desc("_n"), F.asc(value)]).select(*keys, F.col(value).alias(out), F.col("_n").alias(count))


def array_union_per_key(df: DataFrame, keys: list[str], element: str, out: str, size: str) -> DataFrame:
    """The sorted distinct elements of each key and how many."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(element)).alias(out))
    return sets.withColumn(size, F.size(out).cast("long"))


def facet_counts(df: DataFrame, elements: Column, out: str = "value") -> DataFrame:
    """How many rows hold each element, most frequent first; an element counts once per row."""
    each = df.select(F.explode(F.array_distinct(elements)).alias(out))
    return each.groupBy(out).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), out)
