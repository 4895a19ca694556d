"""Keyed merges: upserts, inserts of absent keys, monotone status, precedence unions, partition replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best_per_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str], latest: list[Column] | None = None) -> DataFrame:
    """old with new's rows replacing those of the same key. Of several new rows of a key the first by `latest` counts;
    columns that one side lacks are null."""
    marked = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return best_per_key(marked, keys, [F.desc("_new"), *(latest or [])]).drop("_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], first: list[Column]) -> DataFrame:
    """old and the first new row of each key that old lacks; old's rows stay as they are."""
    fresh = best_per_key(new.join(old.select(*keys), keys, "left_anti"), keys, first)
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_keeping_matched(old: DataFrame, new: DataFrame, key: str, status: str = "match_status", kept: tuple[str, ...] = ("properties_json",)) -> DataFrame:
    """Upsert of unmatched parcels: a row that is matched stays matched and keeps its `kept` columns, all others of the
    key take the new values and become cadastre_only."""
    shared = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*shared).alias("_o")), new.select(key, F.struct(*[c for c in shared if c in new.columns]).alias("_n"))
    both = o.join(n, key, "full")
    matched = F.coalesce(F.col("_o")[status], F.lit("")) == "matched"
    has_new = F.col("_n").isNotNull()

    def value(c: str) -> Column:
        if c == status:
            return F.when(~has_new, F.col("_o")[c]).when(matched, "matched").otherwise("cadastre_only")
        if c not in new.columns:
            return F.col("_o")[c]
        return F.when(~has_new | (matched if c in kept else F.lit(False)), F.col("_o")[c]).otherwise(F.col("_n")[c])

    return both.select(key, *[value(c).alias(c) for c in shared])


def union_by_precedence(parts: list[DataFrame], keys: list[str], within: list[Column]) -> DataFrame:
    """One row per key, from the first part that has it."""
    whole = None
    for rank, part in enumerate(parts):
        marked = part.withColumn("_rank", F.lit(rank))
        whole = marked if whole is None else whole.unionByName(marked, allowMissingColumns=True)
    return best_per_key(whole, keys, [F.asc("_rank"), *within]).drop("_rank")


def keep_richer(old: DataFrame, new: DataFrame, key: str, score: Column) -> DataFrame:
    """Of two rows of a key the one of the higher score; the old one on a tie."""
    marked = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return best_per_key(marked.withColumn("_score", score), [key], [F.desc("_score"), F.asc("_side")]).drop("_side", "_score")


def effective_ids(matching: Column, custom: Column, removed: Column) -> Column:
    """The ids found and those added, without those taken away, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.array_union(F.coalesce(matching, none), F.coalesce(custom, none)), F.coalesce(removed, none)))


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Writes df over the partitions that it holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
