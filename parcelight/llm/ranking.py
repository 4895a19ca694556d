"""Gapless ranks within hot groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gapless_rank(df: DataFrame, keys: list[str], spread: Column, order: list[str], out: str, pieces: int) -> DataFrame:
    """Adds `out`: 0, 1, 2 ... within each combination of `keys`, which must not be null.

    A group is cut into `pieces` by a hash of `spread`; rows are numbered inside their piece, and each piece
    starts where the sizes of the pieces before it end. Only (group, piece) counts meet per group. Rows that
    are equal in `order` may take each other's rank.
    """
    piece = F.pmod(F.xxhash64(spread, F.lit("rank")), F.lit(pieces)).cast("int")
    df = df.withColumn("_piece", piece)
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_piece").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = W.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside).cast("long"))
        .join(starts, [*keys, "_piece"])
        .withColumn(out, F.col("_start") + F.col("_row") - 1)
        .drop("_piece", "_row", "_start")
    )
