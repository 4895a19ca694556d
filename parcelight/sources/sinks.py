"""Sinks: exports, partition replacement, derived tables and deletions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly these columns in this order, with a header; absent ones are empty, others left out."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def as_feature(identity: Column, geometry: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text; geometry is GeoJSON text."""
    parsed = F.from_json(geometry, "type string, coordinates string")
    head = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(identity)).substr(F.lit(2), F.length(F.to_json(F.array(identity))) - 2))
    body = F.concat(F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    return F.when(parsed["type"].isNotNull(), F.concat(head, body))


def write_features(df: DataFrame, path: str, identity: str, geometry: str, properties: list[str]) -> None:
    """A feature a line; rows whose geometry isn't valid GeoJSON are left out."""
    df.select(as_feature(F.col(identity), F.col(geometry), properties).alias("value")).filter("value is not null").write.mode("overwrite").text(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> dict:
    """Writes df over the partitions that it holds, others stay; rows without key or partition are skipped and counted."""
    fine = F.col(partition).isNotNull() & (F.trim(F.col(partition).cast("string")) != "")
    seen = Observation("rows")
    counted = df.observe(seen, F.count_if(fine).alias("written"), F.count_if(~fine).alias("skipped"))
    counted.filter(fine).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return seen.get


def empty_parquet(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """A table of the schema without rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def refresh_view(df: DataFrame, root: str, version: int) -> str:
    """A derived table under a path of its own version; readers move on when they take the new path."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def create_table_as(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def backfill_nested(features: DataFrame, geometries: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """features with `out`: the structs (id, geometry) of the ids that geometries has, in the order of the ids."""
    each = features.select(key, F.posexplode(ids).alias("_pos", "id"))
    found = each.join(geometries, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "id", "geometry"))).alias("_g"))
    nested = F.transform(F.coalesce("_g", F.array().cast("array<struct<_pos:int,id:string,geometry:string>>")), lambda g: F.struct(g["id"].alias("id"), g["geometry"].alias("geometry")))
    return features.drop(out).join(found, key, "left").withColumn(out, nested).drop("_g")


def reset_partition(df: DataFrame, partition: str, value: str, dry_run: bool = False) -> tuple[DataFrame, int]:
    """df without a partition, and how many rows that takes away (with dry_run df stays)."""
    doomed = df.filter(F.col(partition) == value).count()
    return (df if dry_run else df.filter(~F.coalesce(F.col(partition) == value, F.lit(False)))), doomed


def cascade_delete(doomed: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows whose key is doomed."""
    keys = doomed.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def write_metrics(path: str, phases: dict[str, float], counts: dict[str, int]) -> None:
    """Phase seconds and counts of a run as JSON, on the driver."""
    with open(path, "w") as f:
        json.dump({"phases": {k: round(v, 3) for k, v in phases.items()}, "counts": counts}, f, indent=1)
