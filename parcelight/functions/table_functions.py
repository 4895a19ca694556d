"""Table functions: rows made from a shape, a batch of shapes at a time. They take a table of `id` (text) and `polygons`:
`contour_samples(shapes.asTable())`, or in SQL, once registered, `SELECT * FROM contour_samples(TABLE(shapes))`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from . import planar_batch
from .shapes import column_of, contour, values_of


def contour_rows(batch: pa.RecordBatch) -> pa.Table:
    points = [contour(ring) for ring in planar_batch.outlines(planar_batch.rings_of(batch.column("polygons"))[0])]
    count = [len(p) for p in points]
    at = np.concatenate([np.zeros((0, 2)), *points])
    ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(count)), count)))
    number = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in count]])
    return pa.table({"id": ids, "n": pa.array(number, pa.int32()), "x": pa.array(at[:, 0]), "y": pa.array(at[:, 1])})


def polygon_rows(batch: pa.RecordBatch) -> pa.Table:
    shapes = [s or [] for s in values_of(batch.column("polygons"))]
    count = [len(s) for s in shapes]
    ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(count)), count)))
    number = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in count]])
    return pa.table({"id": ids, "n": pa.array(number, pa.int32()), "polygon": column_of([p for s in shapes for p in s], 2)})


@arrow_udtf(returnType="id string, n int, x double, y double")
class contour_samples:  # noqa: N801
    """The points along the outline of each shape in metres, numbered from 0."""

    def eval(self, batch: pa.RecordBatch):
        yield contour_rows(batch)


@arrow_udtf(returnType="id string, n int, polygon array<array<struct<x:double,y:double>>>")
class shape_polygons:  # noqa: N801
    """A row for each polygon of each shape, numbered from 0."""

    def eval(self, batch: pa.RecordBatch):
        yield polygon_rows(batch)


def register(spark: SparkSession) -> None:
    """For use in SQL."""
    spark.udtf.register("contour_samples", contour_samples)
    spark.udtf.register("shape_polygons", shape_polygons)
