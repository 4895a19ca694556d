"""Tables of boxes that lie on one another: equal ones meet the other side once, and no table of boxes goes through the driver."""

import re

from pyspark.sql import functions as F

from parcelight.operators import lookups, spatial

BOX = "bxmin double, bymin double, bxmax double, bymax double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark):
    a = spark.range(4).select(F.col("id").alias("aid"), *[(F.col("id") * 10 + d).cast("double").alias("a" + s) for s, d in (("xmin", 1), ("ymin", 1), ("xmax", 9), ("ymax", 9))])
    b = spark.range(3000).select(F.col("id").alias("bid"), *[(F.col("id") % 2 * 10 + d).cast("double").alias("b" + s) for s, d in (("xmin", 0), ("ymin", 0), ("xmax", 10), ("ymax", 10))])
    return a, b


def test_boxes_are_not_broadcast(spark):
    a, b = crowd(spark)
    for df in (spatial.box_join(a, b, "a", "b", 16.0), spatial.without_covered(a, b, "a", "b", 16.0, ["aid"]), spatial.nearest_within(a, b, "axmin", "aymin", "bxmin", "bymin", 8.0, ["aid"], [F.asc("bid")])):
        assert not re.search("BroadcastExchange|BroadcastNestedLoop", plan_of(df))


def test_equal_boxes_come_back_where_they_count(spark):
    a, b = crowd(spark)
    assert spatial.folded(b, spatial.box_columns("b")).count() < 3000 // 16
    rows = spatial.overlap_join(a, b, "a", "b", 16.0, 50.0).collect()
    assert sorted((r["aid"], r["bid"]) for r in rows) == sorted((k % 2, k) for k in range(3000)) and {r["overlap_m2"] for r in rows} == {64.0}
    inside = spatial.points_in_boxes(a.select("aid", "axmin", "aymin"), b, "axmin", "aymin", "b", 16.0)
    assert sorted((r["aid"], r["bid"]) for r in inside.collect()) == sorted((k % 2, k) for k in range(3000))


def test_boxes_in_others_that_come_first_take_no_part(spark):
    b = spark.createDataFrame([(3, 0.0, 0.0, 10.0, 10.0), (5, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 5.0, 5.0), (4, 1.0, 1.0, 5.0, 5.0), (9, 8.0, 8.0, 12.0, 12.0), (7, 20.0, 0.0, None, 1.0)], f"bid long, {BOX}")
    left = {r["bid"] for r in spatial.uncovered(b, "b", ["bid"], 16.0).collect()}
    assert left >= {2, 3, 9} and not left & {4, 5}
    a = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 4.0, 4.0, 7.0, 7.0), (3, 50.0, 50.0, 51.0, 51.0)], "aid long, axmin double, aymin double, axmax double, aymax double")
    got = {r["aid"]: (r["bid"], r["overlap_m2"]) for r in spatial.best_overlap(a, b, "a", "b", 16.0, ["aid"], ["bid"]).collect()}
    assert got == {1: (2, 1.0), 2: (3, 9.0), 3: (None, None)}


def test_permits_meet_one_parcel_of_a_number(spark):
    permits = spark.createDataFrame([(1, "c", "A", "7", None, None)], "num_permis long, code_commune string, section string, numero string, x double, y double")
    parcels = spark.range(500).select(F.lit("c").alias("code_insee"), F.lit("A").alias("section"), F.lit("7").alias("numero"), (500 - F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y"))
    found = lookups.locate_permits(permits, parcels)
    assert [(r["x"], r["y"]) for r in found.collect()] == [(1.0, 0.0)]
    assert "BroadcastExchange" not in plan_of(found.select("x")).split("Generate")[0]


def test_parcels_in_others_of_no_larger_code_decide_nothing(spark):
    objects = spark.createDataFrame([(1, 2.0, 2.0, "z"), (2, 8.0, 8.0, None), (3, 40.0, 2.0, "z")], "id long, x double, y double, code_insee string")
    rows = [("b", 0.0, 0.0, 10.0, 10.0), ("b", 1.0, 1.0, 5.0, 5.0), ("a", 1.0, 1.0, 5.0, 5.0), (None, 0.0, 0.0, 10.0, 10.0), ("c", 7.0, 7.0, 9.0, 9.0)]
    parcels = spark.createDataFrame(rows, "code_insee string, pxmin double, pymin double, pxmax double, pymax double")
    found = {r["id"]: (r["code_insee"], r["changed"]) for r in lookups.assign_commune(objects, parcels, ["id"], 16.0).collect()}
    assert found == {1: ("a", True), 2: ("b", True), 3: ("z", False)}


def test_shapes_meet_in_blocks(spark):
    """Every pair comes once, in blocks and cells of any number, and no shape travels to the kernel for each pair."""
    ring = lambda w, h: F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (w, 0), (w, h), (0, h))])
    box = lambda p, w, h: [F.col("x").alias(p + "xmin"), F.col("y").alias(p + "ymin"), (F.col("x") + w).alias(p + "xmax"), (F.col("y") + h).alias(p + "ymax"), F.array(ring(w, h)).alias(p + "polygon")]
    at = lambda n, k: spark.range(n).select("id", (F.col("id") * k % 19).cast("double").alias("x"), (F.col("id") * 3 % 23).cast("double").alias("y"))
    a, b = at(300, 7).select(F.col("id").alias("aid"), *box("a", 3, 2)), at(250, 5).select(F.col("id").alias("bid"), *box("b", 4, 9))
    a = a.union(spark.createDataFrame([(900, 0.0, 0.0, 9.0, 9.0, None), (901, None, 0.0, 9.0, 9.0, None)], "aid long, axmin double, aymin double, axmax double, aymax double, apolygon array<array<struct<x:double,y:double>>>"))
    flat = lambda df, p: df.filter(F.col(p + "polygon").isNotNull()).drop(p + "polygon")
    want = sorted((r["aid"], r["bid"], r["m2"]) for r in spatial.overlap_join(flat(a, "a"), flat(b, "b"), "a", "b", 4.0, 2.0, "m2").collect())
    found = spatial.shape_overlaps(a, b, "a", "b", 4.0, 2.0, "m2")
    assert want and want == sorted((r["aid"], r["bid"], r["m2"]) for r in found.collect()) and found.columns == ["aid", "bid", "m2"]
    plan = plan_of(found)
    assert "BroadcastExchange" not in plan and plan.index("Generate explode") < plan.index("ArrowEvalPython") < plan.index("SortMergeJoin")
    best = lambda exact: {r["aid"]: (r["bid"], r["m2"]) for r in spatial.best_overlap(a if exact else flat(a, "a"), b if exact else flat(b, "b"), "a", "b", 4.0, ["aid"], ["bid"], "m2", exact).collect() if r["bid"] is not None}
    assert best(True) == best(False)


def test_boxes_are_put_where_they_can_meet(spark):
    """A box whose level is finer than all of the other side isn't put into cells of its own level."""
    a, b = crowd(spark)
    small = a.select("aid", F.col("axmin"), F.col("aymin"), (F.col("axmin") + 1).alias("axmax"), (F.col("aymin") + 1).alias("aymax"))
    one, _ = spatial._both_cells(small, b, "a", "b", 2.0, None)
    assert {r["_level"] for r in one.collect()} == {3}
