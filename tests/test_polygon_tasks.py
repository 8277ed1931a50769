"""Points against polygons that tasks hold: no row for each pair that shares a cell."""

import random

from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import spatial


def test_polygons_are_held_in_tasks(spark):
    """corners of several numbers, a point's own columns whatever their names, the wrap; no join of points with polygons makes pairs."""
    rng = random.Random(2)
    shapes = [[((rng.choice([0, 359.9]) + rng.random() / 5 - 0.05), rng.random() / 5) for _ in range(rng.choice([3, 4, 20]))] for _ in range(25)]
    polygons = spark.createDataFrame(list(enumerate(shapes)), "polygon_id long, vertices array<struct<ra:double,dec:double>>")
    rows = [(f"p{i}", (359.9 + rng.random() / 4) % 360, rng.random() / 5, [i]) for i in range(400)] + [("nowhere", None, 0.1, None)]
    points = spark.createDataFrame(rows, "row string, ra double, dec double, side array<int>")
    found = spatial.in_polygons(points, polygons)
    assert found.columns == ["row", "ra", "dec", "side", "polygon_id"]
    pairs = None
    for k, shape in enumerate(shapes):
        own = points.where(exprs.valid_position(F.col("ra"), F.col("dec")) & exprs.inside_polygon(F.col("ra"), F.col("dec"), shape)).withColumn("polygon_id", F.lit(k).cast("long"))
        pairs = own if pairs is None else pairs.unionByName(own)
    want = sorted(map(repr, pairs.collect()))
    assert sorted(map(repr, found.collect())) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("LeftSemi" in line for line in joins)
