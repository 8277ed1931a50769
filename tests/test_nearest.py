"""Nearest matches within growing radii, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import spatial

R = 60.5


@pytest.fixture(scope="module")
def sky(spark):
    rng = np.random.default_rng(3)
    place = lambda n: [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 0.08, n), rng.uniform(10, 10.08, n), strict=True))]
    targets = spark.createDataFrame([*place(40), (99, 0.5, 10.5)], "target_id long, t_ra double, t_dec double").cache()
    sources = spark.createDataFrame([(*p, None if p[0] % 7 == 0 else "rare" if p[0] % 50 == 1 else "abc"[p[0] % 3]) for p in place(600)], "source_id long, ra double, dec double, catalog string").cache()
    return targets, sources


def _rows(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_cone_join_is_dealt_to_many_tasks(sky):
    """Few bytes, many pairs; without it they were one task. Chords come before separations."""
    plan = spatial.cone_join(*sky, R)._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "__xl" in plan


def test_nearest_matches(sky):
    """F6, F7."""
    targets, sources = sky
    order = [F.col("separation"), F.col("source_id")]
    want = spatial.top_matches(spatial.cone_join(targets, sources, R), 3, ["target_id", "catalog"], order)
    assert len(spatial.growing_radii(sources, ("ra", "dec"), R, 1.0)) > 1
    for radii in ([R / 8, R / 4, R / 2, R], None):
        got = spatial.nearest_matches(targets, sources, R, 3, "target_id", ["catalog"], order, radii)
        assert _rows(got, "target_id", "catalog", "source_id", "separation", "rank") == _rows(want, "target_id", "catalog", "source_id", "separation", "rank")


def test_adaptive_join(sky):
    """F4."""
    targets, sources = sky
    order = [F.col("separation"), F.col("source_id")]
    want = spatial.adaptive(spatial.cone_join(targets, sources, R), "target_id", order, R)
    got = spatial.adaptive_join(targets, sources, R, "target_id", order, [R / 8, R / 2, R])
    assert _rows(got, "target_id", "source_id", "separation", "effective_radius") == _rows(want, "target_id", "source_id", "separation", "effective_radius")


def test_nearest_target(sky):
    """F17."""
    targets, sources = sky
    want = spatial.cone_join(targets, sources, R).groupBy("source_id").agg(F.min("separation").alias("separation"))
    got = spatial.nearest_target(targets, sources, R, "source_id", [R / 8, R / 4, R])
    assert _rows(got, "source_id", "separation") == _rows(want, "source_id", "separation")
