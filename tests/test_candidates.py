"""References near signals: ranked by tasks and by a window alike, rounded numbers."""

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import signals

SIGNAL, REFERENCE = "signal_id string, ra double, dec double, modality string, vector array<double>", "catalog_id long, ra double, dec double, modality string, vector array<double>"


def _sky(spark, n: int, seed: int, ids, schema: str):
    """Rows on a small lattice, some of them beyond the wrap, at a pole or nowhere, with vectors of all kinds."""
    rng = np.random.default_rng(seed)
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0, 0.0], [1.0, 1.0], [2.0, -1.0], [1e200, 1e200], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], [0.1] * 9]
    rows = []
    for k in range(n):
        ra, dec = float(rng.integers(0, 40)) / 3600, 10 + float(rng.integers(0, 40)) / 3600
        ra, dec = [(ra, dec), ((ra + 359.995) % 360, dec), (ra * 9000, 89.9999), (None, dec), (float("nan"), dec)][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.05, 0.05]))]
        rows.append((ids(k), ra, dec, [None, "spectrum", "light_curve"][rng.integers(0, 3)], vectors[rng.integers(0, len(vectors))]))
    return spark.createDataFrame(rows, schema)


def _told(df):
    return sorted((repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect()))


def test_candidates_without_and_with_pairs(spark):
    """tasks rank what a window over all pairs ranks, for ids that repeat and crowded places as well."""
    v = _sky(spark, 300, 1, lambda k: None if k % 97 == 0 else f"s{k % 290}", SIGNAL)
    r = _sky(spark, 700, 2, lambda k: None if k == 5 else k, REFERENCE)
    placed = lambda df: df.where(exprs.valid_position(F.col("ra"), F.col("dec")))
    # rows of one signal that are equally near to one reference have no order: those ids are held without their ranks
    once = v.groupBy("signal_id").count().where("count = 1").select("signal_id")
    for bound in (signals.NEAR_BYTES, 20_000, 0):
        found, pairs = signals.candidates(v, r, 12.5, near_bytes=bound), signals._by_pairs(placed(v), placed(r), 12.5, 0.25)
        assert found.schema.simpleString() == pairs.schema.simpleString()
        assert _told(found.join(once, "signal_id", "left_semi")) == _told(pairs.join(once, "signal_id", "left_semi"))
        assert _told(found.drop("rank")) == _told(pairs.drop("rank"))
        assert found.select("signal_id", "rank").distinct().count() == found.count() > 1000
    few = signals.candidates(v, r, 12.5, columns=("rank", "signal_id"))
    assert few.columns == ["rank", "signal_id"] and _told(few.join(once, "signal_id", "left_semi").select("rank", "signal_id")) == _told(found.join(once, "signal_id", "left_semi").select("rank", "signal_id"))


def test_candidates_shuffle_no_pairs(spark):
    """of one crowded place there are far more pairs than rows; the plan has no window over them, nor a join on the sky."""
    v = spark.range(50).select(F.col("id").alias("signal_id"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"), F.lit("x").alias("modality"), F.array(F.lit(1.0)).alias("vector"))
    r = spark.range(2000).select(F.col("id").alias("catalog_id"), F.lit(1.0).alias("ra"), F.lit(2.0).alias("dec"), F.lit("x").alias("modality"), F.array(F.lit(1.0)).alias("vector"))
    found = signals.candidates(v, r, 5.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    assert found.where("rank = catalog_id + 1 and separation = 0 and distance = 0 and supported").count() == 100_000
    assert signals.candidates(v, r.limit(0), 5.0).count() == signals.candidates(v.limit(0), r, 5.0).count() == 0


def test_rounded_is_round(spark):
    x = np.concatenate([np.random.default_rng(3).uniform(0, 100, 5000), np.arange(2000) / 2e6, np.nextafter(np.arange(1, 2000) / 2e6, 0), [-1.5e-6, 2.5e-6, 0.0, -0.0, 1e300, np.inf, np.nan, 4e15, 1.0000005, 0.1234565]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    assert df.where(~exprs.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0
