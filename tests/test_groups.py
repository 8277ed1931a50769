"""Components without pairs: the same as by pairs, for crowded spots, repeated keys and ids as well, and nothing written that grows with pairs."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import groups, spatial, store
from orrery.plans import catalog_queries

SF = "/root/testdata/sf0.01"


def _sky(spark, n, places, repeat):
    rng = random.Random(7)
    spot = lambda: (rng.randrange(places) / 3600, 10 + rng.randrange(places) / 3600)
    targets = [(i, *spot()) for i in range(n // 4)] + ([(1, *spot())] if repeat else [])
    sources = [(f"s{i % (n - 5 if repeat else n):03d}", *spot()) for i in range(n)]
    return spark.createDataFrame(targets, "target_id long, t_ra double, t_dec double"), spark.createDataFrame(sources, "key string, ra double, dec double")


@pytest.mark.parametrize(("repeat", "near_bytes", "link"), [(False, groups.NEAR_BYTES, 9.5), (True, groups.NEAR_BYTES, 9.5), (False, 9000, 4.5), (True, groups.NEAR_BYTES, 40.5)])
def test_groups_are_those_by_pairs(spark, repeat, near_bytes, link):
    targets, sources = _sky(spark, 300, 240, repeat)
    pairs = spatial.cone_join(targets, sources, 40.5).select("target_id", "key", "ra", "dec", F.lit(0.0).alias("error_arcsec"))
    expected = spatial.group_labels(pairs.select("target_id", "key").distinct(), spatial.pair_edges(pairs, "target_id", "key", link), "target_id", "key")
    found = groups.cone_groups(targets, sources, 40.5, "target_id", "key", link, near_bytes)
    assert sorted(map(tuple, found.select("target_id", "key", "root").collect())) == sorted(map(tuple, expected.select("target_id", "key", "root").collect()))


def test_no_detections_are_written(spark, tmp_path, monkeypatch):
    """what is written does not grow with pairs."""
    monkeypatch.setattr(store, "shared_folder", lambda _: str(tmp_path))
    assert catalog_queries.crossmatch_groups(spark, SF).count() == 799
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} == {"targets", "around", "reach"}
