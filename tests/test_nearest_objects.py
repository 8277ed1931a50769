"""Datasets around targets without matches being written: the rows of all matches."""

import random

import pytest

from orrery.operators import groups, objects, search


@pytest.mark.parametrize("near_bytes", [groups.NEAR_BYTES, 1200])
def test_each_source_once(spark, monkeypatch, near_bytes):
    """objects by their numbers, sources that don't count, equally near targets, keys that repeat, crowded spots."""
    rng = random.Random(3)
    spot = lambda: (rng.randrange(300) / 3600, 10 + rng.randrange(300) / 3600)
    targets = spark.createDataFrame([(i, *spot()) for i in range(60)], "target_id long, t_ra double, t_dec double")
    rows = [(f"c{i % 3}", i % 190, *spot(), rng.choice([1.0, 5.0, None]), float(rng.randrange(-3, 9))) for i in range(200)]
    sources = spark.createDataFrame(rows, "catalog string, source_id long, ra double, dec double, error_arcsec double, balance double")
    request = search.Search(radius_arcsec=30.5, min_confidence=0.0, count_threshold=3, filters={"min_balance": 0})
    assert objects._by_nearest(targets, sources, request)
    monkeypatch.setattr(groups.nearest_objects, "__defaults__", (near_bytes,))
    asked = []
    crossmatch = search.crossmatch
    expected = objects._once(targets, sources, request)
    monkeypatch.setattr(search, "crossmatch", lambda t, *a: asked.append(t.count()) or crossmatch(t, *a))
    found = objects._once_by_nearest(targets, sources, request)
    told = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select("catalog", "source_id", "target_id", "ra", "object", "separation", "confidence").collect())
    assert told(found) == told(expected) and found.columns == expected.columns and found.count() > 50
    assert not asked if near_bytes == groups.NEAR_BYTES else 0 < asked[0] < 60


def test_what_goes_by_all_matches(spark):
    """A request that asks for a match's own separation, wide errors and targets of one id."""
    targets = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.001, 10.0)], "target_id long, t_ra double, t_dec double")
    sources = spark.createDataFrame([("a", 1, 0.0, 10.0, 1.0)], "catalog string, source_id long, ra double, dec double, error_arcsec double")
    asked = lambda **kw: search.Search(radius_arcsec=30.5, **({"min_confidence": 0.0} | kw))
    assert objects._by_nearest(targets, sources, asked())
    for request in (asked(min_confidence=0.5), asked(max_results=3), asked(adaptive=True), asked(zones=((0.0, 3.0),)), asked(filters={"max_separation": 3})):
        assert not objects._by_nearest(targets, sources, request)
    assert not objects._by_nearest(targets.unionByName(targets), sources, asked())
    assert not objects._by_nearest(targets, sources.replace(1.0, 99.0, "error_arcsec"), asked())
