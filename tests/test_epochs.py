"""Sources moved once an epoch meet the targets that they meet by octaves of their motion."""

import random

from orrery.operators import search, spatial


def test_few_epochs_as_many(spark, monkeypatch):
    """unknown and several epochs, sources that don't move, wild motions; one join, no grid of a motion's reach."""
    rng = random.Random(5)
    spot = lambda: (rng.randrange(200) / 3600, 10 + rng.randrange(200) / 3600)
    targets = spark.createDataFrame([(i, *spot(), rng.choice([2016.0, 2000.0, None, float("nan")])) for i in range(40)], "target_id long, t_ra double, t_dec double, t_epoch double")
    rows = [(i, *spot(), rng.choice([1990.0, 2001.5, None]), rng.choice([0.0, 900.0, -3e4, None]), rng.choice([0.0, 400.0, 2e4])) for i in range(150)] + [(900, 0.0, 95.0, 1990.0, 1.0, 1.0)]
    sources = spark.createDataFrame(rows, "source_id long, ra double, dec double, epoch double, pmra double, pmdec double")
    told = lambda df: sorted(map(repr, df.collect()))
    by_octaves = spatial.moving_cone_join(targets, sources, 25.5, 0)
    radii, joined = [], spatial.cone_join
    monkeypatch.setattr(spatial, "cone_join", lambda t, s, r, *a, **kw: radii.append(r) or joined(t, s, r, *a, **kw))
    by_epochs = spatial.moving_cone_join(targets, sources, 25.5)
    assert radii == [25.5]
    assert by_epochs.columns == by_octaves.columns and told(by_epochs) == told(by_octaves) and by_epochs.count() > 50


def test_matches_without_objects_are_not_written(spark, monkeypatch):
    targets = spark.createDataFrame([(1, 0.0, 10.0)], "target_id long, t_ra double, t_dec double")
    sources = spark.createDataFrame([("a", 1, 0.0, 10.0, 1.0)], "catalog string, source_id long, ra double, dec double, error_arcsec double")
    with_objects = search.crossmatch(targets, sources, search.Search())
    monkeypatch.setattr(search, "cut", lambda *_: 1 / 0)
    assert search.crossmatch(targets, sources, search.Search(), objects=False).select("target_id", "source_id", "confidence").collect() == with_objects.select("target_id", "source_id", "confidence").collect()
