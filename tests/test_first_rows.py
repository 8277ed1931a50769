"""Limits that no task or driver holds whole."""

import inspect

from pyspark.sql import functions as F

from orrery.operators import object_store, store


def test_first_rows_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(store, "FEW", 10)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 2 == 0).alias("even"))
    for n in (5, 333, 1000, 2000):
        assert sorted(r.k for r in store.first_rows(df, n, [F.col("k")]).collect()) == list(range(min(n, 1000)))
    want = sorted(((r.even, r.k) for r in df.collect()), key=lambda x: (not x[0], x[1]))[:700]
    assert sorted((r.even, r.k) for r in store.first_rows(df, 700, [F.desc("even"), F.col("k")]).collect()) == sorted(want)


def test_fulfilment_keeps_ids_off_the_driver():
    """a round's ids and those asked for stay in tables; the driver collects a row a bucket only."""
    told = inspect.getsource(object_store.fulfil)
    assert told.count(".collect()") == 1 and "createDataFrame([(" not in told and not hasattr(object_store.Coverage(), "gaps")
