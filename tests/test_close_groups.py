"""Components by cells against those of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import spatial


@pytest.mark.parametrize("few", [1000, 100])
def test_close_groups(spark, monkeypatch, few):
    """clusters, chains, copies of a place, a key seen twice, wide errors; no pairs for targets of narrow errors."""
    rng = np.random.default_rng(8)
    rows = []
    for t in range(6):
        n = 150 if t == 2 else 70
        spots = rng.uniform(0, 90, (n, 2)) / 3600 + (0.0, 60.0)
        rows += [(t, f"k{i}", float(a * 2) % 360, float(d), 30.0 if t == 5 and i % 9 == 0 else float("nan") if i % 4 == 0 else 1.0) for i, (a, d) in enumerate(spots)]
        rows += [(t, "chain%d" % i, 359.99 + i * 0.0027, 89.0 - i * 1e-6, None) for i in range(9)] + [(t, "k0", 10.0, 10.0, 1.0), (t, "z", 10.0, 10.0, 1.0)]
    m = spark.createDataFrame(rows, "t long, key string, ra double, dec double, error_arcsec double")
    want = sorted(map(str, spatial.group_labels(m, spatial.pair_edges(m, "t", "key", 5.0), "t", "key").collect()))
    paired = []
    pairs = spatial.pair_edges
    monkeypatch.setattr(spatial, "pair_edges", lambda rows, *a: paired.extend(r.t for r in rows.select("t").distinct().collect()) or pairs(rows, *a))
    got = sorted(map(str, spatial.close_groups(m, "t", "key", 5.0, few).collect()))
    assert got == want and 20 < len({r.split("root=")[1] for r in got}) < len(got)
    assert sorted(paired) == ([5] if few == 1000 else [2, 5])
