"""The sky index against brute force: numbers, covers, files read, crowded cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import sky_index
from orrery.operators.sky_index import SkyIndex


def separation(ra1, dec1, ra2, dec2):
    ra1, dec1, ra2, dec2 = map(np.radians, (ra1, dec1, ra2, dec2))
    a = np.sin((dec2 - dec1) / 2) ** 2 + np.cos(dec1) * np.cos(dec2) * np.sin((ra2 - ra1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, a)))) * 3600


@pytest.fixture(scope="module")
def sky():
    """Points over the whole sky, and close to poles, the wrap, and edges and corners of the cube's faces."""
    rng = np.random.default_rng(5)
    ra, dec = rng.uniform(0, 360, 4000), np.degrees(np.arcsin(rng.uniform(-1, 1, 4000)))
    spots = [(0, 90), (0, -90), (0, 0), (45, 0), (45, 35.26439), (135, -35.26439), (180, 45), (359.9999, 10), (0.0001, 10), (90, 45)]
    for r, d in spots:
        d2 = np.clip(d + rng.normal(0, 20 / 3600, 60), -90, 90)
        ra, dec = np.append(ra, (r + rng.normal(0, 20 / 3600, 60) / np.maximum(1e-5, np.cos(np.radians(d2)))) % 360), np.append(dec, d2)
    return ra, dec, spots


def test_cones_are_brute_force_and_read_their_files(spark, sky, tmp_path):
    ra, dec, spots = sky
    df = spark.createDataFrame([(i, float(r), float(d)) for i, (r, d) in enumerate(zip(ra, dec))] + [(-1, None, 1.0), (-2, 1.0, 95.0)], "id long, ra double, dec double")
    index = SkyIndex.write(df, str(tmp_path / "s"), rows_per_file=150)
    assert len(index.files) > 25 and sum(f.rows for f in index.files) == len(ra) + 2
    few = 0
    for (r, d), radius in [(s, q) for s in spots for q in (15.0, 4000.0)] + [((10.0, 20.0), 180 * 3600.0), ((200.0, -70.0), 40000.0)]:
        files = index.files_of(sky_index.cover(r, d, radius))
        want = set(np.flatnonzero(separation(r, d, ra, dec) <= radius).tolist())
        if radius != 4000.0 or r == 45:
            assert {x.id for x in index.cone(float(r), float(d), radius).select("id").collect()} == want
        few += radius == 15.0 and len(files) <= 5
        assert radius < 10**5 or len(files) >= len(index.files) - 1
    assert few == len(spots)
    rows = index.cone(0.0, 0.0, 15.0)
    assert len(rows.inputFiles()) <= 5 and "PushedFilters: [Or" in rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert index.cone(300.0, 80.0, 0.001).collect() == []


def test_joins_are_brute_force(spark, sky, tmp_path):
    ra, dec, spots = sky
    df = spark.createDataFrame([(i, float(r), float(d)) for i, (r, d) in enumerate(zip(ra, dec))], "id long, ra double, dec double")
    index = SkyIndex.write(df, str(tmp_path / "s"), rows_per_file=150)
    targets = spark.createDataFrame([(k, float(r), float(d)) for k, (r, d) in enumerate(spots[:6])] + [(99, None, 0.0)], "target_id long, t_ra double, t_dec double")
    got = {(r.target_id, r.id) for r in index.join(targets, 30.0).collect()}
    assert got == {(k, int(i)) for k, (r, d) in enumerate(spots[:6]) for i in np.flatnonzero(separation(r, d, ra, dec) <= 30.0)}
    one = spark.createDataFrame([(10.0, 20.0)], "t_ra double, t_dec double")
    assert len(index.files_of(sky_index.around(one, 30.0))) <= 3 and len(index.files_of(sky_index.around(targets, 30.0))) < len(index.files)
    assert index.join(targets.limit(0), 30.0).collect() == []


def test_cells_nest_and_covers_hold_their_cells(spark, sky):
    ra, dec, _ = sky
    df = spark.createDataFrame([(float(r), float(d)) for r, d in zip(ra, dec)], "ra double, dec double")
    cells = np.array([r.c for r in sky_index.with_cell(df, F.col("ra"), F.col("dec"), "c").collect()])
    assert cells.min() >= 0 and cells.max() < 6 << 2 * sky_index.LEVEL
    for k in range(0, len(ra), 97):
        for radius in (0.5, 60.0, 20000.0):
            ranges = sky_index.cover(float(ra[k]), float(dec[k]), radius)
            near = cells[separation(ra[k], dec[k], ra, dec) <= radius]
            at = np.searchsorted([b for _, b in ranges], near, "right")
            assert len(ranges) <= sky_index.MOST_RANGES and all(ranges[i][0] <= c < ranges[i][1] for i, c in zip(at, near))


def test_a_crowded_place_is_many_files(spark, tmp_path):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2000, 7.0).otherwise(F.col("id") % 360).cast("double").alias("ra"), F.when(F.col("id") < 2000, 7.0).otherwise(F.col("id") % 90).cast("double").alias("dec"))
    index = SkyIndex.write(df, str(tmp_path / "s"), rows_per_file=200)
    files = index.files_of(sky_index.cover(7.0, 7.0, 1.0))
    assert 8 <= len(files) <= 13 and max(f.rows for f in index.files) < 500
    assert index.cone(7.0, 7.0, 1.0).count() >= 2000
    assert SkyIndex.write(df.limit(0), str(tmp_path / "e")).cone(1.0, 1.0, 10.0).collect() == []
