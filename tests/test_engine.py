"""Operators that the driver's tables don't reach: moving sources, errors that aren't numbers, deliveries, light curves, dataset requests."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import objects, search, signals, spatial
from orrery.sources import exports, tables


def test_fast_sources_are_found_where_they_are(spark):
    sources = spark.createDataFrame([(1, 10.0, 20.0, 2000.0, 0.0, 100_000.0), (2, 10.0, 20.0, None, 5.0, 5.0), (3, 10.0, 20.0, 2000.0, float("nan"), 1.0)], "source_id long, ra double, dec double, epoch double, pmra double, pmdec double")
    targets = spark.createDataFrame([(1, 10.0, 20.0, 2000.0), (2, 10.0, 20.0 + 1600 / 3600, 2016.0), (3, 10.0, 20.0, None)], "target_id long, t_ra double, t_dec double, t_epoch double")
    got = sorted((r.target_id, r.source_id) for r in spatial.moving_cone_join(targets, sources, 2.0).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2), (3, 3)]


def test_errors_that_are_no_numbers_widen_nothing(spark):
    at = lambda k, arcsec, error: (1, k, 10.0, 10 + arcsec / 3600, error)
    rows = [at("a", 0, float("nan")), at("b", 3, 1.0), at("c", 5, 1.0), at("d", 100, 200.0), at("e", 5000, None)]
    edges = spatial.pair_edges(spark.createDataFrame(rows, "t long, k string, ra double, dec double, error_arcsec double"), "t", "k", 2.5).collect()
    assert sorted((r.a, r.b) for r in edges) == [("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]


@pytest.mark.parametrize("x", [0.0, 1.0, 12.3456, 0.000123456, 0.0000123456, 999.6, 123456.0, 5.0e-7, 0.1, 9.996, 100.0, 0.09996])
def test_significant_digits_are_pythons(spark, x):
    assert spark.range(1).select(exprs.significant(F.lit(x))).first()[0] == f"{x:.3g}"


def test_summaries_name_the_nearest_candidates(spark):
    m = spark.createDataFrame([(1, "gaia", k, "optical", 0.5 + k, 0) for k in range(7)], "target_id long, catalog string, source_id long, wavelength string, separation double, object long")
    told = search.summaries(search.records(m), F.lit("X"), F.lit("1"), F.lit("2")).first()
    assert told.status == "complete" and told.text == "X: RA 1 deg, Dec 2 deg. Queried 1 catalogs; returned 7 candidate counterparts. 0 catalog queries failed." + "".join(f" Candidate {k} in gaia lies {0.5 + k:.3g} arcsec from the query position." for k in range(5))


def test_dataset_requests():
    ok = objects.DatasetRequest("d", count=5, fields=("gaia_dr3.parallax", "mass"), filters=(("min_gaia_dr3.parallax", 1),))
    assert ok.problems({"gaia_dr3"}) == [] and len(ok.problems({"sdss"})) == 1 and len(ok.problems(set())) == 2
    assert [len(r.problems()) for r in (objects.DatasetRequest(" ", targets=((0.0, 0.0),)), objects.DatasetRequest("d"), objects.DatasetRequest("d", count=1, max_results=2), objects.DatasetRequest("d", count=1, fields=("a b",)), objects.DatasetRequest("d", targets=((0.0, 91.0),), fields=("x",)))] == [1, 1, 1, 1, 2]


def test_layered_values(spark):
    maps = [F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))]
    assert spark.range(1).select(exprs.layered(*maps)).first()[0] == {"a": "1", "b": None, "c": "3"}


def observations(spark, rows):
    return spark.createDataFrame(
        [(i, "", "", kind, 10.0, 10.0, axis, values, [None] * len(axis), [0] * len(axis)) for i, kind, axis, values in rows],
        "observation_id string, object_id string, title string, modality string, ra double, dec double, axis array<double>, `values` array<double>, uncertainties array<double>, quality array<long>",
    ).withColumns({c: F.lit(None).cast("string") for c in ("instrument", "band", "observed_at", "source_url")})


def test_deliveries_are_committed_once(spark, tmp_path):
    axis = [float(x) for x in range(1, 30)]
    wave = [math.sin(x) for x in axis]
    obs = observations(spark, [("a", "light_curve", axis, wave), ("a", "light_curve", axis, wave), ("b", "spectrum", axis, [x * x for x in axis]), ("c", "spectrum", axis, [1.0] * len(axis)), ("d", "spectrum", axis[:3], wave[:3])])
    refs = spark.createDataFrame([("r", 10.0, 10.0, "light_curve", [1.0] * 48)], "catalog_id string, ra double, dec double, modality string, vector array<double>")
    first = signals.commit(str(tmp_path), obs, refs)
    assert first["changed"] and first["observations"] == 4 and sum(first["statuses"].values()) == 2 and first["rejected"] == {"constant_values": 1, "too_few_samples": 1}
    assert not signals.commit(str(tmp_path), obs.repartition(3), refs)["changed"]
    assert json.loads((tmp_path / "latest.json").read_text())["fingerprint"] == first["fingerprint"]
    rows = spark.read.option("header", True).csv(str(tmp_path / first["fingerprint"])).collect()
    assert sorted(r.catalog_id for r in rows) == ["observation:a", "observation:b"] and all(len(json.loads(r.representation)) == 48 for r in rows)
    with pytest.raises(ValueError, match="different contents"):
        signals.commit(str(tmp_path), obs.unionByName(observations(spark, [("a", "light_curve", axis, axis)])), refs)
    with pytest.raises(ValueError, match="without observations"):
        signals.commit(str(tmp_path), obs.limit(0), refs)


def test_spectra_go_by_the_logarithm_of_their_axis(spark):
    rows = [("a", k, float(k + 1), "spectrum") for k in range(3)] + [("b", k, float(k), "spectrum") for k in range(3)] + [("c", k, float(k + 1), "light_curve") for k in range(3)]
    got = signals.logarithmic_axis(spark.createDataFrame(rows, "signal_id string, pos int, axis double, modality string")).collect()
    assert all(abs(r.axis - (math.log(r.pos + 1) if r.signal_id == "a" else r.pos + (r.signal_id == "c"))) < 1e-12 for r in got)


def curve(names=("TIME", "PDCSAP_FLUX", "PDCSAP_FLUX_ERR", "QUALITY"), header=None):
    columns = [np.array([1.0, np.nan]), np.array([2.0, 3.0]), np.array([0.1, np.nan]), np.array([0, 4])]
    return tables.write_fits(list(names), columns, {"TICID": 7, "SECTOR": 3, "RA_OBJ": 1.5, "DEC_OBJ": -2.0, "BJDREFI": 2457000, "BJDREFF": 0.5} if header is None else header)


def test_light_curves(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(curve())
    (tmp_path / "b.fits").write_bytes(curve(("TIME", "FLUX", "PDCSAP_FLUX_ERR", "QUALITY")))
    (tmp_path / "c.fits").write_bytes(curve(header={"TICID": 7}))
    (tmp_path / "d.fits").write_bytes(b"x")
    good, bad = tables.light_curves(spark, str(tmp_path))
    r = good.collect()
    assert len(r) == 1 and (r[0].observation_id, r[0].ra, r[0].time_reference) == ("tess-sector-3-tic-7-pdcsap_flux", 1.5, 2457000.5)
    assert (r[0].axis, r[0]["values"], r[0].uncertainties, r[0].quality) == ([1.0, None], [2.0, 3.0], [0.1, None], [0, 4])
    assert sorted(x.file for x in bad.collect()) == ["b.fits", "c.fits", "d.fits"]
    with pytest.raises(tables.TableError):
        tables.light_curve(curve(), "flux")
    assert tables.light_curve(curve(), uri="mast:x", version="1")["observation_id"].startswith("tess-product-")


def test_folders_of_fits_tables_with_different_columns(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(tables.write_fits(["x"], [np.array([1, 2])]))
    (tmp_path / "b.fits").write_bytes(tables.write_fits(["x", "y"], [np.array([0.5]), np.array(["t"])]))
    tables.register(spark)
    assert sorted((r.x, str(r.y)) for r in spark.read.format("fits").load(str(tmp_path)).collect()) == [(0.5, "t"), (1.0, "None"), (2.0, "None")]


def test_scaled_fits_columns():
    data = tables.write_fits(["u"], [np.array([1, -5, 2])])
    at = data.index(b"TFORM1")
    cards = b"TZERO1  =                  100".ljust(80) + b"TNULL1  =                   -5".ljust(80)
    data = data[: at + 80] + cards + data[at + 80 : len(data)].replace(b" " * 160, b"", 1)
    assert tables.parse_fits(data)[2] == [[101, None, 102]]


def test_parts_are_bounded_by_bytes(spark, tmp_path):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), 100).alias("t")).coalesce(1)
    manifest = exports.materialize(df, str(tmp_path / "d"), "csv", policy=exports.Policy(part_bytes=100_000))
    assert len(manifest["parts"]) >= 4 and all(p["bytes"] <= 110_000 for p in manifest["parts"]) and manifest["rows"] == 4000
    assert exports.read_back(spark, str(tmp_path / "d")).count() == 4000


def test_components_of_large_and_small_targets(spark):
    """Union-find in a task and labels that pass along edges give the same roots."""
    rng = np.random.default_rng(6)
    edges = {(int(t), *sorted((f"k{a}", f"k{b}"))) for t in range(4) for a, b in rng.integers(0, 40, (25, 2)) if a != b}
    nodes = [(t, f"k{k}") for t in range(4) for k in range(40)] + [(None, "k1")]
    n, e = spark.createDataFrame(nodes, "t long, key string"), spark.createDataFrame(sorted(edges), "t long, a string, b string")
    told = [sorted(map(str, spatial.group_labels(n, e, "t", "key", few=few).collect())) for few in (1000, 64)]
    assert told[0] == told[1] and len(told[0]) == 161
    assert spatial.group_labels(n.limit(0), e.limit(0), "t", "key").collect() == []


def test_errors_and_motions_of_many_sizes(spark):
    """Rows with errors of several octaves, and sources that move by several, against brute force."""
    rng = np.random.default_rng(8)
    rows = [(1, k, float(rng.uniform(0, 0.2)), float(rng.uniform(0, 0.2)), float(rng.choice([0.5, 3.0, 20.0, 90.0, 400.0, float("nan")]))) for k in range(120)]
    m = spark.createDataFrame(rows, "t long, key long, ra double, dec double, error_arcsec double")
    sep = lambda a, b: np.degrees(2 * np.arcsin(np.sqrt(np.sin(np.radians(b[3] - a[3]) / 2) ** 2 + np.cos(np.radians(a[3])) * np.cos(np.radians(b[3])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2))) * 3600
    bound = lambda a, b: max(10.0, *(x[4] for x in (a, b) if x[4] == x[4]), 0.0)
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and sep(a, b) <= bound(a, b))
    assert sorted((r.a, r.b) for r in spatial.pair_edges(m, "t", "key", 10.0).collect()) == want and len(want) > 20
    s = spark.createDataFrame([(k, 10.0, 10.0, 2000.0, pm, 0.0) for k, pm in enumerate([0.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e9])], "source_id long, ra double, dec double, epoch double, pmra double, pmdec double")
    t = spark.createDataFrame([(1, 10.0 + 16 * 1e4 / 3.6e6 / math.cos(math.radians(10.0)), 10.0, 2016.0), (2, 10.0, 10.0, 2016.0)], "target_id long, t_ra double, t_dec double, t_epoch double")
    assert {(r.target_id, r.source_id) for r in spatial.moving_cone_join(t, s, 5.0).collect()} == {(1, 3), (2, 0), (2, 1)}


def test_catalogs_fail_and_come_late_on_their_own(spark):
    """One catalog of four raises when it is planned, one while it is read, one is too slow."""
    def slow(batches):
        import time

        time.sleep(100)
        yield from batches

    reads = {
        "good": lambda: spark.range(5).select("id"), "other": lambda: spark.range(3).select("id", F.lit("x").alias("name")), "plan": lambda: spark.table("there_is_none"),
        "row": lambda: spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), "late": lambda: spark.range(1).coalesce(1).mapInArrow(slow, "id long"),
    }
    found, failures = search.read_isolated(spark, reads, timeout=40)
    assert {r.catalog: r["count"] for r in found.groupBy("catalog").count().collect()} == {"good": 5, "other": 3} and "name" in found.columns
    told = {r.catalog: (r.error, r.message) for r in failures.collect()}
    assert told.keys() == {"plan", "row", "late"} and told["late"][0] == "timeout" and "broken" in told["row"][1]


def test_points_in_a_table_of_polygons(spark):
    """Polygons of all sizes, across the wrap and near the poles, against the expression for one polygon at a time."""
    rng = np.random.default_rng(11)
    polygons = []
    for k in range(40):
        size = float(10 ** rng.uniform(-3, 1.6))
        ra, dec = float(rng.choice([0.0, 359.9, 120.0, 200.0])), float(rng.uniform(-89 + min(size, 80), 89 - min(size, 80)))
        turns = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 7))))
        polygons.append((k, [(float((ra + size * np.cos(t)) % 360), float(np.clip(dec + size * np.sin(t), -90, 90))) for t in turns]))
    polygons += [(98, [(0.0, 0.0), (100.0, 10.0), (200.0, 0.0), (300.0, 50.0)]), (99, [(1.0, 1.0), (2.0, 2.0)])]
    near = [(float(r + rng.normal() * 0.01) % 360, float(np.clip(d + rng.normal() * 0.01, -90, 90))) for _, v in polygons for r, d in v]
    spots = near + [(float(a), float(b)) for a, b in zip(rng.uniform(0, 360, 300), rng.uniform(-90, 90, 300))]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(-1, None, 0.0)], "id long, ra double, dec double")
    table = spark.createDataFrame(polygons, "polygon_id long, vertices array<struct<ra:double,dec:double>>")
    got = sorted((r.id, r.polygon_id) for r in spatial.in_polygons(points, table).collect())
    flags = points.where("id >= 0").select("id", *(exprs.inside_polygon(F.col("ra"), F.col("dec"), v).alias(f"p{k}") for k, v in polygons[:-1])).collect()
    want = sorted((r.id, k) for r in flags for k, _ in polygons[:-1] if r[f"p{k}"])
    assert set(got) == set(want) and len(got) == len(want) > 60, [(spots[i], polygons[k] if k < 98 else k, (i, k) in got) for i, k in set(got) ^ set(want)]
    assert spatial.in_polygons(points, table.limit(0)).collect() == []
