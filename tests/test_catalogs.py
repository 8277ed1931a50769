"""Joins on the sky, identity, search, signals, sources, exports and streams on small tables."""

import itertools
import json
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.operators import catalogs, signals, spatial
from orrery.operators.search import Search, crossmatch, records
from orrery.plans import catalog_queries
from orrery.sources import exports, tables
from orrery.sources.catalogs import json_records, normalized, resolved, to_sources
from orrery.streaming import quota


def separation(a, b):
    (r1, d1), (r2, d2) = np.radians(a), np.radians(b)
    return np.degrees(2 * np.arcsin(np.sqrt(np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((r2 - r1) / 2) ** 2))) * 3600


def sky(n, seed):
    rng = np.random.default_rng(seed)
    ra = np.concatenate([rng.uniform(359.8, 360.2, n) % 360, rng.uniform(0, 360, n)])
    dec = np.concatenate([rng.uniform(-0.2, 0.2, n), rng.choice([-1, 1], n) * rng.uniform(89.8, 90, n)])
    return list(zip(ra.tolist(), dec.tolist()))


def test_cone_join_is_brute_force(spark):
    a, b = sky(60, 1), sky(80, 2)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "target_id long, t_ra double, t_dec double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)] + [(900, 1.0, 95.0)], "source_id long, ra double, dec double")
    got = {(r.target_id, r.source_id) for r in spatial.cone_join(left, right, 180.0).collect()}
    assert got == {(i, j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if separation(p, q) <= 180.0} and len(got) > 20
    plan = spatial.cone_join(left, right, 180.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_groups_are_transitive_and_errors_widen(spark):
    rows = [(1, k, ra / 3600, 0.0, e) for k, ra, e in (("a", 0, 0.0), ("b", 2, 0.0), ("c", 4, 0.0), ("d", 20, 6.0), ("e", 25, 0.0), ("f", 90, 0.0))] + [(2, "a", 0.0, 0.0, None)]
    m = spark.createDataFrame(rows, "target_id long, key string, ra double, dec double, error_arcsec double")
    got = {(r.target_id, r.key): r.root for r in spatial.group_labels(m, spatial.pair_edges(m, "target_id", "key", 2.5), "target_id", "key").collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "f", (2, "a"): "a"}


def test_identity_outcomes(spark):
    at = lambda s: s / 3600
    store = spark.createDataFrame([("gaia", "g1", at(0), 0.0, "o1"), ("gaia", "g2", at(100), 0.0, "o2"), ("wise", "w2", at(100.5), 0.0, "o3"), ("sdss", "s9", at(300), 0.0, "o4"), ("gaia", "g4", at(300.2), 0.0, "o4")], "catalog string, source_id string, ra double, dec double, object_id string")
    new = spark.createDataFrame([("sdss", "a", at(0.2), 0.0, 1), ("sdss", "b", at(0.3), 0.0, 2), ("sdss", "c", at(100.2), 0.0, 3), ("sdss", "d", at(999), 0.0, 4), ("sdss", "s9", at(300), 0.0, 5), ("sdss", "x", at(300.1), 0.0, 6)], "catalog string, source_id string, ra double, dec double, arrival long")
    got = {r.source_id: (r.outcome, r.object_id) for r in catalogs.resolve_identity(new, store).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "adopted", "b": "conflict", "c": "ambiguous", "d": "new", "s9": "known", "x": "conflict"}
    assert got["a"][1] == "o1" and got["s9"][1] == "o4" and len(got["d"][1]) == 32


def test_search(spark):
    targets = spark.createDataFrame([(1, 10.0, 20.0)], "target_id long, t_ra double, t_dec double")
    rows = [("gaia", f"g{k}", 10.0, 20 + k / 3600, 1.0, "star", 10.0, "optical") for k in range(4)] + [("wise", "w", 10.0, 20.0, None, "galaxy", None, "infrared")]
    sources = spark.createDataFrame(rows, "catalog string, source_id string, ra double, dec double, error_arcsec double, object_type string, parallax double, wavelength string")
    got = crossmatch(targets, sources, Search(radius_arcsec=3.5, min_confidence=0.0))
    assert sorted(r.source_id for r in got.collect()) == ["g0", "g1", "g2", "g3", "w"] and records(got).first().by_wavelength == {"optical": 4, "infrared": 1}
    names = lambda s: sorted(r.source_id for r in crossmatch(targets, sources, s).collect())
    assert names(Search(radius_arcsec=3.5, min_confidence=0.0, max_results=1)) == ["g0", "w"]
    assert names(Search(radius_arcsec=3.5, min_confidence=0.5)) == ["g0", "g1", "w"]
    assert names(Search(radius_arcsec=3.5, min_confidence=0.0, object_types=("G",))) == ["w"]
    assert names(Search(radius_arcsec=3.5, min_confidence=0.0, mode="shell", min_radius_arcsec=1.5)) == ["g2", "g3"]
    assert names(Search(radius_arcsec=3.5, min_confidence=0.0, mode="cylinder", max_distance_pc=150.0)) == ["g0", "g1", "g2", "g3"]
    assert names(Search(radius_arcsec=3.5, min_confidence=0.0, adaptive=True)) == ["g0", "g1", "w"]
    with pytest.raises(ValueError, match="radius must be positive"):
        crossmatch(targets, sources, Search(radius_arcsec=0))
    assert Search(mode="cylinder", zones=((0, 9),), min_confidence=2).problems() and Search().problems() == []


def vector_by_numpy(t, v):
    m = np.median(v)
    scale = 1.4826 * np.median(np.abs(v - m)) or v.std()
    z = (v - m) / scale
    x = (t - t.mean()) / (t[-1] - t[0])
    c, sd = z - z.mean(), z.std()
    stats = [z.mean(), sd, z.min(), z.max(), *np.quantile(z, [0.05, 0.25, 0.75, 0.95]), (c**3).mean() / sd**3, (c**4).mean() / sd**4 - 3, np.median(np.abs(np.diff(z) / np.diff(t))), np.polyfit(x, z, 1)[0]]
    b = np.minimum((((t - t[0]) / (t[-1] - t[0])) * 32).astype(int), 31)
    have = np.unique(b)
    bins = np.interp(np.arange(32), have, [np.median(z[b == k]) for k in have])
    lags = [np.corrcoef(z[:-k], z[k:])[0, 1] if len(z) > k + 1 else 0.0 for k in (1, 2, 4, 8)]
    out = np.concatenate([stats, bins, lags])
    return out / np.linalg.norm(out)


def test_signal_vectors(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for s in range(3):
        t = np.sort(rng.uniform(0, 10, 40 + s))
        v = np.sin(t) + 0.1 * rng.standard_normal(len(t)) + s
        expected[s] = vector_by_numpy(t, v)
        rows += [(s, k, float(a), float(b), None, 0) for k, (a, b) in enumerate(zip(t, v))] + [(s, 900, 5.0, 99.0, None, 1), (s, 901, 5.0, float("nan"), None, 0)]
    rows += [(7, k, float(k), 1.0, None, 0) for k in range(20)] + [(8, k, float(k), float(k), None, 0) for k in range(7)]
    samples = spark.createDataFrame(rows, "signal_id long, pos long, axis double, value double, error double, quality int")
    got = {r.signal_id: r.vector for r in signals.represent(samples).collect()}
    assert sorted(got) == [0, 1, 2]  # constant and short signals have no vector
    for s, v in expected.items():
        assert len(got[s]) == 48 and np.allclose(got[s], v, atol=1e-9)


def test_cross_reference(spark):
    v = spark.createDataFrame([("a", 1.0, 1.0, 1.0, [1.0, 0.0], "light_curve"), ("b", 50.0, 1.0, 1.0, [0.0, 1.0], "light_curve"), ("c", 1.0, 1.0, 1.0, [1.0, 0.0], "spectrum")], "signal_id string, ra double, dec double, good_fraction double, vector array<double>, modality string")
    r = spark.createDataFrame([("r1", 1.0, 1.0, "light_curve", [1.0, 0.1]), ("r2", 9.0, 1.0, "light_curve", None)], "catalog_id string, ra double, dec double, modality string, vector array<double>")
    assert {x.signal_id: x.status for x in signals.cross_reference(v, r).collect()} == {"a": "matched", "b": "novelty_review_candidate", "c": "insufficient_reference_coverage"}


def test_cross_reference_query_searches_all_rows(spark, sf, monkeypatch):
    """Every hundredth vector, small ids among the references, with pivots and without."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, np.float64) / np.linalg.norm(np.array(r.embedding, np.float64)) for r in rows}
    expected = {}
    for q in rows:
        if q.vec_id % 100 == 0:
            d = {r.vec_id: 1 - unit[q.vec_id] @ unit[r.vec_id] for r in rows if r.label == q.label and r.vec_id != q.vec_id}
            near = [x for i, x in d.items() if i % 11 == 0]
            expected[q.vec_id] = (round(min(d.values()), 6), sum(x <= 0.9 for x in near), len(near), len(d))
    assert len(expected) == len([r for r in rows if r.vec_id % 100 == 0]) > 1
    for pivots in (signals.PIVOTS, 0):
        monkeypatch.setattr(signals, "PIVOTS", pivots)
        got = {r.query_id: (r.nearest, r.supported, r.candidates, r.comparable) for r in catalog_queries.QUERIES["cross_reference"](spark, sf).collect()}
        assert got.keys() == expected.keys() and all(np.allclose(got[i], expected[i], atol=2e-6) for i in got)


def test_cross_reference_of_odd_vectors(spark):
    """Null, zero, short and null-holding vectors are compared with nothing but count by position."""
    v = spark.createDataFrame([("a", 1.0, 1.0, 1.0, [1.0, 0.0], "x"), ("b", 1.0, 1.0, 1.0, None, "x"), ("c", None, 1.0, 1.0, [0.0, 0.0], "x"), ("d", 1.0, 1.0, 1.0, [1.0], None)], "signal_id string, ra double, dec double, good_fraction double, vector array<double>, modality string")
    r = spark.createDataFrame([("a", 1.0, 1.0, "x", [1.0, 0.0]), ("r", 1.0, 1.0, "x", [1.0, None]), ("s", 1.0, 1.0, "x", [1.0, 0.1, 0.0]), ("t", 9.0, 1.0, "x", [0.0, 2.0])], "catalog_id string, ra double, dec double, modality string, vector array<double>")
    told = lambda df: {x.signal_id: (x.supported, x.candidates, x.comparable, x.nearest) for x in df.collect()}
    assert told(signals.cross_reference(v, r)) == {"a": (1, 3, 2, 0.0), "b": (0, 3, 0, None), "c": (0, 0, 0, None), "d": (0, 0, 0, None)}
    assert told(signals.cross_reference(v, r, but_own=True)) == {"a": (0, 2, 1, 1.0), "b": (0, 3, 0, None), "c": (0, 0, 0, None), "d": (0, 0, 0, None)}


def test_pivots_pass_over_what_can_not_be_nearer(spark):
    """Clustered vectors: most pairs are never compared, and the distances are those of all pairs; crowded cells go by blocks."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(30, 16))
    refs = np.concatenate([m + rng.normal(0, 0.05, (60, 16)) for m in middles] + [np.ones((1, 16)) * k for k in (1.0, 2.0)])
    asked = np.concatenate([middles[:10] + rng.normal(0, 0.05, (10, 16)), rng.normal(size=(3, 16)), np.ones((1, 16))])
    frame = lambda x, name: spark.createDataFrame([(i, str(i), "m", 16, v.tolist()) for i, v in enumerate(x)], f"row long, {name} string, modality string, n long, vector array<double>").withColumnRenamed(name, "id")
    got = {r.row: (r.nearest, r.compared) for r in signals.nearest_distances(frame(asked, "a"), frame(refs, "b"), False).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit(asked) @ unit(refs).T
    assert np.allclose([got[i][0] for i in range(len(asked))], d.min(axis=1).clip(0), atol=1e-12)
    compared = sum(got[i][1] for i in range(10))
    print("share of pairs compared", compared / (10 * len(refs)))
    assert compared < 0.15 * 10 * len(refs)


def test_blocks_of_a_crowded_key_meet_each_other(spark):
    left = spark.range(50).selectExpr("id as row", "id % 2 as k")
    right = spark.range(70).selectExpr("id as row", "id % 3 as k")
    count = lambda a, b: pa.RecordBatch.from_arrays([a.column("row").combine_chunks(), pa.array([b.num_rows] * a.num_rows), pa.array([max(a.num_rows, b.num_rows)] * a.num_rows)], ["row", "n", "most"])
    rows = signals.met(left, right, ["k"], count, "row long, n long, most long", block=4).groupBy("row").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()
    assert {r.row: r.n for r in rows} == {i: len([j for j in range(70) if j % 3 == i % 2]) for i in range(50)} and max(r.most for r in rows) <= 16


def test_aliases_and_positions(spark):
    df = spark.createDataFrame([(" 10.5 ", "20", "x1", None, 1), ("nan", "20", "x2", "3", 2), ("-10", "95", None, "3", 3), ("370", "1", None, "bad", 4)], "RAJ2000 string, DEJ2000 string, designation string, plx_value string, other int")
    assert normalized(df).columns == ["ra", "dec", "source_id", "parallax", "other"]
    good, bad = to_sources(df, "cat")
    got = [(r.source_id, r.ra, r.parallax) for r in good.orderBy("other").collect()]
    assert got == [("x1", 10.5, None), ("cat:10.0000000000:1.0000000000", 10.0, None)] and bad.count() == 2
    js = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"data":[{"a":3}]}',), ('{"a":4}',)], "t string")
    assert sorted(r.a for r in js.select(F.explode(json_records(F.col("t"), "a:int")).alias("r")).select("r.a").collect()) == [1, 2, 3, 4]
    dim = spark.createDataFrame([("Vega", ["HD  172167", "alf Lyr"], 279.2, 38.8)], "name string, aliases array<string>, ra double, dec double")
    assert [r.ra for r in resolved(spark.createDataFrame([("hd 172167",), ("none",)], "name string"), dim).orderBy("name").collect()] == [279.2, None]


VOTABLE = """<VOTABLE><RESOURCE><INFO name="QUERY_STATUS" value="{status}"/><TABLE><FIELD name="oid" datatype="long"/><FIELD name="value" datatype="double"/><FIELD name="name" datatype="char" arraysize="*"/>
<DATA><TABLEDATA><TR><TD>99999999999999999</TD><TD>NaN</TD><TD>A &amp; B</TD></TR><TR><TD></TD><TD>1.5</TD><TD></TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""
IPAC = "\\fixlen\n| ra      | dec    | name  |\n| double  | double | char  |\n|         |        |       |\n| null    | null   | null  |\n  10.5      20.25    M 31   \n  null      1.0      null   \n"


def test_table_sources(spark, tmp_path):
    tables.register(spark)
    (tmp_path / "v").mkdir()
    for k in range(2):
        (tmp_path / "v" / f"{k}.xml").write_text(VOTABLE.format(status="OK"))
    rows = spark.read.format("votable").option("strict", "true").load(str(tmp_path / "v"))
    assert rows.rdd.getNumPartitions() == 2 and [tuple(r) for r in rows.collect()][:2] == [(99999999999999999, None, "A & B"), (None, 1.5, None)]
    for bad in (VOTABLE.format(status="OVERFLOW"), "nothing", "<VOTABLE/>"):
        with pytest.raises(tables.TableError):
            tables.parse_votable(bad.encode(), True)
    (tmp_path / "t.tbl").write_text(IPAC)
    assert [tuple(r) for r in spark.read.format("ipac").load(str(tmp_path / "t.tbl")).collect()] == [(10.5, 20.25, "M 31"), (None, 1.0, None)]
    (tmp_path / "a.fits").write_bytes(tables.write_fits(["TIME", "QUALITY", "NAME"], [np.array([1.5, np.nan]), np.array([0, 8]), np.array(["x", "yz"], object)], {"TICID": 42}))
    assert [tuple(r) for r in spark.read.format("fits").load(str(tmp_path / "a.fits")).collect()] == [(1.5, 0, "x"), (None, 8, "yz")]
    assert tables.parse_fits((tmp_path / "a.fits").read_bytes())[0]["TICID"] == 42


def test_exports(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") / 2).alias("x"), F.col("id").cast("string").alias("s"))
    policy = exports.Policy(parquet_rows=20, part_rows=10)
    for asked, kind in ((None, "parquet"), ("csv", "csv"), ("jsonl", "jsonl")):
        path = str(tmp_path / kind)
        m = exports.materialize(df.coalesce(1), path, asked, policy=policy)
        assert (m["format"], m["rows"], len(m["parts"])) == (kind, 25, 3) and json.loads((tmp_path / kind / "manifest.json").read_text()) == m
        assert sorted(map(tuple, exports.read_back(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert exports.chosen_format(df.withColumn("n", F.array("id")), 1, 1) == "jsonl"
    assert exports.chosen_format(df, 1, 1, use="astronomy") == "fits" and exports.chosen_format(df, 1, 1) == "csv"


def test_quota_expires_exactly_at_the_window():
    assert quota.allow([0, 59, 60, 60.1], [], 2, 60)[0] == [True, True, True, False]


def test_quota_stream_is_the_table(spark, tmp_path):
    rows = [(k, i, datetime(2024, 1, 1) + timedelta(seconds=7 * i)) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    want = {(r.key, r.id): r.allowed for r in quota.quota_table(df, 3, 60).collect()}
    assert sum(want.values()) < len(want)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = quota.quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 60)
    stream.writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.key, r.id): r.allowed for r in spark.table("quota").collect()} == want


def test_breaker(spark):
    seen = [(0, False)] * 5 + [(10, True), (29, False), (30, False), (59, True), (60, True), (61, False)]
    df = spark.createDataFrame([("k", i, float(t), ok) for i, (t, ok) in enumerate(seen)], "key string, id long, seconds double, ok boolean")
    got = [r.state for r in quota.breaker_states(df).orderBy("id").collect()]
    assert got == ["closed"] * 4 + ["open"] * 5 + ["closed", "closed"]


def test_first_deliveries_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (1, "b", 20), (2, "a", 30), (2, "a", 30)], "k long, f string, at long").withColumn("ts", F.timestamp_seconds("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = quota.first_deliveries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour"), "k", "f", "at")
    stream.writeStream.format("memory").queryName("deliveries").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.f) for r in spark.table("deliveries").collect()) == [(1, "a"), (1, "b"), (2, "a")]
