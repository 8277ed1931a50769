"""Registry, products, planet tables and fulfilment on small tables."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import fulfilment, planets, products
from orrery.operators.search import Search
from orrery.sources import registry


def test_registry_and_plans(spark):
    rows = registry.registry(spark)
    assert rows.count() == 16 and rows.where("enabled").count() == 15
    names = lambda s, strict=True: sorted(r.catalog for r in s.plan(rows, strict).collect())
    assert names(Search(profiles=("radio",))) == ["first", "lotss", "nvss", "vlass"]
    assert names(Search(catalogs=("gaia_dr3", "vizier_2mass_reference"))) == ["gaia_dr3"]
    bare = rows.withColumn("profiles", F.when(F.col("catalog") == "xmm", F.array().cast("array<string>")).otherwise(F.col("profiles")))
    assert [r.catalog for r in Search(profiles=("identity",)).plan(bare, strict=False).orderBy("catalog").collect()] == ["ned", "simbad", "xmm"]
    s = spark.createDataFrame([("gaia_dr3", None), ("simbad", "radio"), ("other", "")], "catalog string, wavelength string")
    assert {r.catalog: r.wavelength for r in registry.with_wavelength(s, rows).collect()} == {"gaia_dr3": "optical", "simbad": "radio", "other": "unknown"}
    one = spark.range(1).select(registry.links(F.lit("simbad"), F.lit("* alf/Lyr"), F.lit(1.5), F.lit(2.5), F.lit("tap")).alias("l")).first().l
    assert one == {"SIMBAD": "https://simbad.cds.unistra.fr/simbad/sim-id?Ident=%2A%20alf/Lyr"} or one == {"SIMBAD": "https://simbad.cds.unistra.fr/simbad/sim-id?Ident=*%20alf/Lyr"}


def test_products(spark):
    obs = spark.createDataFrame([("TESS", "SPOC", "timeseries", "TIC 42", "3", "7", "o7"), ("tess", "spoc ", "TimeSeries", "43", "x", "8", "o8"), ("HST", "SPOC", "timeseries", "42", "3", "9", "o9")], "obs_collection string, provenance_name string, dataproduct_type string, target_name string, sequence_number string, obsid string, obs_id string")
    assert [r.obsid for r in products.wanted_observations(obs).orderBy("obsid").collect()] == ["7", "8"]
    assert [r.obsid for r in products.wanted_observations(obs, "42", [3]).collect()] == ["7"]
    files = spark.createDataFrame([("u2", "b", None, "7", 0), ("u1", "a", 5, "8", 1), ("u2", "dup", None, "8", 2), (" ", "none", None, "7", 3), (None, "none", None, "7", 4)], "data_uri string, filename string, sequence_number int, parent_obsid string, arrival int")
    got = products.listed(files, obs.withColumn("sequence_number", F.col("sequence_number").try_cast("int"))).collect()
    assert [(r.data_uri, r.filename, r.sequence_number, r.mast_obs_id) for r in got] == [("u2", "b", 3, "o7"), ("u1", "a", 5, "o8")]
    checks = spark.createDataFrame([("a", 3, 3, 0.5, True), ("a", 3, 4, 0.5, True), ("b", 3, 3, 9.0, True), ("c", 3, 3, None, False), ("d", 3, None, None, True)], "t string, s int, r int, sep double, ok boolean")
    told = checks.select("t", products.failure(F.col("s"), F.col("r"), F.lit("1"), F.lit("1"), F.col("sep"), 1.0, F.col("ok")).alias("error_type"))
    assert {r.t: r.status for r in products.outcomes(told, "t").collect()} == {"a": "partial", "b": "no_products", "c": "failed", "d": "complete"}


def planet_rows(spark):
    return spark.createDataFrame([("E b", "E", 10.0, 20.0, 5.0, 0.1, -0.2, 0), ("E c", "E", 10.0, 20.0, 9.0, None, None, 1), ("F b", "F", 1.0, 2.0, None, None, None, None)], "name string, host string, ra double, dec double, period double, perioderr1 double, perioderr2 double, periodlim int")


def test_planets(spark):
    p = planet_rows(spark)
    hosts = spark.createDataFrame([("E", "matched", 77), ("F", "ambiguous", None)], "host string, status string, oid long")
    told = p.select("name", planets.described(F.col("name"), F.col("host"), planets.measurements(p, {"period": ("Period", "days"), "radius": ("Radius", "Re")})).alias("t"))
    assert [r.t for r in told.orderBy("name").collect()] == ["E b orbits E. Period: 5.0 days (+0.1, -0.2).", "E c orbits E. Period: at most 9.0 days.", "F b orbits F."]
    assert {r.host: (r.planet_count, r.planets, r.status) for r in planets.systems(p, hosts).collect()} == {"E": (2, ["E b", "E c"], "matched"), "F": (1, ["F b"], "ambiguous")}
    assert {r.id for r in planets.map_rows(p, hosts).collect()} == {"planet:E%20b", "planet:E%20c", "planet:F%20b", "host:E", "host:F", "object:77"}
    assert {(r.from_id, r.relation) for r in planets.edges(p, hosts).collect()} == {("planet:E%20b", "orbits"), ("planet:E%20c", "orbits"), ("planet:F%20b", "orbits"), ("host:E", "identified_as")}
    assert planets.complete(p, "name", 3) is p
    with pytest.raises(ValueError, match="4 rows were promised"):
        planets.complete(p, "name", 4)


def test_snapshots(spark):
    p = planet_rows(spark)
    first, change, print_ = planets.commit(p, "name", ["host", "period"])
    assert change.where("change = 'added'").count() == 3
    _, change, again = planets.commit(p.orderBy(F.desc("name")), "name", ["host", "period"], first)
    assert change.count() == 0 and again == print_
    moved = p.where("name <> 'F b'").withColumn("period", F.col("period") + F.when(F.col("name") == "E b", 1).otherwise(0)).unionByName(p.where("name = 'F b'").withColumn("name", F.lit("G b")))
    _, change, other = planets.commit(moved, "name", ["host", "period"], first)
    assert {(r.name, r.change) for r in change.collect()} == {("E b", "updated"), ("F b", "removed"), ("G b", "added")} and other != print_


STORE = "object_id string, catalog string, source_id string, ra double, dec double, error_arcsec double, parallax double, mass double"


def test_coverage(spark):
    rows = [("o1", "gaia", "1", 1.0, 0.0, 1.0, 2.0, None), ("o1", "wise", "1", 1.0, 0.0, 1.0, None, 7.0), ("o2", "gaia", "2", 1.0, 0.0, 1.0, None, None), ("o3", "gaia", "3", 1.0, 0.0, 1.0, 0.5, 1.0), ("o4", "gaia", "4", 9.0, 0.0, 1.0, 2.0, 1.0)]
    store = spark.createDataFrame(rows, STORE)
    request = fulfilment.Request(3, fields=("mass",), filters=(("min_parallax", 1),))
    got = {r.object_id: (r.missing, r.usable) for r in fulfilment.coverage(store, request).collect()}
    assert got == {"o1": ([], True), "o2": (["mass", "parallax"], False), "o4": ([], True)}
    assert fulfilment.totals(fulfilment.coverage(store, request), request) == {"usable": 2, "matching": 3, "missing": 1}
    targets = spark.createDataFrame([(1, 1.0, 0.0)], "target_id long, t_ra double, t_dec double")
    near = fulfilment.coverage(store, fulfilment.Request(1, members=2), targets)
    assert {r.object_id: r.usable for r in near.collect()} == {"o1": True, "o2": False, "o3": False}


def test_fulfilment(spark):
    store = spark.createDataFrame([("o9", "gaia", "9", 1.0, 0.0, 1.0, 2.0, 1.0)], STORE)
    request = fulfilment.Request(3, fields=("mass",))
    fetch = lambda gaps, turn: spark.createDataFrame([(f"n{turn}", "gaia", f"n{turn}", 1.0, 0.0, 1.0, 2.0, 1.0 if turn else None)], STORE)
    got, state = fulfilment.fulfil(store, request, fetch, lambda old, new: old.unionByName(new))
    assert [(r.object_id, r.reused) for r in got.collect()] == [("o9", True), ("n1", False), ("n2", False)] and state["status"] == "completed"
    _, state = fulfilment.fulfil(store, request, lambda gaps, turn: store.limit(0), lambda old, new: old)
    assert (state["status"], state["missing"]) == ("partial", 2)
