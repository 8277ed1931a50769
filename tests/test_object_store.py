"""The versioned store against full recomputation: identity, versions, what a round reads and writes, fulfilment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import catalogs, fulfilment, object_store
from orrery.operators.object_store import Conflict, Manifest, ObjectStore

ROWS = "catalog string, source_id string, ra double, dec double, mass double, note string, catalog_version string"


def rows(spark, *told):
    return spark.createDataFrame([(*t, *[None] * (7 - len(t))) for t in told], ROWS)


def test_values_and_versions(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.version() == 0 and store.members().collect() == []
    v, told = store.upsert(rows(spark, ("gaia", "1", 10.0, 0.0, 1.0, "a", "dr3"), ("gaia", "2", 20.0, 0.0, None, None, "dr3"), ("gaia", "1", 10.0, 0.0, 1.0, "a", "dr3")))
    assert v == 1 and {r.source_id: r.outcome for r in told.collect()} == {"1": "new", "2": "new"}
    old = store.members(1)
    v, told = store.upsert(rows(spark, ("wise", "w", 10.0, 0.0001, 2.0), ("gaia", "2", 20.5, 0.0, 7.0, "", "dr3"), ("gaia", "1", 10.0, 0.0, None, "b", "dr4")))
    assert {(r.catalog, r.source_id): r.outcome for r in told.collect()} == {("wise", "w"): "adopted", ("gaia", "2"): "known", ("gaia", "1"): "known"}
    now = {r.source_id: r for r in store.members().collect()}
    assert now["w"].object_id == now["1"].object_id != now["2"].object_id
    assert (now["2"].mass, now["2"].note, now["2"].ra) == (7.0, None, 20.5)  # an empty text is not present
    assert (now["1"].mass, now["1"].note) == (None, "b")  # another version of the catalog: the earlier values are gone
    assert {(r.source_id, r.ra, r.note) for r in old.collect()} == {("1", 10.0, "a"), ("2", 20.0, None)}  # a reader of version 1
    assert store.upsert(rows(spark))[0] == 2
    with pytest.raises(Conflict):
        store._commit(Manifest(2))
    some = store.members(objects=store.members().where("source_id = 'w'").select("object_id"))
    assert sorted(r.source_id for r in some.collect()) == ["1", "w"]


def test_identity_is_that_of_the_whole_store(spark, tmp_path):
    """Points around poles, the wrap and cell borders, in rounds, against resolve_identity over all that is stored."""
    rng = np.random.default_rng(7)
    store = ObjectStore(spark, str(tmp_path / "s"), buckets=8)
    spots = [(ra, dec) for ra in (0.0, 359.99999, 120.0, 1.0) for dec in (89.99999, -90.0, 0.0, 60.0, -0.00001)]
    for turn in range(3):
        told = []
        for k in range(40):
            ra, dec = spots[rng.integers(len(spots))]
            dec = float(np.clip(dec + rng.normal() * 2 / 3600, -90, 90))
            told.append((f"c{rng.integers(3)}", str(rng.integers(60)), float((ra + rng.normal() * 2 / 3600 / max(1e-4, np.cos(np.radians(dec)))) % 360), dec, float(k)))
        arrivals = rows(spark, *{t[:2]: t for t in told}.values())
        before = store.members().select("catalog", "source_id", "ra", "dec", "object_id")
        want = catalogs.resolve_identity(arrivals.withColumn("arrival", F.concat_ws("\x1f", "catalog", "source_id")), before, 3.0)
        want = {tuple(r) for r in want.select("catalog", "source_id", "object_id", "outcome").collect()}
        _, got = store.upsert(arrivals, radius_arcsec=3.0)
        assert {tuple(r) for r in got.select("catalog", "source_id", "object_id", "outcome").collect()} == want
        assert turn == 0 or len({o for *_, o in want}) > 2


def test_a_round_reads_and_writes_its_buckets(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "s"), buckets=32)
    base = spark.range(5000).select(F.lit("a").alias("catalog"), F.col("id").cast("string").alias("source_id"), (F.col("id") % 3600 / 10).alias("ra"), (F.floor(F.col("id") / 3600) * 10.0).alias("dec"), F.repeat(F.lit("x"), 200).alias("note"))
    store.upsert(base)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    before = size()
    read = []
    own = store._read
    store._read = lambda m, t, s, b=None: read.append((t, b)) or own(m, t, s, b)
    store.upsert(base.where("source_id in ('7', '8')").withColumn("note", F.lit("y")))
    assert (size() - before) * 20 < before and all(b is not None and len(b) <= 8 for _, b in read)
    manifest = store.manifest()
    assert sum(len(x.inputFiles()) for x in [own(manifest, "members", manifest.schema, {3})]) <= 3
    store._read = own
    for k in range(4):
        store.upsert(base.where("source_id = '9'").withColumn("note", F.lit(f"z{k}")))
    whole = sorted(map(str, store.members().collect()))
    v = store.version()
    assert store.compact(3) == v + 1 and store.compact(3) == v + 1
    assert sorted(map(str, store.members().collect())) == whole == sorted(map(str, store.members(v).collect()))
    assert {r.note for r in store.members().where("source_id in ('7', '9')").collect()} == {"y", "z3"}


def test_fulfilment_rounds(spark, tmp_path):
    """Objects that lack a mass are asked for in the order of their ids; coverage by bucket is that of the whole store."""
    store = ObjectStore(spark, str(tmp_path / "s"), buckets=4)
    told = [("gaia", str(k), k * 0.1, 0.0, 1.0 if k in (3, 4) else None) for k in range(40)]
    store.upsert(rows(spark, *told))
    turns = []

    def fetch(objects, turn):
        ids = sorted(r.object_id for r in objects.collect())
        turns.append(ids)
        keys = [int(r.source_id) for r in store.members(objects=objects).collect()]
        return rows(spark, *[("gaia", str(k), k * 0.1, 0.0, 5.0) for k in keys if k % 2])

    request = fulfilment.Request(12, fields=("mass",))
    got, state = object_store.fulfil(store, request, fetch, gaps=7)
    got = got.collect()
    assert len(got) == 12 and [r.reused for r in got] == [True] * 2 + [False] * 10 and state["status"] == "completed" and len(turns) == state["rounds"] >= 3
    flat = [i for ids in turns for i in ids]
    assert flat == sorted(flat) and len(set(flat)) == len(flat) and all(len(ids) == 7 for ids in turns)
    whole = fulfilment.totals(fulfilment.coverage(store.members(), request), request)
    assert whole == {k: state[k] for k in whole}
    _, state = object_store.fulfil(store, fulfilment.Request(99, fields=("mass",)), fetch, gaps=100)
    assert state["status"] == "partial" and state["reason"] == "no_more_rows" and state["usable"] == 21
    empty = ObjectStore(spark, str(tmp_path / "e"), buckets=2)
    _, state = object_store.fulfil(empty, fulfilment.Request(1), lambda objects, turn: rows(spark))
    assert state["reason"] == "no_more_rows" and state["usable"] == 0
