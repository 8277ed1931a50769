"""Exports come back equal, in every format; parts are bounded by their bytes; large tables are read by ranges."""

import datetime as dt
import io
import json
import tracemalloc
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import Phase, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.sources import exports, sinks, tables

FORMATS = ("csv", "jsonl", "json", "parquet", "fits")
SCHEMA = (
    "id long, t string, `a.b``\"c` string, x double, y float, ok boolean, at timestamp, near timestamp_ntz, day date, raw binary, d decimal(20,4), n struct<p:int,q:string>, l array<double>, m map<string,string>, small short"
)
UTC = dt.timezone.utc
ROWS = [
    (1, "a\nb", "c\"d\\", 1.5, 0.1, True, dt.datetime(2024, 3, 31, 1, 30, 0, 123456, UTC), dt.datetime(2024, 3, 31, 2, 30, 0, 1), dt.date(1, 1, 1), b"\x00\xff", Decimal("1.2345"), (1, "x\ny"), [1.0, float("nan"), None], {"k": None}, 3),
    (2, "", None, float("nan"), float("inf"), None, None, None, None, None, None, None, None, None, None),
    (3, None, "", None, None, False, dt.datetime(1969, 12, 31, 23, 59, 59, 999999, UTC), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), dt.date(9999, 12, 31), b"", Decimal("-0.0001"), (None, None), [], {}, -1),
    (-(1 << 63), " \t, é 漢 😀 \r\n \\N \\u0041 ", "'\"", -0.0, -1e-30, True, dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 1, 1), dt.date(2024, 2, 29), b"\n,\"", Decimal("0"), (5, ""), [2.5], {"a,b": "c\"", "": ""}, 0),
    (None, "\\", "\r", 1e308, 3.5, False, None, None, None, b"x", None, (None, "\\"), [float("-inf")], {"k": "v\nw"}, 7),
]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("kind", FORMATS)
def test_what_was_written_is_read(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    m = exports.materialize(df, str(tmp_path / kind), kind)
    back = exports.read_back(spark, str(tmp_path / kind), verify=True)
    assert back.dtypes == df.dtypes and same(back, df) and m["rows"] == 5 and m["format"] == kind
    assert json.loads((tmp_path / kind / "manifest.json").read_text()) == m
    for columns in (["t"], ["n"], ["x"]):  # a table of one column, with nulls and empty texts
        exports.materialize(df.select(*columns), str(tmp_path / kind / columns[0]), kind)
        assert same(exports.read_back(spark, str(tmp_path / kind / columns[0]), verify=True), df.select(*columns))
    exports.materialize(df.limit(0), str(tmp_path / kind / "none"), kind)
    none = exports.read_back(spark, str(tmp_path / kind / "none"), verify=True)
    assert none.collect() == [] and none.dtypes == df.dtypes


TEXT = st.none() | st.text(st.sampled_from("a\"'\\,\n\r\t \x00N;é😀|"), max_size=6)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
@example([('"\x00', "\x00", None, 0), ('""\x00"', '"', float("nan"), None)])
@given(st.lists(st.tuples(TEXT, TEXT, st.none() | st.floats(), st.none() | st.integers(-(1 << 63), (1 << 63) - 1)), min_size=1, max_size=12))
def test_any_texts_and_numbers_come_back(spark, tmp_path_factory, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, a string, b string, x double, i long")
    for kind in FORMATS:
        path = str(tmp_path_factory.mktemp("d"))
        exports.materialize(df, path, kind)
        assert same(exports.read_back(spark, path), df), kind


def test_parts_close_by_their_bytes(spark, tmp_path):
    """Long rows come together: no part is beyond the bound but by one row."""
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), F.when(F.col("id") > 3900, 5000).otherwise(10).cast("int")).alias("t")).coalesce(1)
    for kind in ("csv", "jsonl", "json", "fits"):
        m = exports.materialize(df, str(tmp_path / kind), kind, policy=exports.Policy(part_bytes=200_000))
        assert len(m["parts"]) >= 3 and max(p["bytes"] for p in m["parts"]) <= 200_000 and sum(p["rows"] for p in m["parts"]) == 4000
        assert same(exports.read_back(spark, str(tmp_path / kind), verify=True), df)


def test_damage_is_found(spark, tmp_path):
    m = exports.materialize(spark.range(5), str(tmp_path / "d"), "jsonl")
    part = m["parts"][0]["path"]
    with open(part, "ab") as f:
        f.write(b'{"id":9}\n')
    with pytest.raises(tables.TableError, match="rows"):
        exports.read_back(spark, str(tmp_path / "d"), verify=True)
    with pytest.raises(tables.TableError, match="no format"):
        exports.materialize(spark.range(1), str(tmp_path / "e"), "xls")


def test_a_lost_attempt_leaves_no_part(spark, tmp_path):
    """A write that fails leaves an empty folder; an attempt that does not count is taken away at the commit."""
    tables.register(spark)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("x").alias("t"))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(2).write.format("fits").option("path", str(tmp_path / "f")).mode("append").save()
    assert not [p for p in (tmp_path / "f").rglob("*") if p.is_file()]
    writer = sinks._LineWriter({"path": str(tmp_path / "l")})
    (tmp_path / "l" / f".writing-{writer.run}").mkdir(parents=True)
    (tmp_path / "l" / f".writing-{writer.run}" / "part-00000-00000.txt.7").write_text("lost")
    writer.commit([])
    assert [p.name for p in (tmp_path / "l").rglob("*") if p.is_file()] == [f"_parts-{writer.run}.json"] and sinks.parts_of(str(tmp_path / "l")) == []


def test_large_fits_files_are_many_tasks(spark, tmp_path):
    tables.register(spark)
    n = 30_000
    rng = np.random.default_rng(1)
    table = pa.table({"k": np.arange(n), "x": rng.normal(size=n), "s": [f"t{i}" for i in range(n)], "q": pa.array([None if i % 7 == 0 else i for i in range(n)], pa.int64())})
    (tmp_path / "a.fits").write_bytes(tables.fits_bytes(table))
    (tmp_path / "b.fits").write_bytes(tables.fits_bytes(table.slice(0, 3)))
    df = spark.read.format("fits").option("splitBytes", "100000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 8 and df.count() == n + 3 and df.agg(F.sum("k"), F.count("q")).first() == (n * (n - 1) // 2 + 3, n - len(range(0, n, 7)) + 2)
    near = df.where("k >= 29990 and x < 0")
    assert sorted(r.k for r in near.collect()) == [i for i in range(29990, n) if table["x"][i].as_py() < 0]
    two = spark.read.schema("x double, k long").format("fits").load(str(tmp_path / "b.fits"))
    assert [tuple(r) for r in two.collect()] == [(table["x"][i].as_py(), i) for i in range(3)]


def test_fits_columns_of_vectors_and_nulls(spark, tmp_path):
    data = tables.write_fits(["v"], [np.array([1.5, 2.5, 3.5, 4.5])])
    data = data.replace(b"TFORM1  = '1D      '", b"TFORM1  = '2D      '").replace(b"NAXIS1  =                    8", b"NAXIS1  =                   16").replace(b"NAXIS2  =                    4", b"NAXIS2  =                    2")
    (tmp_path / "v.fits").write_bytes(data)
    tables.register(spark)
    assert [r.v for r in spark.read.format("fits").load(str(tmp_path / "v.fits")).collect()] == [[1.5, 2.5], [3.5, 4.5]]
    with pytest.raises(tables.TableError, match="before its last row"):
        tables.parse_fits(data[:5760])


def test_ipac_and_votable_are_read_by_pieces(spark, tmp_path):
    tables.register(spark)
    head = "\\fixlen\n| k       | x       | name    |\n| long    | double  | char    |\n|         |         |         |\n| null    | null    | null    |\n"
    rows = [(k, k / 4, f"né{k}" if k % 5 else None) for k in range(2000)]
    (tmp_path / "t.tbl").write_text(head + "".join(f"  {k:<8}  {x:<8}  {n or 'null':<8}\n" for k, x, n in rows))
    df = spark.read.format("ipac").option("splitBytes", "3000").load(str(tmp_path / "t.tbl"))
    assert df.rdd.getNumPartitions() > 5 and sorted(map(tuple, df.collect())) == sorted(rows)
    assert sorted(r.x for r in spark.read.schema("x double").format("ipac").option("splitBytes", "3000").load(str(tmp_path / "t.tbl")).collect()) == [x for _, x, _ in rows]
    cells = "".join(f"<TR><TD>{k}</TD><TD>{x}</TD><TD>{n or ''}</TD></TR>" for k, x, n in rows)
    xml = '<VOTABLE><RESOURCE><TABLE><FIELD name="k" datatype="long"/><FIELD name="x" datatype="double"/><FIELD name="name" datatype="char" arraysize="*"/><DATA><TABLEDATA>' + cells + '</TABLEDATA></DATA></TABLE><INFO name="QUERY_STATUS" value="{}"/></RESOURCE></VOTABLE>'
    (tmp_path / "v.xml").write_text(xml.format("OK"))
    read = spark.read.format("votable").option("strict", "true")
    assert sorted(map(tuple, read.load(str(tmp_path / "v.xml")).collect())) == sorted(rows)
    (tmp_path / "v.xml").write_text(xml.format("OVERFLOW"))  # told after the rows
    with pytest.raises(Exception, match="query status"):
        read.load(str(tmp_path / "v.xml")).collect()


def test_a_manifest_tells_where_its_objects_come_from(spark, tmp_path):
    members = spark.createDataFrame([("a", "gaia", "tap"), ("a", "wise", "irsa"), ("b", "gaia", "tap"), ("c", "gaia", "tap")], "object_id string, catalog string, provider string")
    chosen = spark.createDataFrame([("a", True), ("b", False)], "object_id string, reused boolean")
    facts = exports.provenance(members, chosen, 3)
    assert facts == {"providers": {"tap": 2, "irsa": 1}, "catalogs": ["gaia", "wise"], "objects": 2, "reused": 1, "reuse_ratio": 0.5, "requested": 3, "status": "partial"}
    exports.materialize(chosen, str(tmp_path / "d"), "csv", facts=facts)
    assert {**facts, "rows": 2}.items() <= json.loads((tmp_path / "d" / "manifest.json").read_text()).items()
    assert exports.provenance(members.limit(0), chosen.limit(0), 0)["status"] == "completed"


def test_parts_of_fits_are_encoded_by_pieces(tmp_path):
    """a part is written some rows at a time, equal to what it is as a whole; nulls and texts of any piece count for all."""
    n = 8 * tables.PIECE_ROWS + 7
    k = np.arange(n)
    table = pa.table({
        "k": k, "q": pa.array(np.where(k % 9 == 0, -(1 << 63), k), pa.int64(), mask=k % 7 == 0), "b": pa.array(k % 2 == 0, mask=k == n - 1),
        "x": pa.array(np.where(k == 5, np.nan, k / 8), mask=k % 11 == 0), "s": pa.array(["N" if i % 2 else "R" for i in range(n)]), "t": pa.array([None if i == n - 2 else "é" if i == n - 1 else "plain" for i in range(n)]),
    })
    tracemalloc.start()
    pieces, peak = [], 0
    for piece in tables.fits_pieces(table):
        pieces.append(len(piece))
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    data = tables.fits_bytes(table)
    assert sum(pieces) == len(data) and len(data) % 2880 == 0 and max(pieces) < len(data) / 7 and peak < len(data) / 2
    layout = tables.FitsLayout.of(io.BytesIO(data))
    rows = layout.read(io.BytesIO(data), 0, n)
    assert layout.table["TNULL2"] == -(1 << 63) + 1 and layout.table["TESC6"] and "TESC5" not in layout.table
    for i, name in enumerate(table.column_names):
        assert layout.values(rows, i, keep=True).equals(table[name].combine_chunks()) or name == "x"
    x, y = layout.values(rows, 3, keep=True), table["x"].combine_chunks()
    assert x.is_null().equals(y.is_null()) and np.array_equal(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), equal_nan=True)
