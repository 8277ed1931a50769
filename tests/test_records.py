"""Open-schema records: keys that differ, repeat or clash, values of several kinds, bodies that aren't objects."""

from pyspark.sql import functions as F

from orrery.sources import records


def test_records_of_many_shapes(spark):
    bodies = [
        '{"RAJ2000": "10.5", " decMean ": -3, "objID": 99999999999999999, "plx_value": "n/a", "note": [1, 2], "x": 1}', '[{"ra": 1, "RA_ICRS": null, "dec": 2, "x": "t", "X": 2.5}, {"id": "a", "main_id": 7, "x": 1, " x": null}]',
        '{"data": [{"ra": "nan", "otype": {"a": 1}, "x": true}]}', "nonsense", "[1]", '{"results": []}', "{}", None, "",
    ]
    df = spark.createDataFrame([(i, b, 5.0) for i, b in enumerate(bodies)], "k int, body string, epoch double")
    rows = records.normalized(df.select("k", "epoch", F.explode(records.objects_of(F.col("body"))).alias("record")))
    told = rows.select("k", "source_id", "ra", "dec", "parallax", "object_type", "epoch", F.to_json("rest").alias("rest")).orderBy("k", F.col("source_id").isNotNull()).collect()
    assert [tuple(r) for r in told] == [
        (0, "99999999999999999", 10.5, -3.0, None, None, 5.0, '{"note":[1,2],"x":1}'), (1, None, None, 2.0, None, None, 5.0, '{"x":"t","X":2.5}'), (1, "7", None, None, None, None, 5.0, '{"x":null}'),
        (2, None, None, None, None, '{"a":1}', 5.0, '{"x":true}'), (6, None, None, None, None, None, 5.0, "{}"),
    ]
    assert {r.name: r.kind for r in records.kinds(rows).collect()} == {"x": "VARIANT", "X": "DECIMAL(2,1)", "note": "ARRAY<BIGINT>"}
    assert records.normalized(df.limit(0).select(F.explode(records.objects_of(F.col("body"))).alias("record"))).collect() == []
