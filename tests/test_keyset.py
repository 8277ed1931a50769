"""Keyset scans: pages, ties, texts, cursors that expire, streams that are taken up again."""

import time

from pyspark.sql import functions as F

from orrery.sources import keyset


def test_pages_of_a_table(spark):
    df = spark.range(25).select((F.col("id") * 3).alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    cursor, seen = None, []
    while True:
        rows = keyset.page(df, "k", cursor, 10)
        seen += [r.k for r in rows.collect()]
        cursor = keyset.next_cursor(rows, "k", 10)
        if cursor is None:
            break
    assert seen == list(range(0, 75, 3))


def reader(path, key, **kw):
    options = {"path": str(path), "key": key, **{k: str(v) for k, v in kw.items()}}
    return keyset.KeysetReader(options, keyset.Keyset(options).schema())


def test_ties_texts_and_cursors_that_expire(spark, tmp_path):
    spark.range(20).select(F.concat(F.lit("k"), F.format_string("%02d", F.floor(F.col("id") / 2))).alias("k"), "id").repartition(3).write.parquet(str(tmp_path / "t"))
    r = reader(tmp_path / "t", "k", limit=3)
    rows, at = r.read(r.initialOffset())
    assert sorted(x[1] for x in rows) == [0, 1, 2, 3] and (at["cursor"], at["exhausted"]) == ("k01", False)  # both rows of the last key
    rows, end = r.read(at)
    rows = list(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, r.readBetweenOffsets(at, end))) and end["cursor"] == "k03"
    last = {"cursor": "k08", "exhausted": False, "at": time.time()}
    rows, done = r.read(last)
    assert len(list(rows)) == 2 and done["exhausted"] and r.read(done)[1] == done and list(r.read(done)[0]) == []
    rows, again = r.read({**last, "at": time.time() - 86_401})  # a day later the scan begins anew
    assert again["cursor"] == "k01" and len(list(rows)) == 4 == len(list(r.readBetweenOffsets(last, again)))


def test_a_stopped_stream_goes_on(spark, tmp_path):
    spark.dataSource.register(keyset.Keyset)
    spark.range(50).selectExpr("id * 7 as k", "string(id) as t").repartition(4).write.parquet(str(tmp_path / "t"))

    def run(until):
        pages = spark.readStream.format("keyset").option("path", str(tmp_path / "t")).option("key", "k").option("limit", "8").load()
        q = pages.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        while until and not any(p.numInputRows for p in q.recentProgress):
            q.awaitTermination(1)
        if not until:
            q.processAllAvailable()
        q.stop()

    run(True)
    some = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < some
    run(False)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.t) for r in rows) == sorted((i * 7, str(i)) for i in range(50))
