"""Points on the edges of polygons, pages told row by row."""

from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import objects
from orrery.plans import catalog_queries, engine_queries


def test_points_on_an_edge_are_where_sql_has_them(spark):
    """F8: both lie on an edge of the query's polygon; plain differences leave them outside."""
    k = F.col("id")
    s = spark.createDataFrame([(16619,), (49880,)], "id long").select(k, (k * 137 % 2161 / 3600).alias("ra"), (k * 71 % 1021 / 3600 + 10).alias("dec"))
    assert s.where(exprs.inside_polygon(F.col("ra"), F.col("dec"), catalog_queries._POLYGON)).count() == 0


def test_table_of_polygons_with_points_on_edges(spark, tmp_path):
    """of these pairs on edges SQL has one inside."""
    spark.createDataFrame([(724,), (809,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(24606,), (65182,)], "c_custkey long").selectExpr("c_custkey", "'A' as c_mktsegment", "1 as c_nationkey", "1.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    found = {(r.polygon_id, r.source_id) for r in engine_queries.polygon_table(spark, str(tmp_path)).collect()}
    assert (809, 65182) in found and (724, 24606) not in found


def test_a_page_tells_each_invalid_row(spark, sf):
    """F10."""
    page = spark.createDataFrame([(1, 10.0, 10.0, 10.0, 10.0, 2000.0), (2, 10.0, 10.0, 10.0, 10.0, 1500.0), (3, 10.0, 10.0, None, 10.0, 2000.0)], "id long, t_ra double, t_dec double, ra double, dec double, epoch double")
    assert sorted(r.id for r in objects.invalid_rows(page).collect()) == [2, 3]
    assert engine_queries.page_bounds(spark, sf).where("fate = 'invalid'").count() == spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 5 = 0").count()
