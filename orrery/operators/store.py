"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; in local mode, if it is unset, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="orrery-")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a limit goes by one task.
FEW = 10_000


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The n first rows in an order that has no ties; many go by ranges, of which only the last one taken is cut, no task holding them all."""
    if n <= FEW:
        return df.orderBy(*order).limit(n)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // FEW)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    whole, left = -1, n
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():  # a row a range
        if r["count"] > left:
            rest = ranged.where(F.col("__range") == r["__range"]).orderBy(*order).limit(left)
            return ranged.where(F.col("__range") <= whole).unionByName(rest).drop("__range")
        whole, left = r["__range"], left - r["count"]
    return ranged.drop("__range")
