"""Archive products: filters, first of each file, their observation, checks of what was read, and the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators.catalogs import first_by


def wanted_observations(observations: DataFrame, tic: str | None = None, sectors: list[int] | None = None) -> DataFrame:
    """Time series of the survey's pipeline, of a target and sectors if they are given; texts compared without case."""
    same = lambda c, v: F.coalesce(F.lower(F.trim(c)) == v, F.lit(False))
    rows = observations.where(same("obs_collection", "tess") & same("provenance_name", "spoc") & same("dataproduct_type", "timeseries"))
    if tic:
        rows = rows.where(exprs.tic_number(F.col("target_name")) == tic)
    return rows.where(F.col("sequence_number").try_cast("int").isin(*sectors)) if sectors else rows


def listed(products: DataFrame, observations: DataFrame) -> DataFrame:
    """The first product of each URI in sector, file name and URI order, with its observation's sector and id.

    Of observations that repeat an obsid the last by obs_id counts. Products without a URI are dropped.
    """
    uri = F.trim("data_uri")
    files = first_by(products.where(F.coalesce(uri != "", F.lit(False))).withColumn("data_uri", uri), ["data_uri"], [F.col("arrival")])
    groups = first_by(observations.where("obsid is not null"), ["obsid"], [F.desc("obs_id")]).select("obsid", F.col("obs_id").alias("mast_obs_id"), F.col("sequence_number").alias("__sector"))
    joined = files.join(groups, files["parent_obsid"] == groups["obsid"], "left").drop("obsid")
    return joined.withColumn("sequence_number", F.coalesce("sequence_number", "__sector")).drop("__sector").orderBy(F.coalesce("sequence_number", F.lit(0)), F.coalesce("filename", F.lit("")), "data_uri")


def failure(sector: Column, read_sector: Column, tic: Column, read_tic: Column, separation: Column, radius: float, readable: Column) -> Column:
    """Why a read product isn't what was asked for, or null."""
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    return F.when(~readable, "product_unavailable").when(differs(sector, read_sector) | differs(tic, read_tic) | F.coalesce(separation > radius, F.lit(False)), "target_mismatch")


def outcomes(checked: DataFrame, by: str) -> DataFrame:
    """by and status from rows with error_type or null: complete, partial, no_products or failed (A10)."""
    good, bad = F.count_if(F.col("error_type").isNull()), F.count("error_type")
    only_mismatches = F.count_if(F.col("error_type") == "target_mismatch") == bad
    status = F.when((good > 0) & (bad > 0), "partial").when(good > 0, "complete").when((bad > 0) & ~only_mismatches, "failed").otherwise("no_products")
    return checked.groupBy(by).agg(status.alias("status"), good.alias("products"), bad.alias("failures"))
