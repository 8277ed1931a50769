"""Catalog rows: aliases, identity, coverage, snapshots, filters that requests name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators.spatial import cone_join


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def conflicting_keys(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys whose rows differ in value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("versions")).where("versions > 1")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """key and change (added, removed, updated) between two snapshots."""
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "updated")
    return o.join(n, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")


def alias_matches(hosts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """hosts(host, aliases) with identifiers(identifier, oid): status and candidates."""
    wanted = hosts.select("host", F.explode_outer("aliases").alias("alias")).withColumn("key", exprs.collapsed(F.col("alias")))
    found = wanted.join(identifiers.select(exprs.collapsed(F.col("identifier")).alias("key"), "oid").distinct(), "key", "left")
    counted = found.groupBy("host").agg(F.count_distinct("oid").alias("candidates"), F.min("oid").alias("oid"))
    status = F.when(F.col("candidates") == 0, "unmatched").when(F.col("candidates") == 1, "matched").otherwise("ambiguous")
    return counted.select("host", status.alias("status"), "candidates", F.when(F.col("candidates") == 1, F.col("oid")).alias("oid"))


def field_filter(name: str, value, columns: dict[str, Column]) -> Column:
    """A request's filter as a condition: min_x and max_x compare numbers, a bare name compares text; missing is false."""
    columns = dict(columns)
    if "proper_motion_masyr" not in columns and {"pmra", "pmdec"} <= columns.keys():
        columns["proper_motion_masyr"] = exprs.proper_motion(columns["pmra"].try_cast("double"), columns["pmdec"].try_cast("double"))
    if name.startswith("min_"):
        x = columns[name[4:]].cast("double")
        return F.coalesce(exprs.finite(x) & (x >= float(value)), F.lit(False))
    if name.startswith("max_"):
        x = columns[name[4:]].cast("double")
        return F.coalesce(exprs.finite(x) & (x <= float(value)), F.lit(False))
    return F.coalesce(columns[name].cast("string") == str(value), F.lit(False))


def unknown_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The names that are asked for and not known, each once."""
    return asked.select(name).subtract(known.select(name))


def lacking_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that df hasn't, names compared without case."""
    have = {c.upper() for c in df.columns}
    return sorted(c for c in required if c.upper() not in have)


def picked(df: DataFrame, desired: list[str]) -> DataFrame:
    """Of the desired columns those that df has, in the desired order."""
    return df.select(*(F.col(f"`{c}`") for c in desired if c in df.columns))


def provider_stats(members: DataFrame, by: str, stamp: str) -> DataFrame:
    """Records and the first and last stamp of each provider or catalog."""
    return members.groupBy(by).agg(F.count("*").alias("records"), F.min(stamp).alias("first_at"), F.max(stamp).alias("last_at"))


def missing_fields(required: dict[str, Column]) -> Column:
    """The names of required values that aren't present, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items())))


def resolve_identity(arrivals: DataFrame, store: DataFrame, radius_arcsec: float = 1.0) -> DataFrame:
    """Object ids for one catalog's arrivals against stored sources of other catalogs.

    arrivals: catalog, source_id, ra, dec, arrival; store: catalog, source_id, ra, dec, object_id. A source
    that is stored keeps its object. Else it joins the one object that a source of another catalog within the
    radius belongs to, unless that object has a source of its catalog already or an earlier arrival takes it;
    none or several found make a new object.
    """
    first = first_by(arrivals, ["catalog", "source_id"], [F.col("arrival")])
    kept = first.join(store.select("catalog", "source_id", F.col("object_id").alias("known")), ["catalog", "source_id"], "left")
    fresh = kept.where("known is null").select("catalog", "source_id", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"), "arrival")
    others = store.select(F.col("catalog").alias("s_catalog"), "ra", "dec", "object_id")
    near = cone_join(fresh, others, radius_arcsec).where("catalog <> s_catalog").groupBy("catalog", "source_id", "arrival").agg(F.count_distinct("object_id").alias("objects"), F.min("object_id").alias("object_id"))
    free = near.where("objects = 1").join(store.select("catalog", "object_id"), ["catalog", "object_id"], "left_anti")
    taken = first_by(free, ["catalog", "object_id"], [F.col("arrival"), F.col("source_id")]).select("catalog", "source_id", F.col("object_id").alias("adopted"))
    joined = kept.join(taken, ["catalog", "source_id"], "left").join(near.select("catalog", "source_id", "objects"), ["catalog", "source_id"], "left")
    outcome = F.when(F.col("known").isNotNull(), "known").when(F.col("adopted").isNotNull(), "adopted").when(F.col("objects") > 1, "ambiguous").when(F.col("objects") == 1, "conflict").otherwise("new")
    return joined.select("catalog", "source_id", F.coalesce("known", "adopted", exprs.object_id(F.col("catalog"), F.col("source_id").cast("string"))).alias("object_id"), outcome.alias("outcome"))


def merged(sources: DataFrame, keys: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """One row for each key with the first present value of every field."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picked = sources.select(*keys, *(F.first(F.when(exprs.present(F.col(f), sources.schema[f].dataType), F.col(f)), True).over(w).alias(f) for f in fields))
    return picked.distinct()
