"""Planet tables: measurements, systems, texts, map rows, edges, and snapshots of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators.catalogs import snapshot_diff
from orrery.operators.store import cut


def measurements(planets: DataFrame, measures: dict[str, tuple[str, str]]) -> Column:
    """An array of the measures that a planet has: field, label, value, unit, errors and limit.

    measures: label and unit by column; errors and limit are columns of the same name with err1, err2 and
    lim, null where they aren't there.
    """
    c = lambda name: (F.col(name) if name in planets.columns else F.lit(None)).cast("double")
    each = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), c(f).alias("value"), F.lit(unit).alias("unit"), c(f + "err1").alias("plus"), c(f + "err2").alias("minus"), c(f + "lim").cast("int").alias("limit"))) for f, (label, unit) in measures.items() if f in planets.columns]
    return F.array_compact(F.array(*each))


def described(name: Column, host: Column, found: Column) -> Column:
    """A sentence on the planet and one on each measure (P10)."""
    bound = lambda m: F.when(m["limit"] == 1, "at most ").when(m["limit"] == -1, "at least ").otherwise("")
    error = lambda m: F.when(m["plus"].isNotNull() | m["minus"].isNotNull(), F.concat(F.lit(" (+"), F.coalesce(m["plus"].cast("string"), F.lit("?")), F.lit(", "), F.coalesce(m["minus"].cast("string"), F.lit("?")), F.lit(")"))).otherwise("")
    told = F.transform(found, lambda m: F.concat(m["label"], F.lit(": "), bound(m), m["value"].cast("string"), F.lit(" "), m["unit"], error(m), F.lit(".")))
    return F.concat_ws(" ", F.concat(name, F.lit(" orbits "), host, F.lit(".")), told)


def systems(planets: DataFrame, hosts: DataFrame) -> DataFrame:
    """Each host with its planets by name and how its identifiers matched."""
    grouped = planets.groupBy("host").agg(F.count("*").alias("planet_count"), F.sort_array(F.collect_list("name")).alias("planets"))
    return grouped.join(hosts.select("host", "status", "oid"), "host", "left").withColumn("status", F.coalesce("status", F.lit("unavailable"))).withColumn("id", exprs.entity_id("host", F.col("host")))


def map_rows(planets: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows for a map: hosts, planets and the objects that exactly one identifier names, each once."""
    row = lambda kind, name: [exprs.entity_id(kind, name).alias("id"), F.lit(kind).alias("kind"), name.alias("name")]
    p = planets.select(*row("planet", F.col("name")), "ra", "dec")
    h = planets.groupBy("host").agg(F.min("ra").alias("ra"), F.min("dec").alias("dec")).select(*row("host", F.col("host")), "ra", "dec")
    s = hosts.where("status = 'matched'").select(*row("object", F.col("oid").cast("string")))
    return p.unionByName(h).unionByName(s, allowMissingColumns=True).dropDuplicates(["id"])


def edges(planets: DataFrame, hosts: DataFrame) -> DataFrame:
    """from_id, to_id, relation: planets to hosts, hosts to the objects that match them."""
    host = exprs.entity_id("host", F.col("host"))
    orbits = planets.select(exprs.entity_id("planet", F.col("name")).alias("from_id"), host.alias("to_id"), F.lit("orbits").alias("relation"))
    same = hosts.where("status = 'matched'").select(host.alias("from_id"), exprs.entity_id("object", F.col("oid").cast("string")).alias("to_id"), F.lit("identified_as").alias("relation"))
    return orbits.unionByName(same)


def complete(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """rows, after a check that there are as many as expected and that key tells them apart."""
    n, different = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if (n, different) != (expected, expected):
        raise ValueError(f"{expected} rows were promised; {n} came, with {different} keys")
    return rows


def commit(rows: DataFrame, key: str, columns: list[str], previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, str]:
    """A snapshot of rows with digests, what changed against the previous one, and its fingerprint.

    The fingerprint depends on the rows alone, not on their order: an equal snapshot has an equal one.
    """
    told = rows.select(key, *columns, F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))
    told = cut(told, "snapshot")
    change = snapshot_diff(previous if previous is not None else told.limit(0), told, key)
    total = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(key, "digest").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return told, change, f"{total['n']}-{total['s']}"
