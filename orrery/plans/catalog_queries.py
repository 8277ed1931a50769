"""Queries over the driver's tables, one for each operator or family, with the SQL they are held against.

Sky positions don't exist in those tables and are derived from keys: sources are customers, targets are
suppliers, on a lattice of one arc second. Radii end in .5 so that no pair lies on one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import catalogs, fulfilment, groups, planets, products, search, signals, spatial, store
from orrery.sources import exports, keyset, registry
from orrery.streaming import quota

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RADIUS = 60.5


def query(sql: str | None = None):
    """Register the function under its name, with the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources of a catalog, with position, error and parallax."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        k.alias("source_id"), F.col("c_mktsegment").alias("catalog"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        ((k * 137 % 2161) / 3600).alias("ra"), ((k * 71 % 1021) / 3600 + 10).alias("dec"), ((F.col("c_nationkey") + 1) * 2.0).alias("error"), (F.abs("c_acctbal") / 100).alias("parallax"),
    )


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("target_id"), ((k * 391 % 2161) / 3600).alias("t_ra"), ((k * 223 % 1021) / 3600 + 10).alias("t_dec"))


def matches_of(spark: SparkSession, sf_dir: str, radius: float = RADIUS) -> DataFrame:
    return spatial.cone_join(targets_of(spark, sf_dir), sources_of(spark, sf_dir), radius)


def _sep(ra1, dec1, ra2, dec2) -> str:
    return f"degrees(2 * asin(sqrt(least(1, power(sin(radians({dec2} - {dec1}) / 2), 2) + cos(radians({dec1})) * cos(radians({dec2})) * power(sin(radians({ra2} - {ra1}) / 2), 2))))) * 3600"


_S = """src as (select c_custkey as source_id, c_mktsegment as catalog, c_nationkey as nation, c_acctbal as balance,
    (c_custkey * 137 % 2161)::double / 3600 as ra, (c_custkey * 71 % 1021)::double / 3600 + 10 as dec,
    (c_nationkey + 1) * 2::double as error, abs(c_acctbal) / 100 as parallax from customer)"""
_T = "tgt as (select s_suppkey as target_id, (s_suppkey * 391 % 2161)::double / 3600 as t_ra, (s_suppkey * 223 % 1021)::double / 3600 + 10 as t_dec from supplier)"


def _matches(radius: float = RADIUS) -> str:
    return f"""with {_S}, {_T}, m as (select *, {_sep("t_ra", "t_dec", "ra", "dec")} as separation from tgt, src
    where dec between t_dec - {radius + 1} / 3600 and t_dec + {radius + 1} / 3600 and {_sep("t_ra", "t_dec", "ra", "dec")} <= {radius})"""


def _score(s: str, e: str) -> str:
    return f"round(greatest(0, least(1, exp(-0.5 * power({s} / greatest({e}, 0.1), 2)))), 6)"


@query(f"{_matches()} select target_id, source_id, catalog, round(separation, 6) as separation, {_score('separation', 'error')} as score from m")
def cone_match(spark, sf_dir):
    """J1, F1, C1, C3, O1."""
    m = matches_of(spark, sf_dir)
    return m.select("target_id", "source_id", "catalog", F.round("separation", 6).alias("separation"), exprs.match_score(F.col("separation"), F.col("error")).alias("score"))


@query(f"{_matches()} select target_id, source_id, round(separation, 6) as separation from m where separation >= 20.5")
def shell_match(spark, sf_dir):
    """F2."""
    return matches_of(spark, sf_dir).where("separation >= 20.5").select("target_id", "source_id", F.round("separation", 6).alias("separation"))


@query(f"{_matches()} select target_id, source_id, round(separation, 6) as separation from m where separation between 5.5 and 15.5 or separation between 40.5 and 50.5")
def zones_match(spark, sf_dir):
    """F4."""
    s = F.col("separation")
    return matches_of(spark, sf_dir).where(s.between(5.5, 15.5) | s.between(40.5, 50.5)).select("target_id", "source_id", F.round(s, 6).alias("separation"))


@query(f"{_matches()} select target_id, source_id, round(1000 / parallax, 6) as distance from m where parallax > 0 and 1000 / parallax between 15 and 40")
def cylinder_match(spark, sf_dir):
    """F3, C5."""
    d = exprs.distance_pc(F.col("parallax"))
    return matches_of(spark, sf_dir).where(d.between(15, 40)).select("target_id", "source_id", F.round(d, 6).alias("distance"))


@query(f"with {_S} select source_id, {_score('(source_id % 97) / 10::double', 'error')} as known, round(greatest(0, 1 - least((source_id % 97) / 30::double, 10) / 10), 6) as unknown from src")
def match_score(spark, sf_dir):
    """C3, both branches."""
    s = (F.col("source_id") % 97) / 10
    return sources_of(spark, sf_dir).select("source_id", exprs.match_score(s, F.col("error")).alias("known"), exprs.match_score(s, F.lit(None).cast("double")).alias("unknown"))


@query(f"""{_matches()}, r as (select *, row_number() over (partition by target_id order by separation, source_id) as n from m),
e as (select target_id, least({RADIUS}, greatest(1, 1.5 * median(separation))) as effective from r where n <= 5 group by target_id)
select target_id, source_id, round(separation, 6) as separation, round(effective, 6) as effective_radius from r join e using (target_id) where separation <= effective""")
def adaptive_radius(spark, sf_dir):
    """W2, F15."""
    m = spatial.adaptive_join(targets_of(spark, sf_dir), sources_of(spark, sf_dir), RADIUS, "target_id", [F.col("separation"), F.col("source_id")])
    return m.select("target_id", "source_id", F.round("separation", 6).alias("separation"), F.round("effective_radius", 6).alias("effective_radius"))


@query(f"""{_matches()} select target_id, catalog, source_id, round(separation, 6) as separation, rank from (
select *, row_number() over (partition by target_id, catalog order by separation, source_id) as rank from m) where rank <= 3""")
def per_catalog_topk(spark, sf_dir):
    """W1, O2."""
    m = spatial.nearest_matches(targets_of(spark, sf_dir), sources_of(spark, sf_dir), RADIUS, 3, "target_id", ["catalog"], [F.col("separation"), F.col("source_id")])
    return m.select("target_id", "catalog", "source_id", F.round("separation", 6).alias("separation"), F.col("rank").cast("long").alias("rank"))


def _wavelengths(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return F.broadcast(nation.select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("wavelength")))


def _with_wavelength(spark, sf_dir):
    return matches_of(spark, sf_dir).join(_wavelengths(spark, sf_dir), "nation")


_WAVE = f"{_matches()}, w as (select m.*, r_name as wavelength from m join nation on nation.n_nationkey = m.nation join region on r_regionkey = n_regionkey)"


@query(f"{_WAVE} select target_id, wavelength, count(*) as detections, round(min(separation), 6) as nearest from w group by all")
def counterpart_counts(spark, sf_dir):
    """A4 in plain Spark; evidence_records and evidence_counterparts go through the library."""
    return _with_wavelength(spark, sf_dir).groupBy("target_id", "wavelength").agg(F.count("*").alias("detections"), F.round(F.min("separation"), 6).alias("nearest"))


@query(f"{_WAVE} select target_id, array_to_string(list_sort(list(distinct catalog)), ',') as catalogs, array_to_string(list_sort(list(distinct wavelength)), ',') as wavelengths, count(distinct catalog) as catalogs_queried from w group by all")
def group_attributes(spark, sf_dir):
    """A2 in plain Spark; evidence_records goes through the library."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    sources = sources_of(spark, sf_dir).join(_wavelengths(spark, sf_dir), "nation")
    near = spatial.nearest_matches(targets_of(spark, sf_dir), sources, RADIUS, 1, "target_id", ["catalog", "wavelength"], [F.col("separation"), F.col("source_id")])  # one match tells of its catalog and wavelength
    return near.groupBy("target_id").agg(listed("catalog").alias("catalogs"), listed("wavelength").alias("wavelengths"), F.count_distinct("catalog").alias("catalogs_queried"))


_GROUP_RADIUS = 12.5


@query(f"""with recursive {_matches()[5:]}, e as (select a.target_id, a.source_id as a, b.source_id as b from m a join m b using (target_id)
    where a.source_id <> b.source_id and {_sep("a.ra", "a.dec", "b.ra", "b.dec")} <= {_GROUP_RADIUS}),
reach as (select target_id, source_id as a, source_id as b from m union select r.target_id, r.a, e.b from reach r join e on e.target_id = r.target_id and e.a = r.b)
select target_id, a as source_id, min(b) as root from reach group by target_id, a""")
def crossmatch_groups(spark, sf_dir):
    """Components of a target's detections that lie close to each other."""
    return groups.cone_groups(targets_of(spark, sf_dir), sources_of(spark, sf_dir), RADIUS, "target_id", "source_id", _GROUP_RADIUS)


_POLYGON = [(0.1, 10.05), (0.4, 10.07), (0.35, 10.2), (0.12, 10.18)]


def _polygon_sql() -> str:
    edges = ", ".join(f"({a}::double, {b}::double, {c}::double, {d}::double)" for (a, b), (c, d) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True))
    return f"""with {_S}, e(x1, y1, x2, y2) as (values {edges}),
    c as (select source_id, count(*) filter ((y1 > dec) <> (y2 > dec) and (x1 - ra) + (dec - y1) * (x2 - x1) / (y2 - y1) > 0) as n from src, e group by source_id)
    select source_id from c where n % 2 = 0"""


@query(_polygon_sql())
def polygon_exclusion(spark, sf_dir):
    """C8, F6."""
    return sources_of(spark, sf_dir).where(~exprs.inside_polygon(F.col("ra"), F.col("dec"), _POLYGON)).select("source_id")


@query("select year(o_orderdate)::bigint as year, count(*) as n from orders where year(o_orderdate) between 1994 and 1996 group by all")
def time_period(spark, sf_dir):
    """F5, C6."""
    y = exprs.year_of(F.col("o_orderdate").cast("string"))
    return _table(spark, sf_dir, "orders").withColumn("year", y.cast("long")).where("year between 1994 and 1996").groupBy("year").agg(F.count("*").alias("n"))


@query("select lower(trim(split_part(p_type, ' ', 1))) as kind, count(*) as n, sum(p_size)::bigint as total from part where lower(p_brand) in ('brand#11', 'brand#12', 'brand#13', 'brand#21') group by all")
def object_types(spark, sf_dir):
    """C7, F7-F9."""
    p = _table(spark, sf_dir, "part").where(F.lower("p_brand").isin("brand#11", "brand#12", "brand#13", "brand#21"))
    return p.groupBy(exprs.canonical_type(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kind")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query(f"with {_S} select source_id from src where balance >= 1000 and parallax <= 60 and catalog = 'BUILDING'")
def field_filters(spark, sf_dir):
    """F11."""
    s = sources_of(spark, sf_dir)
    cols = {c: F.col(c) for c in s.columns}
    for name, value in (("min_balance", 1000), ("max_parallax", 60), ("catalog", "BUILDING")):
        s = s.where(catalogs.field_filter(name, value, cols))
    return s.select("source_id")


@query(f"""with {_S} select source_id, array_to_string(list_filter([case when not balance > 0 then 'balance' end, case when not parallax > 50 then 'parallax' end, case when not nation > 3 then 'nation' end], lambda x: x is not null), ',') as missing from src""")
def missing_fields(spark, sf_dir):
    """U9, F16."""
    need = {"balance": F.col("balance") > 0, "parallax": F.col("parallax") > 50, "nation": F.col("nation") > 3}
    return sources_of(spark, sf_dir).select("source_id", F.array_join(catalogs.missing_fields(need), ",").alias("missing"))


@query(f"with {_S} select source_id, round(sqrt(balance * balance + parallax * parallax), 6) as motion from src")
def proper_motion(spark, sf_dir):
    """C10."""
    return sources_of(spark, sf_dir).select("source_id", F.round(exprs.proper_motion(F.col("balance"), F.col("parallax")), 6).alias("motion"))


def _propagated_sql() -> str:
    a, b = "(parallax * 1000) * radians(16 / 3600000::double)", "(nation * 100) * radians(16 / 3600000::double)"
    r, d = "radians(ra)", "radians(dec)"
    x = f"cos({d}) * cos({r}) - {a} * sin({r}) - {b} * sin({d}) * cos({r})"
    y = f"cos({d}) * sin({r}) + {a} * cos({r}) - {b} * sin({d}) * sin({r})"
    return f"with {_S}, p as (select source_id, {x} as x, {y} as y, sin({d}) + {b} * cos({d}) as z from src) select source_id, round((degrees(atan2(y, x)) + 360) % 360, 6) as ra, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) as dec from p"


@query(_propagated_sql())
def epoch_propagation(spark, sf_dir):
    """Positions of 2000 at 2016."""
    s = sources_of(spark, sf_dir)
    ra, dec = exprs.propagated(F.col("ra"), F.col("dec"), F.col("parallax") * 1000, F.col("nation") * 100, F.lit(2000.0), F.lit(2016.0))
    return s.select("source_id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(f"{_matches()} select source_id, round(min(separation), 6) as separation from m group by source_id")
def nearest_target(spark, sf_dir):
    """J9, A21."""
    return spatial.nearest_target(targets_of(spark, sf_dir), sources_of(spark, sf_dir), RADIUS, "source_id").select("source_id", F.round("separation", 6).alias("separation"))


@query(f"{_matches()} select catalog, source_id from src s where exists (select 1 from m where m.source_id = s.source_id and m.catalog = s.catalog and separation <= 20.5)")
def allowed_semi(spark, sf_dir):
    """J10."""
    allowed = matches_of(spark, sf_dir, 20.5).select("catalog", "source_id")
    return sources_of(spark, sf_dir).join(allowed, ["catalog", "source_id"], "left_semi").select("catalog", "source_id")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def work_anti(spark, sf_dir):
    """J11."""
    done = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return _table(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""with h as (select s_suppkey as host, unnest(['Customer  ' || (s_suppkey % 40), ' Customer ' || (s_suppkey % 7 * 100000)]) as alias from supplier),
i as (select distinct 'Customer ' || (c_custkey % 30) as k, c_nationkey % 4 as oid from customer),
f as (select host, count(distinct oid) as candidates, min(oid) as oid from h left join i on i.k = trim(regexp_replace(alias, '\\s+', ' ', 'g')) group by host)
select host, case candidates when 0 then 'unmatched' when 1 then 'matched' else 'ambiguous' end as status, candidates, case when candidates = 1 then oid end as oid from f""")
def alias_join_status(spark, sf_dir):
    """J5, A11, A28, U8, C27."""
    k = F.col("s_suppkey")
    hosts = _table(spark, sf_dir, "supplier").select(k.alias("host"), F.array(F.concat(F.lit("Customer  "), k % 40), F.concat(F.lit(" Customer "), k % 7 * 100000)).alias("aliases"))
    ids = _table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer "), F.col("c_custkey") % 30).alias("identifier"), (F.col("c_nationkey") % 4).alias("oid"))
    return catalogs.alias_matches(hosts, ids)


@query(f"""{_matches(20.5)}, n as (select target_id, count(distinct catalog) as objects, min(catalog) as object_id from m where catalog <> 'BUILDING' group by target_id),
t as (select object_id, min(target_id) as target_id from n where objects = 1 group by object_id)
select t0.target_id as source_id, case when t.target_id is not null then 'adopted' when n.objects > 1 then 'ambiguous' when n.objects = 1 then 'conflict' else 'new' end as outcome
from tgt t0 left join n using (target_id) left join t on t.target_id = t0.target_id""")
def identity_conflict(spark, sf_dir):
    """One object to a catalog segment; suppliers arrive as a catalog of their own."""
    store = sources_of(spark, sf_dir).where("catalog <> 'BUILDING'").select("catalog", "source_id", "ra", "dec", F.col("catalog").alias("object_id"))
    arrivals = targets_of(spark, sf_dir).select(F.lit("SUPPLIER").alias("catalog"), F.col("target_id").alias("source_id"), F.col("t_ra").alias("ra"), F.col("t_dec").alias("dec"), F.col("target_id").alias("arrival"))
    return catalogs.resolve_identity(arrivals, store, 20.5).select("source_id", "outcome")


@query("""with o as (select o_orderkey, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) as d from orders where o_orderkey % 5 <> 0),
n as (select o_orderkey, sha256(concat_ws('|', case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end, o_orderpriority)) as d from orders where o_orderkey % 3 <> 0)
select o_orderkey, case when o.d is null then 'added' when n.d is null then 'removed' else 'updated' end as change from o full join n using (o_orderkey) where o.d is distinct from n.d""")
def snapshot_diff(spark, sf_dir):
    """J12, U4, C14."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    digest = lambda status: F.sha2(F.concat_ws("|", status, "o_orderpriority"), 256).alias("digest")
    return catalogs.snapshot_diff(o.where(k % 5 != 0).select(k, digest(F.col("o_orderstatus"))), o.where(k % 3 != 0).select(k, digest(F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))), "o_orderkey")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n = 1""")
def dedupe_first(spark, sf_dir):
    """W5, U2, U3."""
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return catalogs.first_by(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("select l_orderkey, l_linenumber, count(distinct l_partkey) as versions from lineitem group by all having versions > 1")
def conflicting_duplicates(spark, sf_dir):
    """U7, A6, A24."""
    return catalogs.conflicting_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("select kind, count(*) as n, count(distinct key) as keys from (select 'customer' as kind, c_custkey as key from customer union all select 'supplier', s_suppkey from supplier union all select 'part', p_partkey from part) group by kind")
def union_catalogs(spark, sf_dir):
    """U1, A26."""
    parts = [_table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("key")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("select p_brand from part where p_size > 30 intersect select p_brand from part where p_retailprice < 1500")
def intersected_fields(spark, sf_dir):
    """U10."""
    p = _table(spark, sf_dir, "part")
    return p.where("p_size > 30").select("p_brand").intersect(p.where("p_retailprice < 1500").select("p_brand"))


@query("select o_orderpriority as provider, count(*) as records, min(o_orderdate) as first_at, max(o_orderdate) as last_at from orders group by all")
def provider_stats(spark, sf_dir):
    """A8."""
    return catalogs.provider_stats(_table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "provider"), "provider", "o_orderdate")


@query("""with o as (select o_custkey, count(*) as members, bool_or(o_orderstatus = 'F') as has_f, max(o_totalprice) as best from orders group by o_custkey)
select count(*) filter (members >= 5 and has_f) as usable, count(*) as matching, greatest(0, 2000 - count(*) filter (members >= 5 and has_f)) as missing, count(*) filter (members < 5) as gaps from o""")
def coverage_totals(spark, sf_dir):
    """Conditional counts in plain Spark; coverage_request and dataset_origins go through the library."""
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("members"), F.bool_or(F.col("o_orderstatus") == "F").alias("has_f"))
    usable = F.count_if((F.col("members") >= 5) & F.col("has_f"))
    return o.agg(usable.alias("usable"), F.count("*").alias("matching"), F.greatest(F.lit(0).cast("long"), 2000 - usable).alias("missing"), F.count_if(F.col("members") < 5).alias("gaps"))


@query("select l_returnflag, l_linestatus, count(*) as n, case when bool_and(l_discount > 0) then 'complete' when bool_or(l_discount > 0) then 'partial' else 'failed' end as status from lineitem group by all")
def status_histogram(spark, sf_dir):
    """A12, in plain Spark; product_outcomes goes through the library."""
    ok = F.col("l_discount") > 0
    status = F.when(F.bool_and(ok), "complete").when(F.bool_or(ok), "partial").otherwise("failed")
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), status.alias("status"))


@query("select o_orderpriority, o_orderstatus, count(*) as n, case when grouping(o_orderstatus) = 1 then count(*) else 0 end as level from orders group by rollup(o_orderpriority, o_orderstatus)")
def rollup_counts(spark, sf_dir):
    """An extension: totals by group and in all."""
    return _table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.when(F.grouping("o_orderstatus") == 1, F.count("*")).otherwise(F.lit(0)).cast("long").alias("level"))


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one signal to a user: axis in seconds, no errors, quality 0."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("pos"), seconds.alias("axis"), "value", F.lit(None).cast("double").alias("error"), F.lit(0).alias("quality"))


_E = "ev as (select user_id as signal_id, event_id as pos, (epoch_us(ts) - 1704067200000000) / 1e6 as axis, value from events)"


@query(f"""with {_E}, m as (select *, median(value) over (partition by signal_id) as med from ev)
select signal_id, count(*) as n, round(any_value(med), 6) as median, round(1.4826 * median(abs(value - med)), 6) as mad, round(stddev_pop(value), 6) as sd from m group by signal_id""")
def signal_robust_stats(spark, sf_dir):
    """A13, F18."""
    s = signals.robust_stats(signals.usable_samples(samples_of(spark, sf_dir)))
    return s.select("signal_id", "n", *(F.round(c, 6).alias(c) for c in ("median", "mad", "sd")))


@query(f"""with {_E}, c as (select *, avg(value) over (partition by signal_id) as mu from ev), m as (select signal_id, avg(power(value - mu, 2)) as m2, avg(power(value - mu, 3)) as m3, avg(power(value - mu, 4)) as m4 from c group by signal_id)
select signal_id, round(m3 / power(m2, 1.5), 6) as skew, round(m4 / (m2 * m2) - 3, 6) as kurtosis from m""")
def signal_moments(spark, sf_dir):
    """A14."""
    return signals.moments(samples_of(spark, sf_dir)).select("signal_id", F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query(f"with {_E} select signal_id, " + ", ".join(f"round(quantile_cont(value, {q}), 6) as q{round(q * 100):02d}" for q in (0.05, 0.25, 0.75, 0.95)) + " from ev group by signal_id")
def signal_quantiles(spark, sf_dir):
    """A15."""
    s = signals.quantiles(samples_of(spark, sf_dir))
    return s.select("signal_id", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(f"with {_E} select signal_id, round(regr_slope(value, axis) * (max(axis) - min(axis)), 4) as slope from ev group by signal_id")
def signal_slope(spark, sf_dir):
    """A16."""
    return signals.weighted_slope(samples_of(spark, sf_dir)).select("signal_id", F.round("slope", 4).alias("slope"))


@query(f"""with {_E}, a as (select *, (axis - min(axis) over w) / (max(axis) over w - min(axis) over w) as x from ev window w as (partition by signal_id)),
b as (select signal_id, least(floor(x * 32), 31)::bigint as bin, median(value) as m from a group by all),
g as (select signal_id, bin from (select distinct signal_id from b), (select unnest(range(32)) as bin)),
f as (select g.signal_id, g.bin, m from g left join b using (signal_id, bin)),
n as (select *, last_value(case when m is not null then bin end ignore nulls) over p as lb, last_value(m ignore nulls) over p as lm, first_value(case when m is not null then bin end ignore nulls) over q as rb, first_value(m ignore nulls) over q as rm from f
window p as (partition by signal_id order by bin rows between unbounded preceding and current row), q as (partition by signal_id order by bin rows between current row and unbounded following))
select signal_id, bin, round(case when lb is null then rm when rb is null or lb = bin then lm else lm + (rm - lm) * (bin - lb) / (rb - lb) end, 6) as value from n""")
def signal_bins(spark, sf_dir):
    """A17, W8."""
    return signals.shape_bins(samples_of(spark, sf_dir)).select("signal_id", "bin", F.round("value", 6).alias("value"))


@query(f"with {_E}, l as (select signal_id, value, " + ", ".join(f"lead(value, {k}) over w as l{k}" for k in (1, 2, 4, 8)) + " from ev window w as (partition by signal_id order by axis, pos)) select signal_id, " + ", ".join(f"round(coalesce(corr(value, l{k}), 0), 6) as lag{k}" for k in (1, 2, 4, 8)) + " from l group by signal_id")
def signal_autocorrelation(spark, sf_dir):
    """A18, W3."""
    s = signals.autocorrelation(samples_of(spark, sf_dir))
    return s.select("signal_id", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(f"""with {_E}, d as (select signal_id, abs((value - lag(value) over w) / greatest(axis - lag(axis) over w, 2.220446049250313e-16)) as d from ev window w as (partition by signal_id order by axis, pos))
select signal_id, round(median(d), 8) as derivative from d where d is not null group by signal_id""")
def signal_derivative(spark, sf_dir):
    """A19, W3."""
    return signals.median_derivative(samples_of(spark, sf_dir)).select("signal_id", F.round("derivative", 8).alias("derivative"))


@query()
def signal_vectors(spark, sf_dir):
    """Tests hold the vectors against NumPy."""
    return signals.represent(samples_of(spark, sf_dir)).select("signal_id", "good_fraction", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


@query(f"""with {_E}, m as (select *, median(value) over (partition by signal_id) as med, count(*) over (partition by signal_id) as n from ev),
s as (select signal_id, any_value(med) as med, 1.4826 * median(abs(value - med)) as mad, stddev_pop(value) as sd, min(axis) as t0, max(axis) as t1 from m where n >= 8 group by signal_id),
z as (select signal_id, pos, axis, (value - s.med) / case when mad > 0 then mad else sd end as v, t0, t1 from m join s using (signal_id) where t1 > t0 and (mad > 0 or sd > 0)),
l as (select *, avg(v) over (partition by signal_id) as mu, {", ".join(f"lead(v, {k}) over w as l{k}" for k in (1, 2, 4, 8))}, abs((v - lag(v) over w) / greatest(axis - lag(axis) over w, 2.220446049250313e-16)) as d from z window w as (partition by signal_id order by axis, pos)),
t as (select signal_id, [avg(v), stddev_pop(v), min(v), max(v), quantile_cont(v, 0.05), quantile_cont(v, 0.25), quantile_cont(v, 0.75), quantile_cont(v, 0.95), avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5), avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3,
    median(d), (sum(axis * v) - sum(axis) * sum(v) / count(*)) / (sum(axis * axis) - sum(axis) * sum(axis) / count(*)) * (max(axis) - min(axis))] as head, [{", ".join(f"corr(v, l{k})" for k in (1, 2, 4, 8))}] as lags from l group by signal_id),
b as (select signal_id, least(floor((axis - t0) / (t1 - t0) * 32), 31)::bigint as bin, median(v) as m from z group by all),
f as (select g.signal_id, g.bin, m from (select signal_id, unnest(range(32)) as bin from t) g left join b using (signal_id, bin)),
n as (select *, last_value(case when m is not null then bin end ignore nulls) over p as lb, last_value(m ignore nulls) over p as lm, first_value(case when m is not null then bin end ignore nulls) over q as rb, first_value(m ignore nulls) over q as rm from f
window p as (partition by signal_id order by bin rows between unbounded preceding and current row), q as (partition by signal_id order by bin rows between current row and unbounded following)),
h as (select signal_id, list(case when lb is null then rm when rb is null or lb = bin then lm else lm + (rm - lm) * (bin - lb) / (rb - lb) end order by bin) as bins from n group by signal_id),
r as (select signal_id, list_transform(list_concat(head, bins, lags), lambda x: case when isfinite(coalesce(x, 0)) then coalesce(x, 0) else 0 end) as raw from t join h using (signal_id))
select signal_id, place, round(x / norm, 6) + 0 as value from (select signal_id, unnest(range(48)) as place, unnest(raw) as x, sqrt(list_sum(list_transform(raw, lambda y: y * y))) as norm from r)""")
def signal_vector_values(spark, sf_dir):
    """The 48 values of each signal's vector, by their places."""
    v = signals.represent(samples_of(spark, sf_dir)).select("signal_id", F.posexplode("vector").alias("place", "x"))
    return v.select("signal_id", F.col("place").cast("long").alias("place"), (F.round("x", 6) + 0.0).alias("value"))


@query(f"""with {_E}, z as (select *, min(axis) over (partition by signal_id) as t0 from ev), p as (select *, ((axis - t0) / 86400) % 1 as f from z)
select signal_id, pos, round(case when f > 0.5 then f - 1 else f end, 6) + 0 as phase from p""")
def phase_fold(spark, sf_dir):
    """C11, W9."""
    return signals.folded(samples_of(spark, sf_dir), 86400).select("signal_id", "pos", F.round("phase", 6).alias("phase"))


@query(f"with {_E} select signal_id, pos, round(value / median(value) over (partition by signal_id), 6) as value from ev")
def normalized_flux(spark, sf_dir):
    """C13, N5."""
    return signals.normalized(samples_of(spark, sf_dir)).select("signal_id", "pos", F.round("value", 6).alias("value"))


_QUERIES = "vec_id % 100 = 0"
_DIST = "greatest(0, least(2, 1 - list_dot_product(q.e, r.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(r.e, r.e)))))"
_PAIRS = f"""with v as (select vec_id, label, embedding::double[] as e from embeddings), p as (select q.vec_id as query_id, r.vec_id, {_DIST} as d from v q join v r on r.label = q.label and r.vec_id <> q.vec_id where q.{_QUERIES})"""


def _as_signals(spark, sf_dir, observed: str, references: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings for which observed holds as signals, those for which references holds as references of their label; every eleventh reference lies near all signals."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("modality"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(0.0).alias("ra"))
    apart = F.when(F.col("vec_id") % 11 == 0, 0.0).otherwise(1.0)
    return e.where(observed).select(F.col("vec_id").alias("signal_id"), "ra", F.lit(0.0).alias("dec"), F.lit(1.0).alias("good_fraction"), "vector", "modality"), e.where(references).select(F.col("vec_id").alias("catalog_id"), "ra", apart.alias("dec"), "modality", "vector")


def _reference_status(spark, sf_dir) -> DataFrame:
    """Every vector whose id 100 divides against all others of its label."""
    found = signals.cross_reference(*_as_signals(spark, sf_dir, _QUERIES, "true"), support=0.9, but_own=True)
    return found.where("comparable > 0").withColumnRenamed("signal_id", "query_id")


@query(f"{_PAIRS} select query_id, round(min(d), 6) as nearest, count(*) as comparable from p group by query_id")
def cosine_nearest(spark, sf_dir):
    """J4, C9, A21."""
    return _reference_status(spark, sf_dir).select("query_id", F.round("nearest", 6).alias("nearest"), "comparable")


@query(f"""{_PAIRS}, s as (select query_id, count(*) filter (vec_id % 11 = 0 and d <= 0.9) as supported, count(*) filter (vec_id % 11 = 0) as candidates, count(*) as comparable, min(d) as nearest from p group by query_id)
select query_id, case when supported = 1 then 'matched' when supported > 1 then 'ambiguous' when candidates > 0 then 'position_only_review' when comparable = 0 then 'insufficient_reference_coverage' when nearest >= 0.45 then 'novelty_review_candidate' else 'unmatched' end as status from s""")
def triage(spark, sf_dir):
    """Every eleventh reference counts as near."""
    return _reference_status(spark, sf_dir).select("query_id", "status")


@query(f"""{_PAIRS}, s as (select query_id, count(*) filter (vec_id % 11 = 0 and d <= 0.9) as supported, count(*) filter (vec_id % 11 = 0) as candidates, count(*) as comparable, min(d) as nearest from p group by query_id),
t as (select vec_id as query_id, coalesce(supported, 0) as supported, coalesce(candidates, 0) as candidates, coalesce(comparable, 0) as comparable, nearest from v left join s on query_id = vec_id where {_QUERIES})
select query_id, round(nearest, 6) as nearest, supported, candidates, comparable, case when supported = 1 then 'matched' when supported > 1 then 'ambiguous' when candidates > 0 then 'position_only_review' when comparable = 0 then 'insufficient_reference_coverage' when nearest >= 0.45 then 'novelty_review_candidate' else 'unmatched' end as status from t""")
def cross_reference(spark, sf_dir):
    """Every vector whose id 100 divides against all others of its label."""
    found = signals.cross_reference(*_as_signals(spark, sf_dir, _QUERIES, "true"), support=0.9, but_own=True)
    return found.select(F.col("signal_id").alias("query_id"), F.round("nearest", 6).alias("nearest"), "supported", "candidates", "comparable", "status")


@query(f"with {_S} select catalog, round((degrees(atan2(avg(sin(radians(ra))), avg(cos(radians(ra))))) + 360) % 360, 6) as ra, round(avg(dec), 6) as dec from src group by catalog")
def circular_center(spark, sf_dir):
    """A22."""
    return spatial.circular_center(sources_of(spark, sf_dir), ["catalog"]).select("catalog", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query(f"with {_S} select source_id, round((((ra - 0.3 + 180) % 360 + 360) % 360 - 180) * cos(radians(10.1)) * 3600, 4) + 0 as east, round((dec - 10.1) * 3600, 4) + 0 as north from src")
def tangent_offsets(spark, sf_dir):
    """C12."""
    east, north = exprs.tangent_offsets(F.col("ra"), F.col("dec"), F.lit(0.3), F.lit(10.1))
    return sources_of(spark, sf_dir).select("source_id", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 100 order by o_orderkey limit 250")
def keyset_page(spark, sf_dir):
    """A page of the keyset scan."""
    return keyset.page(_table(spark, sf_dir, "orders"), "o_orderkey", 100, 250).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders")
def keyset_scan(spark, sf_dir):
    """S2, ST6: the whole table by pages, as a stream whose offsets are cursors, stopped once and taken up again."""
    spark.dataSource.register(keyset.Keyset)
    root = f"{store.shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    orders.write.parquet(f"{root}/orders")
    limit = max(keyset.LIMIT, orders.count() // 8)

    def scan(stop_after: int | None) -> None:
        pages = spark.readStream.schema(orders.schema).format("keyset").option("path", f"{root}/orders").option("key", "o_orderkey").option("limit", limit).load()
        running = pages.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").start(f"{root}/pages")
        try:
            while stop_after and running.isActive and len(running.recentProgress) < stop_after:
                running.awaitTermination(1)
            if not stop_after:
                running.processAllAvailable()
        finally:
            running.stop()

    scan(2)
    scan(None)
    return spark.read.schema(orders.schema).parquet(f"{root}/pages")


@query("select c_custkey, c_acctbal > 5000 as reused from customer order by reused desc, c_custkey limit 100")
def count_limited(spark, sf_dir):
    """A request's count, reused objects first."""
    return _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("reused")).orderBy(F.desc("reused"), "c_custkey").limit(100)


@query("select c_custkey, ((c_acctbal::bigint * 7) % 360 + 360) % 360 as ra, case when abs(c_acctbal) / 100 <= 90 then 'valid' else 'quarantined' end as status from customer")
def coordinate_check(spark, sf_dir):
    """C4, F14; normalized_sources goes through the whole normalisation."""
    c = _table(spark, sf_dir, "customer").withColumns({"raw": F.bround("c_acctbal").cast("long") * 7, "dec": F.abs("c_acctbal") / 100})
    ok = exprs.valid_position(F.col("raw").cast("double"), F.col("dec"))
    return c.select("c_custkey", F.pmod("raw", F.lit(360)).cast("long").alias("ra"), F.when(ok, "valid").otherwise("quarantined").alias("status"))


@query("select p_partkey, field, value from (select p_partkey, unnest(['size', 'price']) as field, unnest([p_size::double, p_retailprice]) as value from part) where value between -100 and 1200")
def measurement_unpivot(spark, sf_dir):
    """An unpivot in plain Spark; photometry goes through the library."""
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(F.array(F.struct(F.lit("size").alias("field"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("price").alias("field"), F.col("p_retailprice").alias("value")))).alias("m")).select("p_partkey", "m.field", "m.value").where("value between -100 and 1200")


@query("select sha256('[\"' || c_mktsegment || '\", \"' || c_custkey || '\"]')[1:32] as object_id, c_custkey, 'customer:' || replace(replace(c_name, ' ', '%20'), '#', '%23') as entity from customer")
def stable_ids(spark, sf_dir):
    """C14-C16."""
    return _table(spark, sf_dir, "customer").select(exprs.object_id(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("object_id"), "c_custkey", exprs.entity_id("customer", F.col("c_name")).alias("entity"))


@query("""select 'host:' || n_nationkey as from_id, 'region:' || n_regionkey as to_id, 'part_of' as relation from nation
union all select 'planet:' || s_suppkey, 'host:' || s_nationkey, 'orbits' from supplier""")
def relationship_edges(spark, sf_dir):
    """A union of edges in plain Spark; planet_edges and planet_map_rows go through the library."""
    at = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    hosts = _table(spark, sf_dir, "nation").select(at("host", "n_nationkey").alias("from_id"), at("region", "n_regionkey").alias("to_id"), F.lit("part_of").alias("relation"))
    return hosts.unionByName(_table(spark, sf_dir, "supplier").select(at("planet", "s_suppkey").alias("from_id"), at("host", "s_nationkey").alias("to_id"), F.lit("orbits").alias("relation")))


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark, sf_dir):
    """An extension: daily windows of a stream's rows."""
    w = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as n from events")
def sliding_counts(spark, sf_dir):
    """Requests within the window before each."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-86400000000, 0)
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("n"))


def _requests(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")


_REQUESTS_SQL = """
    select user_id::varchar as key, event_id as id, epoch_us(ts) / 1e6 as seconds, value > 40 as ok, row_number() over (partition by user_id order by ts, event_id) as n
    from events"""


@query(f"""
with recursive e as ({_REQUESTS_SQL}),
walk as (
    select key, id, seconds, n, true as allowed, [seconds] as kept from e where n = 1
    union all
    select key, id, seconds, n, len(live) < 3, case when len(live) < 3 then list_append(live, seconds) else live end
    from (select e.*, list_filter(w.kept, lambda x: e.seconds - x < 86400) as live from walk w join e on e.key is not distinct from w.key and e.n = w.n + 1))
select key, id, seconds, allowed from walk""")
def quota_sliding(spark, sf_dir):
    """ST3: of each user's events, which a quota of 3 a day lets pass."""
    return quota.quota_table(_requests(spark, sf_dir), 3, 86400)


@query(f"""
with recursive e as ({_REQUESTS_SQL}),
fed as (
    select key, n, id, case when ok then 0 else 1 end as failed, 'closed' as state, seconds as opened from e where n = 1
    union all
    select key, n, id,
        case when rested then (case when ok then 0 else 3 end) when state = 'open' then failed when ok then 0 else failed + 1 end,
        case when rested then (case when ok then 'closed' else 'open' end) when state = 'open' or not ok and failed + 1 >= 3 then 'open' else 'closed' end,
        case when rested or (state = 'closed' and not ok and failed + 1 >= 3) then seconds else opened end
    from (select e.*, f.state, f.failed, f.opened, f.state = 'open' and e.seconds - f.opened >= 86400 as rested from fed f join e on e.key is not distinct from f.key and e.n = f.n + 1))
select key, id, state from fed""")
def circuit_breaker(spark, sf_dir):
    """ST2: each user's breaker after each event, of which values up to 40 fail; 3 in a row open it for a day."""
    outcomes = _requests(spark, sf_dir).select("key", "id", (F.unix_micros("ts") / 1e6).alias("seconds"), (F.col("value") > 40).alias("ok"))
    return quota.breaker_states(outcomes, 3, 86400)


@query("""select * from orders""")
def export_roundtrip(spark, sf_dir):
    """A dataset whose format its size decides, written with its manifest and read back."""
    path = f"{store.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exports.materialize(_table(spark, sf_dir, "orders"), path)
    return exports.read_back(spark, path)


@query(f"""with recursive {_matches(20.5)[5:]}, k as (select *, {_score('separation', 'error')} as confidence, catalog || chr(31) || source_id as key from m),
f as (select * from (select *, row_number() over (partition by target_id, catalog order by separation, source_id) as n from k where confidence >= 0.5 and separation >= 3.5 and parallax > 0 and 1000 / parallax <= 100) where n <= 2),
e as (select a.target_id, a.key as a, b.key as b from f a join f b using (target_id) where a.key <> b.key and {_sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= greatest(20.5, a.error, b.error)),
reach as (select target_id, key as a, key as b from f union select r.target_id, r.a, e.b from reach r join e on e.target_id = r.target_id and e.a = r.b),
r as (select target_id, a as key, min(b) as root from reach group by target_id, a), g as (select f.*, root, min((separation, key)) over (partition by f.target_id, root) as near from f join r using (target_id, key))
select target_id, source_id, round(confidence, 6) as confidence, dense_rank() over (partition by target_id order by near) as object from g""")
def search_request(spark, sf_dir):
    """The whole search for all targets."""
    request = search.Search(radius_arcsec=20.5, min_radius_arcsec=3.5, mode="shell", min_confidence=0.5, max_results=2, max_distance_pc=100.0)
    found = search.crossmatch(targets_of(spark, sf_dir), sources_of(spark, sf_dir).withColumnRenamed("error", "error_arcsec"), request)
    return found.select("target_id", "source_id", F.round("confidence", 6).alias("confidence"), F.col("object").cast("long").alias("object"))


@query("""select n_name as host, count(*) as planet_count, array_to_string(list_sort(list(s_name)), ',') as planets, case when n_nationkey % 3 = 0 then 'matched' else 'unavailable' end as status, 'host:' || replace(n_name, ' ', '%20') as id
from supplier join nation on n_nationkey = s_nationkey group by all""")
def system_grouping(spark, sf_dir):
    """Suppliers as planets of their nations."""
    nation = _table(spark, sf_dir, "nation")
    p = _table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("host"))  # 25 rows
    hosts = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("host"), F.lit("matched").alias("status"), F.col("n_nationkey").alias("oid"))
    found = planets.systems(p, hosts)
    return found.select("host", "planet_count", F.array_join("planets", ",").alias("planets"), "status", "id")


@query("""with f as (select *, 'u' || (l_partkey % 500) as uri, row_number() over (partition by l_partkey % 500 order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as n from lineitem where l_partkey % 500 <> 0),
o as (select o_orderkey, o_orderstatus from orders) select uri as data_uri, l_orderkey as parent, o_orderstatus as observation from f left join o on o_orderkey = l_orderkey where n = 1""")
def product_listing(spark, sf_dir):
    """The first product of each URI with its observation."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    files = _table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 500 != 0, F.concat(F.lit("u"), F.col("l_partkey") % 500)).alias("data_uri"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("int").alias("sequence_number"), F.col("l_orderkey").alias("parent_obsid"), order.alias("arrival"))
    observations = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obsid"), F.col("o_orderstatus").alias("obs_id"), F.lit(None).cast("int").alias("sequence_number"))
    return products.listed(files, observations).select("data_uri", F.col("parent_obsid").alias("parent"), F.col("mast_obs_id").alias("observation"))


@query(f"""with {_S}, c as (select *, 'o' || (source_id % 400) as object_id, case when balance > 0 then balance end as mass, case when nation > 4 then parallax end as plx from src where catalog in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')),
o as (select object_id, count(*) as members, arg_min(mass, (catalog, source_id)) filter (mass is not null) as mass, arg_min(plx, (catalog, source_id)) filter (plx is not null) as plx from c group by object_id)
select object_id, members, array_to_string(list_filter([case when mass is null then 'mass' end, case when plx is null then 'plx' end], lambda x: x is not null), ',') as missing, mass is not null and plx is not null and members >= 2 as usable from o where plx is null or plx >= 20""")
def coverage_objects(spark, sf_dir):
    """Which stored objects a request can use, and what others lack."""
    s = sources_of(spark, sf_dir).withColumns({"object_id": F.concat(F.lit("o"), F.col("source_id") % 400), "mass": F.when(F.col("balance") > 0, F.col("balance")), "plx": F.when(F.col("nation") > 4, F.col("parallax"))})
    request = fulfilment.Request(100, catalogs=("BUILDING", "MACHINERY", "AUTOMOBILE"), fields=("mass",), filters=(("min_plx", 20),), members=2)
    return fulfilment.coverage(s, request).drop("missing_products").withColumn("missing", F.array_join("missing", ","))


def _registry(spark, sf_dir) -> DataFrame:
    """Nations as catalogs: regions as wavelengths, every fifth not enabled, two of three with profiles."""
    nation = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    k = F.col("n_nationkey")
    profiles = F.when(k % 3 == 0, F.array(F.lit("full"), F.lit("stellar"))).when(k % 3 == 1, F.array(F.lit("radio"))).otherwise(F.array().cast("array<string>"))
    return nation.select(F.col("n_name").alias("catalog"), F.concat(F.lit("p"), k % 4).alias("provider"), F.col("r_name").alias("wavelength"), (k % 5 != 0).alias("enabled"), profiles.alias("profiles"), k.alias("nation"))


def _planned(spark, sf_dir, request: search.Search, strict: bool) -> DataFrame:
    """Catalog, wavelength and number of sources of the catalogs that a request reads."""
    plan = F.broadcast(request.plan(_registry(spark, sf_dir), strict))  # 25 rows at most
    counts = sources_of(spark, sf_dir).join(plan.select("nation"), "nation", "left_semi").groupBy("nation").agg(F.count("*").alias("sources"))
    return plan.join(counts, "nation", "left").select("catalog", "wavelength", F.coalesce("sources", F.lit(0)).alias("sources"))


@query("""with c as (select n_name as catalog, r_name as wavelength, n_nationkey as k from nation join region on r_regionkey = n_regionkey where n_nationkey % 5 <> 0 and n_nationkey % 3 = 0 and n_name in ('NATION_3', 'NATION_4', 'NATION_6', 'NATION_9', 'NATION_15', 'NATION_18', 'NATION_24'))
select catalog, wavelength, count(c_custkey) as sources from c left join customer on c_nationkey = k group by all""")
def catalog_plan(spark, sf_dir):
    """Of nations as catalogs those that a request reads, with their sources."""
    return _planned(spark, sf_dir, search.Search(catalogs=("NATION_3", "NATION_4", "NATION_6", "NATION_9", "NATION_15", "NATION_18", "NATION_24"), profiles=("stellar",)), True)


@query(f"""with {_S} select source_id, 'https://ned.ipac.caltech.edu/byname?objname=' || source_id as ned, 'https://mast.stsci.edu/portal/Mashup/Clients/Mast/Portal.html?searchQuery=' || nation || '%20' || (nation + 1) as mast from src""")
def outbound_links(spark, sf_dir):
    """P5."""
    s = sources_of(spark, sf_dir)
    found = registry.links(F.lit("ned"), F.col("source_id").cast("string"), F.col("nation"), F.col("nation") + 1, F.lit("mast"))
    return s.select("source_id", found["NED"].alias("ned"), found["MAST"].alias("mast"))


@query("select 'planet:' || replace(replace(p_name, ' ', '%20'), '#', '%23') as id, p_name || ' orbits ' || p_brand || '. Size: ' || case when p_size > 40 then 'at most ' else '' end || p_size || '.0 cm.' as text from part")
def planet_texts(spark, sf_dir):
    """P9, P10, C16."""
    p = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("host"), F.col("p_size").alias("size"), F.when(F.col("p_size") > 40, 1).alias("sizelim"))
    return p.select(exprs.entity_id("planet", F.col("name")).alias("id"), planets.described(F.col("name"), F.col("host"), planets.measurements(p, {"size": ("Size", "cm")})).alias("text"))
