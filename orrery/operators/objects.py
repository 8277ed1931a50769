"""Objects of the store: their members and products as records, a member's values, rows of a dataset, and the dataset itself.

Members are rows of object_id, catalog, source_id, ra, dec, data (map of texts), metadata and physical values; a
record holds one object's members, so its size is that of an object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegralType, MapType, StructType

from orrery.functions import exprs
from orrery.operators import catalogs, groups, search
from orrery.operators.store import cut
from orrery.sources import exports

#: What a stored source keeps; scores and separations belong to a request.
SOURCE = ("catalog", "source_id", "ra", "dec", "data", "metadata", "provenance", "error_arcsec", "epoch", "pmra", "pmdec")
_KEY = ("catalog", "source_id", "ra", "dec")
_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*(\.[A-Za-z_][A-Za-z_0-9]*)?")


def rehydrated(rows: DataFrame) -> DataFrame:
    """rows with the columns of a stored source and object_id only."""
    return catalogs.picked(rows, ["object_id", *SOURCE])


def records(members: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """object_id, members (by catalog, then source) and products (by name) of each object.

    products: object_id, product, body; of rows that repeat a product the last body in its order counts.
    """
    told = F.struct(*[c for c in members.columns if c != "object_id"])
    ranked = F.struct(F.struct("catalog", F.col("source_id").cast("string").alias("k")).alias("rank"), told.alias("row"))
    whole = members.groupBy("object_id").agg(exprs.by_rank(F.collect_list(ranked)).alias("members"))
    empty = F.create_map().cast("map<string,string>")
    if products is None:
        return whole.withColumn("products", empty)
    one = products.groupBy("object_id", "product").agg(F.max("body").alias("body"))
    by = one.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product", "body")))).alias("products"))
    return whole.join(by, "object_id", "left").withColumn("products", F.coalesce("products", empty))


def put_products(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """stored products with those that arrived in their place or beside them; an empty body changes nothing."""
    new = arrived.where(F.coalesce(F.col("body") != "", F.lit(False))).groupBy("object_id", "product").agg(F.max("body").alias("body"))
    return stored.join(new, ["object_id", "product"], "left_anti").select("object_id", "product", "body").unionByName(new)


def values(data: Column, physical: Column, top: dict[str, Column]) -> Column:
    """A member's values by name as texts: its data, over these its physical values, over these its own columns.

    A later value stands before an earlier one even if it is null.
    """
    own = F.create_map(*(x for name, c in top.items() for x in (F.lit(name), c.cast("string"))))
    return exprs.layered(data, physical, own)


def first_value(members: Column, name: str) -> Column:
    """The first present value of a field among members (catalog, values), or of the catalog that the name is qualified with."""
    catalog, dot, field = name.rpartition(".")
    some = F.filter(members, lambda m: m["catalog"] == catalog) if dot else members
    found = F.transform(some, lambda m: m["values"][field])
    there = F.filter(found, lambda v: v.isNotNull() & (v != "") & ~F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity"))
    return F.get(there, 0)


def output_rows(found: DataFrame, fields: tuple[str, ...] = (), products: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record(object_id, members with catalog, source_id, ra, dec and values, products).

    The key columns are those of the first member. Named fields are columns; without any, all present values of
    all members are in the map fields, by catalog and name. Products are columns of their names.
    """
    first = F.get("members", 0)
    key = [F.col("object_id"), *(first[c].alias(c) for c in _KEY)]
    there = lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*_KEY)
    wide = F.flatten(F.transform("members", lambda m: F.transform(F.map_entries(F.map_filter(m["values"], there)), lambda e: F.struct(F.concat(m["catalog"], F.lit("."), e["key"]).alias("key"), e["value"].alias("value")))))
    # of a catalog's several members the last one's value counts
    placed = F.array_sort(F.transform(wide, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("at"), e["value"].alias("value"))))
    told = found.select(*found.columns, placed.alias("__placed"))
    first_of = lambda e, i: (i == 0) | (F.get("__placed", i - 1)["key"] != e["key"])
    last = F.transform(F.filter("__placed", first_of), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    named = [first_value(F.col("members"), f).alias(f) for f in fields] or [F.map_from_entries(last).alias("fields")]
    return told.select(*key, *named, *(F.col("products")[p].alias(p) for p in products))


def _on_the_sky(page: DataFrame) -> Column:
    return exprs.valid_position(F.col("ra"), F.col("dec"), F.col("epoch") if "epoch" in page.columns else None)


def invalid_rows(page: DataFrame) -> DataFrame:
    """The rows that within_page counts as invalid."""
    return page.where(~_on_the_sky(page))


def within_page(page: DataFrame, radius_arcsec: float) -> tuple[DataFrame, DataFrame]:
    """Rows of a page(t_ra, t_dec, ra, dec, epoch) that lie within the radius, and one row with the count of invalid ones.

    Pages of a source may reach further than was asked for; rows without a valid position or epoch are counted only.
    """
    ok = _on_the_sky(page)
    near = exprs.angular_separation(F.col("t_ra"), F.col("t_dec"), F.col("ra"), F.col("dec")) <= radius_arcsec
    return page.where(ok & near), page.agg(F.count_if(~ok).alias("invalid"))


def kinds(rows: DataFrame) -> DataFrame:
    """column and kind (int, float, bool, nested, str or null) for each kind of value that a column holds.

    A column of texts holds the kinds that its texts read as, whole numbers before others.
    """

    def kind(name: str) -> Column:
        c, t = F.col(f"`{name}`"), rows.schema[name].dataType
        if isinstance(t, BooleanType):
            told = F.lit("bool")
        elif isinstance(t, (StructType, ArrayType, MapType)):
            told = F.lit("nested")
        elif isinstance(t, IntegralType):
            told = F.lit("int")
        elif isinstance(t, FractionalType):
            told = F.lit("float")
        else:
            told = F.when(c.try_cast("long").isNotNull() & c.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(c.try_cast("double").isNotNull(), "float").when(F.lower(c).isin("true", "false"), "bool").otherwise("str")
        return F.struct(F.lit(name).alias("column"), F.when(c.isNotNull(), told).otherwise("null").alias("kind"))

    return rows.select(F.explode(F.array(*map(kind, rows.columns))).alias("x")).select("x.column", "x.kind").distinct()


@dataclass(frozen=True)
class DatasetRequest:
    """A dataset to be built: around targets (D2), or a count of objects that have what is named."""

    name: str
    profile: str = "full"
    targets: tuple[tuple[float, float], ...] = ()
    count: int | None = None
    catalogs: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    filters: tuple[tuple[str, object], ...] = ()
    quality: tuple[tuple[str, object], ...] = ()
    max_results: int | None = None

    def problems(self, selected: set[str] | None = None) -> list[str]:
        """What makes the request invalid (F24); selected: the catalogs that its plan reads, if they are known."""
        named = [*self.fields, *(k for k, _ in self.filters), *(k for k, _ in self.quality)]
        bare = [n.removeprefix("min_").removeprefix("max_") for n in named]
        bad_target = [t for t in self.targets if not all(x == x and abs(x) != float("inf") for x in t) or abs(t[1]) > 90]
        checks = [
            (not self.name.strip() or not self.profile.strip(), "name and profile must not be blank"),
            (self.count is None and bool(self.fields or self.products or self.quality), "fields, products and quality need a count"),
            (self.count is not None and self.max_results is not None, "a count bounds the results already"),
            (self.count is None and not self.targets, "without a count there must be targets"),
            (bool(bad_target), "a target isn't on the sky"),
            (any(not _NAME.fullmatch(n) for n in named), "a field's name can't be one"),
            (selected is not None and not selected, "no catalog fits the profile and the catalogs"),
            (selected is not None and any("." in n and n.split(".", 1)[0] not in selected for n in bare), "a field's catalog isn't read"),
        ]
        return [told for wrong, told in checks if wrong]


def create_dataset(targets: DataFrame, sources: DataFrame, request: search.Search, path: str, asked: str | None = None) -> dict:
    """The dataset around targets: cross-matched, objects with detections enough, filtered, each source once, written; its manifest.

    targets and sources are those of search.crossmatch; request.filters are compared with the sources' columns.
    An object counts if it has request.count_threshold detections.
    """
    if _by_nearest(targets, sources, request):
        return exports.materialize(_once_by_nearest(targets, sources, request), path, asked)
    return exports.materialize(_once(targets, sources, request), path, asked)


def _once(targets: DataFrame, sources: DataFrame, request: search.Search) -> DataFrame:
    """Each source of a dataset once, at its nearest target, by all matches."""
    found = search.crossmatch(targets, sources, request)
    for name, value in request.filters.items():
        found = found.where(catalogs.field_filter(name, value, {c: F.col(c) for c in found.columns}))
    sizes = found.groupBy("target_id", "object").agg(F.count("*").alias("__n")).where(F.col("__n") >= request.count_threshold).drop("__n")
    kept = found.join(sizes, ["target_id", "object"], "left_semi")
    return catalogs.first_by(kept, ["catalog", "source_id"], [F.col("separation"), F.col("target_id")])


def _by_nearest(targets: DataFrame, sources: DataFrame, request: search.Search) -> bool:
    """Whether sources tell by themselves which of them match and count: nothing but the radius asks for a match's separation, links are within the radius, targets are told apart."""
    named = {name.removeprefix("min_").removeprefix("max_") for name in request.filters}
    if request.adaptive or request.max_results is not None or request.min_confidence > 0 or request.mode == "shell" or request.zones or "t_epoch" in targets.columns or request.problems():
        return False
    if not named <= {*sources.columns, "proper_motion_masyr"} or set(sources.columns) & {*targets.columns, "separation", "confidence", "key", "object"}:
        return False
    widest = sources.agg(F.max(exprs.finite_or_null(F.col("error_arcsec").cast("double")))).first()[0] or 0.0
    return widest <= request.radius_arcsec and targets.groupBy("target_id").count().where("count > 1").isEmpty()


def _once_by_nearest(targets: DataFrame, sources: DataFrame, request: search.Search) -> DataFrame:
    """_once without matches being written: tasks tell each source's nearest target that counts, and only those pairs are matches.

    Where two are nearest within a hair, the separation and the order are those of all other queries.
    """
    if request.catalogs:
        sources = sources.where(F.col("catalog").isin(*request.catalogs))
    sources = sources.where(request.condition(sources.columns))
    counts = [catalogs.field_filter(name, value, {c: F.col(c) for c in sources.columns}) for name, value in request.filters.items()]
    sources = sources.withColumns({"key": F.concat_ws("\x1f", "catalog", F.col("source_id").cast("string")), "__counts": reduce(and_, counts, F.lit(True))})
    near, crowded = groups.nearest_objects(targets, sources.select("key", "ra", "dec", F.col("__counts").alias("counts")), request.radius_arcsec, "target_id", "key", request.count_threshold)
    near = cut(near, "nearest")
    placed = [targets.where(exprs.valid_position(F.col("t_ra"), F.col("t_dec"))), sources.where(exprs.valid_position(F.col("ra"), F.col("dec")) & F.col("__counts"))]
    found = near.join(placed[0], "target_id").join(placed[1], "key")
    found = found.withColumn("separation", exprs.angular_separation(F.col("t_ra"), F.col("t_dec"), F.col("ra"), F.col("dec"))).where(F.col("separation") <= request.radius_arcsec)
    found = found.withColumn("confidence", exprs.match_score(F.col("separation"), F.col("error_arcsec"), F.col("t_uncertainty_arcsec") if "t_uncertainty_arcsec" in targets.columns else None))
    columns = ["target_id", "object", *(c for c in targets.columns if c != "target_id"), *(c for c in sources.columns if c not in ("key", "__counts")), "separation", "confidence"]
    found = found.select(*columns)
    if not crowded.isEmpty():
        rest = _once(targets.join(crowded.select("target_id"), "target_id", "left_semi"), sources.drop("key", "__counts"), request)
        found = found.unionByName(rest.select(*columns))
    return catalogs.first_by(found, ["catalog", "source_id"], [F.col("separation"), F.col("target_id")])
