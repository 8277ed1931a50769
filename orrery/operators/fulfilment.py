"""Count-driven datasets: how far the store covers a request, and rounds that fill the gaps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import catalogs, spatial
from orrery.operators.search import Search
from orrery.operators.store import cut, first_rows

#: Objects whose gaps a round looks at, rounds at most, and rounds without progress before it gives up.
GAPS, ROUNDS, STUCK = 128, 1000, 25
#: Units of work in a batch.
BATCH = 16


@dataclass(frozen=True)
class Request:
    """How many objects are wanted, and what each must have."""

    count: int
    catalogs: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    filters: tuple[tuple[str, object], ...] = ()
    members: int = 1
    radius_arcsec: float = 3.0
    min_confidence: float = 0.5
    versions: tuple[tuple[str, str], ...] = ()
    products: tuple[str, ...] = ()
    search: Search | None = None


def coverage(store: DataFrame, request: Request, targets: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """object_id, members, missing (fields), missing_products and usable for each stored object that the request matches.

    store: object_id, catalog, source_id, ra, dec, error_arcsec and the fields; products: object_id, product, body.
    A member counts if its catalog is asked for, if its catalog_version is the one that the request names for
    the catalog, and, with targets, if one is within the radius and confident enough. Of an object's members one
    at least must meet the search's filters. An object's field is its first present value by catalog and
    source; one that a filter names but no member has is missing.
    """
    rows = store.where(F.col("catalog").isin(*request.catalogs)) if request.catalogs else store
    for catalog, version in request.versions:
        rows = rows.where((F.col("catalog") != catalog) | F.coalesce(F.col("catalog_version") == version, F.lit(False)))
    rows = rows if targets is not None else rows.withColumn("separation", F.lit(0.0))
    if targets is not None:
        near = spatial.cone_join(targets, rows.select("catalog", "source_id", "ra", "dec", "error_arcsec"), request.radius_arcsec)
        near = near.groupBy("catalog", "source_id").agg(F.min("separation").alias("separation"), F.first("error_arcsec").alias("e"))
        near = near.where(exprs.match_score(F.col("separation"), F.col("e")) >= request.min_confidence)
        rows = rows.join(near.select("catalog", "source_id", "separation"), ["catalog", "source_id"])
    named = [k.removeprefix("min_").removeprefix("max_") for k, _ in request.filters]
    fields = list(dict.fromkeys([*request.fields, *named]))
    # the first present value is the least (catalog, source, value) among those that are present
    firsts = [F.min(F.when(exprs.present(F.col(f), rows.schema[f].dataType), F.struct("catalog", "source_id", F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    fits = F.lit(True) if request.search is None else request.search.condition(rows.columns)
    objects = rows.groupBy("object_id").agg(F.count("*").alias("members"), F.bool_or(fits).alias("__fits"), *firsts).where("__fits")
    for name, value in request.filters:
        field = name.removeprefix("min_").removeprefix("max_")
        objects = objects.where(F.col(field).isNull() | catalogs.field_filter(name, value, {f: F.col(f) for f in fields}))
    missing = catalogs.missing_fields({f: F.col(f).isNotNull() for f in fields})
    lacking = F.array(*map(F.lit, request.products)).cast("array<string>")
    if request.products and products is not None:
        there = products.where(F.col("product").isin(*request.products) & F.coalesce(F.col("body") != "", F.lit(False))).groupBy("object_id").agg(F.collect_set("product").alias("__there"))
        objects = objects.join(there, "object_id", "left")
        lacking = F.array_except(lacking, F.coalesce("__there", F.array().cast("array<string>")))
    told = objects.select("object_id", "members", missing.alias("missing"), lacking.alias("missing_products"))
    return told.withColumn("usable", (F.size("missing") == 0) & (F.size("missing_products") == 0) & (F.col("members") >= request.members))


def totals(covered: DataFrame, request: Request) -> dict[str, int]:
    """usable, matching and still missing objects."""
    usable, matching = covered.agg(F.count_if("usable"), F.count("*")).first()
    return {"usable": usable, "matching": matching, "missing": max(0, request.count - usable)}


def chosen_objects(covered: DataFrame, reused: DataFrame, count: int) -> DataFrame:
    """Usable objects with whether they were there at the start, those first, then by id, as many as asked for."""
    usable = covered.where("usable").join(reused.select("object_id").withColumn("reused", F.lit(True)), "object_id", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    order = [F.desc("reused"), F.col("object_id")]
    return first_rows(usable, count, order).orderBy(*order)


def origin_counts(chosen: DataFrame, members: DataFrame, began: str) -> DataFrame:
    """How many chosen objects are reused, enriched (a member is older than the build's beginning) or new.

    chosen: object_id, reused; members: object_id, first_fetched_at, which compares as text with began.
    """
    older = members.groupBy("object_id").agg(F.min("first_fetched_at").alias("first"))
    origin = F.when(F.col("reused"), "reused").when(F.col("first") < began, "enriched").otherwise("new")
    return chosen.join(older, "object_id", "left").groupBy(origin.alias("origin")).agg(F.count("*").alias("objects"))


def gap_batches(covered: DataFrame, wanted: DataFrame, done: DataFrame, gaps: int = GAPS, batch: int = BATCH) -> DataFrame:
    """object_id, catalog and batch for the catalogs that incomplete objects still lack: gaps objects, batch units each.

    wanted: catalog, those of the request; done: object_id, catalog, what has been asked for already.
    """
    first = covered.where("not usable").select("object_id").orderBy("object_id").limit(gaps)  # a round's own bound
    names = [r["catalog"] for r in wanted.select("catalog").distinct().orderBy("catalog").collect()]  # the request's own
    units = first.withColumn("catalog", F.explode(F.array(*map(F.lit, names))))
    left = units.join(done, ["object_id", "catalog"], "left_anti")
    number = F.row_number().over(Window.orderBy("object_id", "catalog"))  # gaps times the request's catalogs
    return left.withColumn("batch", F.floor((number - 1) / batch))


Fetch = Callable[[DataFrame, int], DataFrame]


def fulfil(store: DataFrame, request: Request, fetch: Fetch, merge: Callable[[DataFrame, DataFrame], DataFrame], targets: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Fetch and merge until the request is covered, nothing more comes, or rounds run out; then its objects.

    fetch(gaps, round) gives rows for up to GAPS objects that lack something, or new ones; merge(store, rows)
    gives the new store. Objects that were usable at the start come first in the result, then by id.
    """
    store = cut(store, "store")
    before = cut(coverage(store, request, targets).where("usable").select("object_id"), "before")
    stuck, best, turns = 0, -1, 0
    for turns in range(ROUNDS):
        covered = cut(coverage(store, request, targets), "covered")
        state = totals(covered, request)
        stuck = 0 if state["usable"] > best else stuck + 1
        best = max(best, state["usable"])
        if not state["missing"] or stuck >= STUCK:
            break
        rows = fetch(covered.where("not usable").orderBy("object_id").limit(GAPS), turns)
        if rows.isEmpty():
            break
        store = cut(merge(store, rows), "store")
    chosen = chosen_objects(coverage(store, request, targets), before, request.count)
    status = "completed" if not state["missing"] else "partial"
    return chosen, state | {"status": status, "rounds": turns}
