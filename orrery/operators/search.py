"""The search request: validated in plain Python, evaluated as one lazy plan over targets and sources."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import spatial
from orrery.operators.store import cut
from orrery.sources import catalogs


def _year(x: object) -> float | None:
    if x is None:
        return None
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        try:
            return float(date.fromisoformat(str(x)[:10]).year)
        except ValueError:
            return None


@dataclass(frozen=True)
class Search:
    """What to look for around each target (Q1)."""

    radius_arcsec: float = 3.0
    min_radius_arcsec: float = 0.0
    mode: str = "cone"
    catalogs: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    object_types: tuple[str, ...] = ()
    spectral_types: tuple[str, ...] = ()
    morphology: tuple[str, ...] = ()
    min_confidence: float = 0.5
    count_threshold: int = 5
    max_results: int | None = None
    min_distance_pc: float | None = None
    max_distance_pc: float | None = None
    start: object = None
    end: object = None
    zones: tuple[tuple[float, float], ...] = ()
    exclude_polygons: tuple[tuple[tuple[float, float], ...], ...] = ()
    adaptive: bool = False
    filters: dict[str, object] = field(default_factory=dict)

    def problems(self, known_catalogs: set[str] | None = None) -> list[str]:
        """What makes the request invalid."""
        bad = lambda x: not math.isfinite(x)
        checks = [
            (bad(self.radius_arcsec) or self.radius_arcsec <= 0, "the radius must be positive"),
            (self.count_threshold <= 0, "the count threshold must be positive"),
            (bad(self.min_confidence) or not 0 <= self.min_confidence <= 1, "the confidence must be between 0 and 1"),
            (self.max_results is not None and self.max_results <= 0, "the number of results must be positive"),
            (self.mode not in ("cone", "shell", "cylinder"), "the mode must be cone, shell or cylinder"),
            (self.mode == "cylinder" and self.min_distance_pc is None and self.max_distance_pc is None, "a cylinder needs a distance bound"),
            (any(d is not None and (bad(d) or d <= 0) for d in (self.min_distance_pc, self.max_distance_pc)), "distances must be positive"),
            (None not in (self.min_distance_pc, self.max_distance_pc) and self.min_distance_pc > self.max_distance_pc, "the least distance is beyond the largest"),
            (bad(self.min_radius_arcsec) or not 0 <= self.min_radius_arcsec < self.radius_arcsec, "the inner radius must be within the outer"),
            (any(x is not None and _year(x) is None for x in (self.start, self.end)), "the period's years can't be read"),
            (None not in (_year(self.start), _year(self.end)) and _year(self.start) > _year(self.end), "the period ends before it begins"),
            (any(len(p) < 3 for p in self.exclude_polygons), "a polygon needs three corners"),
            (any(bad(r) or bad(d) or abs(d) > 90 for p in self.exclude_polygons for r, d in p), "a polygon's corner isn't on the sky"),
            (any(bad(a) or bad(b) or a < 0 or b <= a or b > self.radius_arcsec for a, b in self.zones), "zones must lie within the radius"),
            (known_catalogs is not None and not set(self.catalogs) <= known_catalogs, "a catalog isn't known"),
        ]
        return [told for wrong, told in checks if wrong]

    def plan(self, registry: DataFrame, strict: bool = True) -> DataFrame:
        """The enabled catalogs that the request reads (Q3; Q4 with strict off, which takes those without profiles too)."""
        rows = registry.where("enabled")
        if self.catalogs:
            rows = rows.where(F.col("catalog").isin(*self.catalogs))
        if self.profiles:
            overlap = F.arrays_overlap("profiles", F.array(*map(F.lit, self.profiles)))
            rows = rows.where(overlap if strict else overlap | (F.size("profiles") == 0))
        return rows

    def condition(self, columns: list[str]) -> Column:
        """All filters on matches as one condition (Q2, F2-F9); a filter on a column that isn't there is false."""
        c = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
        low = lambda xs: [x.strip().lower() for x in xs]
        parts = [F.lit(True)]
        if self.object_types:
            wanted = {n for x in low(self.object_types) for n in [next((k for k, v in exprs.OBJECT_TYPES.items() if x in v), x)]}
            parts.append(exprs.canonical_type(c("object_type")).isin(*sorted(wanted)))
        for name, wanted in (("spectral_type", self.spectral_types), ("morphology", self.morphology)):
            if wanted:
                parts.append(F.lower(F.trim(c(name))).isin(*low(wanted)))
        if self.mode == "shell":
            parts.append(F.col("separation") >= self.min_radius_arcsec)
        if self.min_distance_pc is not None or self.max_distance_pc is not None or self.mode == "cylinder":
            d = exprs.distance_pc(c("parallax").cast("double"), c("distance_pc").cast("double"))
            parts.append(d.between(self.min_distance_pc or 0.0, self.max_distance_pc or float("inf")))
        if self.zones:
            parts.append(reduce(or_, (F.col("separation").between(a, b) for a, b in self.zones)))
        if self.start is not None or self.end is not None:
            y = F.coalesce(exprs.year_of(c("observation_date").cast("string")), c("epoch").cast("double"))
            parts.append(y.between(_year(self.start) if self.start is not None else -math.inf, _year(self.end) if self.end is not None else math.inf))
        parts += [~exprs.inside_polygon(F.col("ra"), F.col("dec"), list(p)) for p in self.exclude_polygons]
        return reduce(and_, (F.coalesce(p, F.lit(False)) for p in parts))


def crossmatch(targets: DataFrame, sources: DataFrame, search: Search, objects: bool = True) -> DataFrame:
    """Matches of all targets at once: separation, confidence and object of each.

    targets: target_id, t_ra, t_dec and, as far as known, t_epoch and t_uncertainty_arcsec; sources: catalog,
    source_id, ra, dec, error_arcsec, epoch, pmra and pmdec as far as known, and what filters name. Sources
    stand where they are at their target's epoch.
    Cone, adaptive radius, confidence and filters, then each catalog's first max_results, then objects: the
    components of what is left, numbered by their nearest detection. Without objects no match is written.
    """
    if told := search.problems():
        raise ValueError("; ".join(told))
    if search.catalogs:
        sources = sources.where(F.col("catalog").isin(*search.catalogs))
    order = [F.col("separation"), F.col("catalog"), F.col("source_id")]
    m = spatial.moving_cone_join(targets, sources, search.radius_arcsec)
    if search.adaptive:
        m = spatial.adaptive(m, "target_id", order, search.radius_arcsec)
    m = m.withColumn("confidence", exprs.match_score(F.col("separation"), F.col("error_arcsec"), F.col("t_uncertainty_arcsec") if "t_uncertainty_arcsec" in m.columns else None)).where(F.col("confidence") >= search.min_confidence)
    m = m.where(search.condition(m.columns))
    if search.max_results is not None:
        m = spatial.top_matches(m, search.max_results, ["target_id", "catalog"], order).drop("rank")
    if not objects:
        return m
    m = cut(m.withColumn("key", F.concat_ws("\x1f", "catalog", F.col("source_id").cast("string"))), "matches")
    roots = spatial.close_groups(m, "target_id", "key", search.radius_arcsec)
    near = F.min(F.struct("separation", "key")).over(Window.partitionBy("target_id", "root"))
    numbered = m.join(roots, ["target_id", "key"]).withColumn("__near", near)
    return numbered.withColumn("object", F.dense_rank().over(Window.partitionBy("target_id").orderBy("__near"))).drop("__near", "root", "key")


def read_isolated(spark: SparkSession, reads: dict[str, Callable[[], DataFrame]], timeout: float = 30.0, at_once: int = 8) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all catalogs that can be read, with their catalog, and catalog, error and message of those that can't or are too late (Q5).

    reads: for each catalog what gives its rows. Each is read by jobs of its own and written to the shared
    folder; a failure stops that catalog alone. What has not been read timeout seconds after the call is too late,
    and its jobs are cancelled.
    Columns that a catalog lacks are null.
    """

    def read(name: str) -> DataFrame:
        spark.addTag(tags[name])
        try:
            return cut(reads[name]().withColumn("catalog", F.lit(name)), "catalog")
        finally:
            spark.removeTag(tags[name])

    tags = {name: f"catalog-{uuid.uuid4().hex}" for name in reads}
    found, failures = None, []
    pool, began = ThreadPoolExecutor(at_once), time.monotonic()
    try:
        running = {name: pool.submit(read, name) for name in reads}
        for name, future in running.items():
            try:
                rows = future.result(max(0.0, began + timeout - time.monotonic()))
                found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
            except TimeoutError:
                future.cancel()
                spark.interruptTag(tags[name])
                failures.append((name, "timeout", f"not read within {timeout:g} s"))
            except Exception as e:  # any reader's error is that catalog's failure
                failures.append((name, type(e).__name__, str(e)[:500]))
    finally:
        pool.shutdown(wait=False)
    return found, spark.createDataFrame(failures, "catalog string, error string, message string")


#: What a counterpart tells of a match, as far as the matches have it.
COUNTERPART = ("catalog", "source_id", "ra", "dec", "separation", "confidence", "metadata", "data", "provenance", "error_arcsec", "epoch", "pmra", "pmdec", "physical", "links", "object_type", "spectral_type", "object")


def records(matches: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One evidence record for each target: catalogs, detections, objects, and counterparts by wavelength.

    matches: target_id, catalog, source_id, separation, object, wavelength and what else a counterpart tells;
    failures: target_id, catalog, error, the catalogs that could not be read. catalogs_queried counts both.
    Counterparts are in the order of their separation; a target that has failures only has a record too.
    A target's counterparts are one row of the result.
    """
    told = [c for c in COUNTERPART if c in matches.columns]
    ranked = F.struct(F.struct("separation", "catalog", F.col("source_id").cast("string").alias("key")).alias("rank"), F.struct(*told).alias("row"))
    by = matches.groupBy("target_id", "wavelength").agg(F.count("*").alias("n"), exprs.by_rank(F.collect_list(ranked)).alias("rows"))
    entries = exprs.by_rank(F.collect_list(F.struct(F.struct("wavelength").alias("rank"), F.struct("wavelength", "n", "rows").alias("row"))))
    waves = by.groupBy("target_id").agg(entries.alias("e")).select("target_id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["wavelength"], x["n"]))).alias("by_wavelength"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["wavelength"], x["rows"]))).alias("counterparts"))
    whole = matches.groupBy("target_id").agg(F.sort_array(F.collect_set("catalog")).alias("catalogs"), F.sort_array(F.collect_set("wavelength")).alias("wavelengths"), F.count("*").alias("detections"), F.count_distinct("object").alias("objects"))
    found = whole.join(waves, "target_id")
    if failures is None:
        none = F.array().cast("array<struct<catalog:string,error:string>>")
        return found.withColumns({"failures": none, "catalogs_queried": F.size("catalogs").cast("long")})
    failed = failures.groupBy("target_id").agg(F.array_sort(F.collect_set(F.struct("catalog", "error"))).alias("failures"))
    both = found.join(failed, "target_id", "full_outer")
    none = F.array().cast(failed.schema["failures"].dataType)
    both = both.withColumns({"failures": F.coalesce("failures", none), **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("catalogs", "wavelengths")}, **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("detections", "objects")}})
    asked = F.array_union("catalogs", F.transform("failures", lambda x: x["catalog"]))
    return both.withColumn("catalogs_queried", F.size(asked).cast("long"))


def summaries(evidence: DataFrame, name: Column, ra: Column, dec: Column, most: int = 5) -> DataFrame:
    """target_id, status and text of each evidence record, with its first candidates."""
    candidates = F.slice(F.flatten(F.map_values(F.coalesce("counterparts", F.create_map().cast(evidence.schema["counterparts"].dataType)))), 1, most)
    one = lambda c: F.concat(F.lit(" Candidate "), c["source_id"].cast("string"), F.lit(" in "), c["catalog"], F.lit(" lies "), exprs.significant(c["separation"]), F.lit(" arcsec from the query position."))
    told = F.concat(
        name, F.lit(": RA "), ra.cast("string"), F.lit(" deg, Dec "), dec.cast("string"), F.lit(" deg. Queried "), F.col("catalogs_queried").cast("string"), F.lit(" catalogs; returned "),
        F.col("detections").cast("string"), F.lit(" candidate counterparts. "), F.size("failures").cast("string"), F.lit(" catalog queries failed."), F.array_join(F.transform(candidates, one), ""),
    )
    return evidence.select("target_id", F.when(F.size("failures") > 0, "partial").otherwise("complete").alias("status"), told.alias("text"))


def search_names(names: DataFrame, dimension: DataFrame, sources: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """Matches around the objects that names(target_id, name) mean, and the names that nothing or several things bear (Q8)."""
    found = catalogs.resolved(names, dimension)
    targets = found.where("resolution = 'resolved'").select("target_id", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"))
    return crossmatch(targets, sources, search), found.where("resolution <> 'resolved'").select("target_id", "name", "resolution")
