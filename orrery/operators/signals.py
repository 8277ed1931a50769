"""One-dimensional signals (light curves, spectra) in long form: signal_id, pos, axis, value, error, quality.

Every statistic is an aggregate or a window by signal_id. Signals that can't be represented come with the reason.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orrery.functions import exprs
from orrery.operators import spatial, store
from orrery.sources import tables

SHAPE_BINS = 32
LAGS = (1, 2, 4, 8)
LEAST_SAMPLES = 8


def long_form(observations: DataFrame) -> DataFrame:
    """Observations with parallel arrays axis, values, uncertainties and quality to a row for each sample."""
    zipped = F.arrays_zip("axis", "values", "uncertainties", "quality")
    return observations.select(F.col("observation_id").alias("signal_id"), F.posexplode(zipped).alias("pos", "s")).select(
        "signal_id", "pos", F.col("s.axis").alias("axis"), F.col("s.values").alias("value"), F.col("s.uncertainties").alias("error"), F.col("s.quality").alias("quality")
    )


def usable_samples(samples: DataFrame) -> DataFrame:
    """Samples with a finite axis and value, quality 0 and an error that is null or finite and positive."""
    quality = F.coalesce(F.col("quality") == 0, F.lit(True))
    error = F.col("error").isNull() | (exprs.finite(F.col("error")) & (F.col("error") > 0))
    return samples.where(exprs.finite(F.col("axis")) & exprs.finite(F.col("value")) & quality & error)


def prepared(samples: DataFrame) -> DataFrame:
    """Usable samples of signals that keep LEAST_SAMPLES and span an axis, with their good fraction."""
    good = usable_samples(samples).groupBy("signal_id").agg(F.count("*").alias("n"), F.min("axis").alias("axis_min"), F.max("axis").alias("axis_max"))
    every = samples.groupBy("signal_id").agg(F.count("*").alias("total"))
    fit = good.join(every, "signal_id").where((F.col("n") >= LEAST_SAMPLES) & (F.col("axis_max") > F.col("axis_min"))).withColumn("good_fraction", F.col("n") / F.col("total"))
    return usable_samples(samples).join(fit, "signal_id")


def rejected(samples: DataFrame) -> DataFrame:
    """signal_id and reason for signals that prepared() leaves out: too few usable samples, no span, or constant values (N1, ST7)."""
    ok = usable_samples(samples).groupBy("signal_id").agg(F.count("*").alias("n"), (F.max("axis") - F.min("axis")).alias("span"), (F.max("value") > F.min("value")).alias("varies"))
    every = samples.select("signal_id").distinct().join(ok, "signal_id", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < LEAST_SAMPLES, "too_few_samples").when(~(F.col("span") > 0), "no_span").when(~F.col("varies"), "constant_values")
    return every.select("signal_id", reason.alias("reason")).where("reason is not null")


def in_order() -> Window:
    return Window.partitionBy("signal_id").orderBy("axis", "pos")


def robust_stats(samples: DataFrame) -> DataFrame:
    """Median, scaled MAD (population deviation where that is 0) by signal."""
    whole = Window.partitionBy("signal_id")
    with_median = samples.withColumn("median", F.median("value").over(whole))
    stats = with_median.groupBy("signal_id").agg(F.count("*").alias("n"), F.first("median").alias("median"), (1.4826 * F.median(F.abs(F.col("value") - F.col("median")))).alias("mad"), F.stddev_pop("value").alias("sd"))
    return stats.withColumn("scale", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")))


def moments(samples: DataFrame) -> DataFrame:
    """Population skewness and excess kurtosis by signal."""
    return samples.groupBy("signal_id").agg(F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))


def quantiles(samples: DataFrame, at=(0.05, 0.25, 0.75, 0.95)) -> DataFrame:
    """Linear quantiles by signal."""
    return samples.groupBy("signal_id").agg(*(F.percentile("value", q).alias(f"q{round(q * 100):02d}") for q in at))


def weighted_slope(samples: DataFrame, weight: Column | None = None) -> DataFrame:
    """Least-squares slope of value on the centred and scaled axis by signal."""
    w = F.lit(1.0) if weight is None else weight
    x = F.col("axis")
    sums = samples.groupBy("signal_id").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * F.col("value")).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * F.col("value")).alias("wxy"), (F.max(x) - F.min(x)).alias("span"))
    slope = F.try_divide(F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w"), F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"))
    return sums.select("signal_id", (slope * F.col("span")).alias("slope"))


def shape_bins(samples: DataFrame, bins: int = SHAPE_BINS) -> DataFrame:
    """Median by equal-width axis bin; bins without samples are interpolated, those at the ends take the nearest."""
    whole = Window.partitionBy("signal_id")
    scaled = F.try_divide(F.col("axis") - F.min("axis").over(whole), F.max("axis").over(whole) - F.min("axis").over(whole))
    own = samples.withColumn("bin", F.least(F.floor(scaled * bins), F.lit(bins - 1))).groupBy("signal_id", "bin").agg(F.median("value").alias("m"))
    every = own.select("signal_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = every.join(own, ["signal_id", "bin"], "left")
    back = Window.partitionBy("signal_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("signal_id").orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("m").isNotNull(), F.col("bin"))
    full = full.withColumns({"lb": F.last(at, True).over(back), "lm": F.last("m", True).over(back), "rb": F.first(at, True).over(ahead), "rm": F.first("m", True).over(ahead)})
    between = F.col("lm") + (F.col("rm") - F.col("lm")) * (F.col("bin") - F.col("lb")) / (F.col("rb") - F.col("lb"))
    value = F.when(F.col("lb").isNull(), F.col("rm")).when(F.col("rb").isNull() | (F.col("lb") == F.col("bin")), F.col("lm")).otherwise(between)
    return full.select("signal_id", "bin", value.alias("value"))


def autocorrelation(samples: DataFrame, lags=LAGS) -> DataFrame:
    """Correlation of a signal with itself at each lag; 0 where it is too short or constant."""
    later = samples.withColumns({f"l{k}": F.lead("value", k).over(in_order()) for k in lags})
    corr = lambda k: F.coalesce(F.nanvl(F.corr(F.when(F.col(f"l{k}").isNotNull(), F.col("value")), f"l{k}"), F.lit(0.0)), F.lit(0.0))
    return later.groupBy("signal_id").agg(*(corr(k).alias(f"lag{k}") for k in lags))


def median_derivative(samples: DataFrame) -> DataFrame:
    """Median absolute change of value by change of axis."""
    dv, dt = F.col("value") - F.lag("value").over(in_order()), F.col("axis") - F.lag("axis").over(in_order())
    steps = samples.select("signal_id", F.abs(dv / F.greatest(dt, F.lit(2.220446049250313e-16))).alias("d")).where("d is not null")
    return steps.groupBy("signal_id").agg(F.median("d").alias("derivative"))


def logarithmic_axis(samples: DataFrame) -> DataFrame:
    """Spectra with the logarithm of their axis, where it is positive throughout (C21); with a column modality only those rows."""
    positive = F.min("axis").over(Window.partitionBy("signal_id")) > 0
    if "modality" in samples.columns:
        positive = positive & (F.col("modality") == "spectrum")
    return samples.withColumn("axis", F.when(positive, F.log("axis")).otherwise(F.col("axis")))


def normalized(samples: DataFrame) -> DataFrame:
    """Usable samples with values by the signal's median and errors by its size; none of signals with a median of 0."""
    good = usable_samples(samples)
    median = good.groupBy("signal_id").agg(F.median("value").alias("__m")).where("__m <> 0")
    return good.join(median, "signal_id").withColumns({"value": F.col("value") / F.col("__m"), "error": F.col("error") / F.abs("__m")}).drop("__m")


def folded(samples: DataFrame, period: float) -> DataFrame:
    """Samples with their phase about the signal's first time, in the order of phases."""
    start = samples.groupBy("signal_id").agg(F.min("axis").alias("__t"))
    return samples.join(start, "signal_id").withColumn("phase", exprs.phase(F.col("axis"), F.col("__t"), period)).drop("__t").withColumn("rank", F.row_number().over(Window.partitionBy("signal_id").orderBy("phase", "axis", "pos")))


def read_observations(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Observations out of lines(line, value) of JSON, and the lines that aren't objects with their numbers.

    Blank lines are passed over. An observation needs an observation_id.
    """
    rows = lines.where(F.trim("value") != "").withColumn("o", F.from_json(F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.col("value")), schema))
    named = F.coalesce(F.trim(F.col("o.observation_id")) != "", F.lit(False))
    reason = F.when(F.try_parse_json("value").isNull(), "not_json").when(~F.ltrim("value").startswith("{"), "not_an_object").otherwise("no_observation_id")
    return rows.where(named).select("o.*"), rows.where(~named).select("line", reason.alias("reason"))


def delivered(observations: DataFrame) -> DataFrame:
    """Observations of a delivery, each id once; raises ValueError if an id comes with different contents (U7, ST10, N4)."""
    told = observations.withColumn("__d", F.sha2(F.to_json(F.struct(*observations.columns)), 256))
    conflicts = told.groupBy("observation_id").agg(F.count_distinct("__d").alias("n")).where("n > 1").limit(5).collect()  # a few names for the message
    if conflicts:
        raise ValueError(f"observations with different contents: {[r['observation_id'] for r in conflicts]}")
    return told.dropDuplicates(["observation_id"]).drop("__d")


def map_rows(observations: DataFrame, vectors: DataFrame, status: DataFrame) -> DataFrame:
    """Rows for a map of signals (P13): what an observation is, how it was triaged, its vector as JSON.

    observations: observation_id, object_id, title, modality, ra, dec, instrument, band, observed_at, source_url;
    vectors: signal_id, n, good_fraction, vector; status: signal_id, status, nearest.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = observations.join(vectors, observations["observation_id"] == vectors["signal_id"]).drop("signal_id")
    rows = rows.join(status.select("signal_id", "status", "nearest"), rows["observation_id"] == status["signal_id"])
    summary = F.format_string("%s observation with %d usable samples; triage status %s.", "modality", "n", "status")
    return rows.select(
        F.concat(F.lit("observation:"), F.col("observation_id").cast("string")).alias("catalog_id"), F.coalesce(F.nullif("title", F.lit("")), F.col("observation_id").cast("string")).alias("title"),
        F.lit("astronomical_signal").alias("kind"), text("object_id"), "modality", text("instrument"), text("band"), F.col("status").alias("triage_status"), summary.alias("summary"),
        F.col("ra").alias("ra_deg"), F.col("dec").alias("dec_deg"), F.col("n").alias("sample_count"), "good_fraction", F.col("nearest").alias("nearest_representation_distance"),
        F.to_json("vector").alias("representation"), text("observed_at"), text("source_url"),
    )


def commit(root: str, observations: DataFrame, references: DataFrame, radius_arcsec: float = 2.0, support: float = 0.25) -> dict:
    """A delivery's map rows and status counts under root/fingerprint, and root/latest.json that names it.

    observations: those of map_rows, with parallel arrays axis, values, uncertainties and quality. The
    fingerprint depends on the observations, references and thresholds alone; a delivery that equals the latest
    one writes nothing and comes back with changed false. Signals that can't be represented are counted by reason.
    """
    ready = store.cut(delivered(observations), "delivery")
    digest = lambda df: str(df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0)).alias("s")).first())
    total = ready.count()
    if not total:
        raise ValueError("a delivery without observations")
    fingerprint = hashlib.sha256(json.dumps([digest(ready), digest(references), radius_arcsec, support]).encode()).hexdigest()
    fs, path = tables.filesystem(root)
    latest = f"{path}/latest.json"
    if fs.get_file_info(latest).is_file:
        with fs.open_input_stream(latest) as f:
            before = json.loads(f.read())
        if before["fingerprint"] == fingerprint:
            return before | {"changed": False}
    samples = store.cut(logarithmic_axis(long_form(ready).join(ready.select(F.col("observation_id").alias("signal_id"), "modality"), "signal_id")), "samples")
    counted = prepared(samples).groupBy("signal_id").agg(F.first("n").alias("n"))
    vectors = store.cut(represent(samples).join(counted, "signal_id"), "vectors")
    placed = vectors.join(ready.select(F.col("observation_id").alias("signal_id"), "ra", "dec", "modality"), "signal_id")
    status = store.cut(cross_reference(placed, references, radius_arcsec, support), "status")
    map_rows(ready, vectors, status).write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{fingerprint}")
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # six statuses
    told = {"fingerprint": fingerprint, "observations": total, "statuses": counts, "rejected": {r["reason"]: r["count"] for r in rejected(samples).groupBy("reason").count().collect()}}
    with fs.open_output_stream(f"{path}/.latest.json") as f:
        f.write(json.dumps(told, sort_keys=True).encode())
    fs.move(f"{path}/.latest.json", latest)
    return told | {"changed": True}


#: Bytes of the references around a cube up to which one task ranks them for the signals in it; pairs that it looks at together, about.
NEAR_BYTES, PAIRS = 64 << 20, 1 << 18
CANDIDATE = ("signal_id", "catalog_id", "separation", "distance", "supported", "rank")


def candidates(vectors: DataFrame, references: DataFrame, radius_arcsec: float = 2.0, support: float = 0.25, columns: tuple[str, ...] = CANDIDATE, near_bytes: int = NEAR_BYTES) -> DataFrame:
    """signal_id, catalog_id, separation, distance, supported and rank, or those of columns, for references near each signal.

    Nearer ones come first, of equally near ones those whose vectors are nearer; a distance that is unknown or 0
    ranks as 3. Vectors are compared only within the radius and a modality. References go to the cubes of the sky
    that have signals in reach, where a task ranks them for a few signals at a time: no pair is shuffled. Signals
    with references beyond near_bytes around them, or with an id that repeats, are ranked by a window over pairs.
    """
    edge = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) * 1.000001 + 1e-12
    at, told = ["cx", "cy", "cz"], [F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), "modality", F.col("vector").cast("array<double>").alias("vector")]
    placed = lambda df: spatial.with_cells(df.where(exprs.valid_position(F.col("ra"), F.col("dec"))), "ra", "dec", edge, False)
    v = store.cut(placed(vectors.select("signal_id", *told)).withColumn("repeated", F.count("*").over(Window.partitionBy("signal_id")) > 1), "signals")
    r = store.cut(placed(references.select("catalog_id", *told)), "references")
    size = 64 + 8 * F.coalesce(F.greatest(F.size("vector"), F.lit(0)), F.lit(0)) + F.coalesce(F.octet_length(F.col("catalog_id").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("modality").cast("string")), F.lit(0))
    own = v.where("not repeated").groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumns({"spot": F.monotonically_increasing_id(), **{f"own_{c}": F.col(c) for c in at}})
    for c in at:
        own = own.withColumn("__o", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(c, F.col(c) + F.col("__o")).drop("__o")
    reach = own.join(r.groupBy(*at).agg(F.sum(size).alias("bytes")), at)
    reach = store.cut(reach.withColumn("crowded", F.sum("bytes").over(Window.partitionBy("spot")) > near_bytes).drop("bytes"), "reach")
    spots = reach.select(*(F.col(f"own_{c}").alias(c) for c in at), "spot", "blocks", "crowded").distinct()
    every = [F.col("ra"), F.col("dec"), F.col("modality"), F.when(F.forall("vector", lambda x: x.isNotNull()), F.col("vector")).alias("vector")]
    near = r.join(reach.where("not crowded"), at).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("spot", "block", F.lit(0).alias("side"), "catalog_id", *every)
    asked = v.where("not repeated").join(spots.where("not crowded"), at).select("spot", F.pmod(F.xxhash64("signal_id"), F.col("blocks")).alias("block"), F.lit(1).alias("side"), "signal_id", *every)
    rows = spatial.spread(near.unionByName(asked, allowMissingColumns=True), "spot", "block").sortWithinPartitions("spot", "block", "side", "catalog_id")
    kinds = {"signal_id": v.schema["signal_id"].dataType.simpleString(), "catalog_id": r.schema["catalog_id"].dataType.simpleString(), "separation": "double", "distance": "double", "supported": "boolean", "rank": "int"}
    found = rows.mapInArrow(lambda b: _ranked(b, radius_arcsec, support, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))
    rest = v.where("repeated").drop(*at).unionByName(v.where("not repeated").join(spots.where("crowded"), at, "left_semi").drop(*at)).drop("repeated")
    return found if rest.isEmpty() else found.unionByName(_by_pairs(rest, r.drop(*at), radius_arcsec, support).select(*columns))


def _by_pairs(v: DataFrame, r: DataFrame, radius_arcsec: float, support: float) -> DataFrame:
    """candidates by a join and a window, which holds any number of references a signal."""
    v, r = v.withColumnsRenamed({"ra": "t_ra", "dec": "t_dec"}), r.withColumnsRenamed({"modality": "r_modality", "vector": "r_vector"})
    same = F.coalesce((F.col("modality") == F.col("r_modality")) & (F.size("vector") == F.size("r_vector")), F.lit(False))
    near = spatial.cone_join(v, r, radius_arcsec).withColumn("distance", F.when(same, exprs.cosine_distance(F.col("vector"), F.col("r_vector"))))
    order = Window.partitionBy("signal_id").orderBy("separation", F.coalesce(F.nullif("distance", F.lit(0.0)), F.lit(3.0)), "catalog_id")
    return near.select("signal_id", "catalog_id", "separation", "distance", F.coalesce(F.col("distance") <= support, F.lit(False)).alias("supported"), F.row_number().over(order).alias("rank"))


class _Rows:
    """Positions, modalities and vectors of signals or references; vectors of a length are columns, so that sums are made in the order of exprs.cosine_distance."""

    def __init__(self, t: pa.Table, modalities: pa.Array | None = None):
        self.ra, self.dec = (t.column(c).to_numpy() for c in ("ra", "dec"))
        ra, dec = np.radians(self.ra), np.radians(self.dec)
        self.cos = np.cos(dec)
        self.toward = self.cos * np.cos(ra), self.cos * np.sin(ra), np.sin(dec)
        own = t.column("modality").combine_chunks()
        self.modalities = own.drop_null().unique() if modalities is None else modalities
        self.modality = pc.fill_null(pc.index_in(own, value_set=self.modalities), -1).to_numpy(zero_copy_only=False)
        vectors = t.column("vector").combine_chunks()
        self.length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        self.place, self.columns, self.norm = np.zeros(t.num_rows, np.int64), {}, np.zeros(t.num_rows)
        for n in np.unique(self.length[self.length > 0]).tolist():
            rows = np.flatnonzero(self.length == n)
            self.place[rows] = np.arange(len(rows))
            self.columns[n] = x = np.ascontiguousarray(_matrix(vectors.take(pa.array(rows))).T)
            self.norm[rows] = np.sqrt(_summed(x, x))


def _summed(x: Iterable[np.ndarray], y: Iterable[np.ndarray]) -> np.ndarray:
    total = 0.0
    with np.errstate(all="ignore"):
        for a, b in zip(x, y, strict=True):
            total = total + a * b
    return total


def _ranked(batches: Iterator[pa.RecordBatch], radius_arcsec: float, support: float, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """candidates out of rows sorted by spot, block and side, references by their ids before signals; those around one spot are held at a time."""
    least = math.cos(math.radians(min(radius_arcsec / 3600, 180.0))) - 1e-13

    def solved(ids: pa.Array, r: _Rows, signals: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = _Rows(pa.Table.from_batches([signals]), r.modalities)
        step = max(1, PAIRS // len(r.ra))
        for at in range(0, len(v.ra), step):
            x, y, z = (c[at : at + step, None] for c in v.toward)
            near = np.flatnonzero(x * r.toward[0] + y * r.toward[1] + z * r.toward[2] >= least)
            i, j = np.divmod(near, len(r.ra))
            i += at
            a = np.sin(np.radians(r.dec[j] - v.dec[i]) / 2) ** 2 + v.cos[i] * r.cos[j] * np.sin(np.radians(r.ra[j] - v.ra[i]) / 2) ** 2
            separation = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, a)))) * 3600
            within = separation <= radius_arcsec
            i, j, separation = i[within], j[within], separation[within]
            distance = np.full(len(i), np.nan)
            same = (v.modality[i] == r.modality[j]) & (v.modality[i] >= 0) & (v.length[i] == r.length[j])
            for n in v.columns.keys() & r.columns.keys():
                own = np.flatnonzero(same & (v.length[i] == n))
                p, q = i[own], j[own]
                with np.errstate(all="ignore"):
                    norms = v.norm[p] * r.norm[q]
                distance[own] = _distances(_summed((c[v.place[p]] for c in v.columns[n]), (c[r.place[q]] for c in r.columns[n])), norms)
            far = np.where(np.isnan(distance) | (distance == 0), 3.0, distance)
            order = np.lexsort((far, separation, i))  # stable: by the references' ids in the end
            i, j, separation, distance = i[order], j[order], separation[order], distance[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1])
            rank = np.arange(1, len(i) + 1) - np.repeat(first, np.diff(np.append(first, len(i))))
            told = {"signal_id": lambda: signals.column("signal_id").take(pa.array(i)), "catalog_id": lambda: ids.take(pa.array(j)), "separation": lambda: pa.array(separation)}
            told |= {"distance": lambda: pa.array(distance, from_pandas=True), "supported": lambda: pa.array(distance <= support), "rank": lambda: pa.array(rank.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([told[c]() for c in columns], list(columns))

    spot, held, near = None, [], None
    for batch in batches:
        where = np.stack([batch.column(c).to_numpy() for c in ("spot", "block", "side")])
        ends = np.append(np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1, batch.num_rows).tolist()
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            *own, side = where[:, begin].tolist()
            if own != spot:
                spot, held, near = own, [], None
            if side == 0:
                held.append(batch.slice(begin, end - begin))
                continue
            if near is None:
                t = pa.Table.from_batches(held)
                near, held = (t.column("catalog_id").combine_chunks(), _Rows(t)), []
            yield from solved(*near, batch.slice(begin, end - begin))


def represent(samples: DataFrame) -> DataFrame:
    """The unit vector of each prepared signal: 12 statistics, shape bins, lag correlations.

    All statistics come from one aggregate over samples that hold their neighbours, the bins from another.
    """
    good = prepared(samples)
    scale = robust_stats(good).select("signal_id", "median", "scale").where("scale > 0")
    z = good.join(scale, "signal_id").withColumn("value", (F.col("value") - F.col("median")) / F.col("scale"))
    w = F.when(F.col("error").isNotNull(), 1 / (F.col("error") * F.col("error"))).otherwise(1.0)
    x, v = F.col("axis"), F.col("value")
    near = z.withColumns({f"l{k}": F.lead("value", k).over(in_order()) for k in LAGS} | {"d": F.abs((v - F.lag("value").over(in_order())) / F.greatest(x - F.lag("axis").over(in_order()), F.lit(2.220446049250313e-16)))})
    corr = lambda k: F.coalesce(F.nanvl(F.corr(F.when(F.col(f"l{k}").isNotNull(), v), f"l{k}"), F.lit(0.0)), F.lit(0.0)).alias(f"lag{k}")
    stats = near.groupBy("signal_id").agg(
        F.first("good_fraction").alias("good_fraction"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile(v, [0.05, 0.25, 0.75, 0.95]).alias("q"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.median("d").alias("derivative"), (F.max(x) - F.min(x)).alias("span"),
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * v).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * v).alias("wxy"), *(corr(k) for k in LAGS),
    )
    slope = F.try_divide(F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w"), F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")) * F.col("span")
    bins = shape_bins(z).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda b: b["value"]).alias("bins"))
    told = F.concat(F.array("mean", "sd", "lo", "hi"), F.col("q"), F.array(F.col("skew"), F.col("kurtosis"), F.col("derivative"), slope), "bins", F.array(*(f"lag{k}" for k in LAGS)))
    raw = F.transform(told, lambda y: F.when(exprs.finite(y), y).otherwise(0.0))
    with_raw = stats.join(bins, "signal_id").select("signal_id", "good_fraction", raw.alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, y: acc + y * y))
    return with_raw.select("signal_id", "good_fraction", F.transform("raw", lambda y: F.when(norm > 0, y / norm).otherwise(0.0)).alias("vector"))


#: Rows of either side that a task compares at a time; reference vectors of a modality and length that others are placed by, and bytes of all of them at most.
BLOCK, PIVOTS, PIVOT_BYTES = 1024, 64, 32 << 20
#: What a bound on an angle may be off by.
SLACK = 1e-6


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _distances(dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """exprs.cosine_distance from products and products of lengths; NaN stands for its null."""
    with np.errstate(all="ignore"):
        d = 1 - dot / norms
    return np.where(norms == 0, np.nan, np.where(np.isnan(d), 2.0, np.clip(d, 0, 2)))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduce(x * x, axis=-1))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row, which don't depend on a row's place."""
    return _distances(np.add.reduce(x * y, axis=-1), _lengths(x) * _lengths(y))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _lengths(x)[:, None] if len(x) else x


def met(left: DataFrame, right: DataFrame, keys: list[str], f: Callable[[pa.Table, pa.Table], pa.RecordBatch], schema: str, block: int = BLOCK) -> DataFrame:
    """f of every block of left rows and block of right rows that have a key in common.

    left and right have a unique row; a key's rows are split into blocks by it, so that of a key with any number
    of rows on either side a task holds two blocks, and no pair of rows is a row.
    """
    sizes = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias(n))
    blocks = store.cut(sizes(left, "lefts").join(sizes(right, "rights"), keys), "blocks")

    def side(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        told = df.join(blocks, keys).withColumn(f"__{own}", F.pmod(F.xxhash64("row"), F.col(own)))
        told = told.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return told.select(*keys, "__lefts", "__rights", F.struct(*(c for c in df.columns if c not in keys)).alias(name))

    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    pairs = side(left, "lefts", "rights", "l").unionByName(side(right, "rights", "lefts", "r"), allowMissingColumns=True)

    def both(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sides = [pa.Table.from_struct_array(t.column(c).combine_chunks().filter(t.column(c).combine_chunks().is_valid())) for c in "lr"]
        return pa.Table.from_batches([f(*sides)]) if all(x.num_rows for x in sides) else none

    return pairs.groupBy(*keys, "__lefts", "__rights").applyInArrow(both, schema)


def _usable(c: str) -> Column:
    """Whether a vector can be compared: no null in it, and not of length 0; NaN and infinities can."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull()) & F.exists(c, lambda x: x.isNotNull() & (x != 0)), F.lit(False))


def _finite(c: str) -> Column:
    return F.forall(c, exprs.finite)


def _near_counts(v: DataFrame, r: DataFrame, radius_arcsec: float, support: float, but_own: bool) -> DataFrame:
    """row, candidates and supported: references of a signal's modality within the radius, and those whose vectors are near enough."""
    edge = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) * 1.000001 + 1e-12
    placed = lambda df: df.where(exprs.valid_position(F.col("ra"), F.col("dec")) & F.col("modality").isNotNull())
    left = spatial.with_cells(placed(v), "ra", "dec", edge, True).select("modality", "cx", "cy", "cz", "row", "id", "ra", "dec", "vector")
    right = spatial.with_cells(placed(r), "ra", "dec", edge, False).select("modality", "cx", "cy", "cz", "row", "id", "ra", "dec", "vector")

    def counted(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        place = lambda t: [t.column(c).to_numpy() for c in ("ra", "dec")]
        near = _near(*place(a), *place(b), radius_arcsec)
        if but_own:
            near &= np.array(a.column("id").to_pylist(), object)[:, None] != np.array(b.column("id").to_pylist(), object)[None, :]
        candidates, supported = near.sum(axis=1), np.zeros(len(near), np.int64)
        vectors = [t.column("vector").combine_chunks() for t in (a, b)]
        size = [pc.fill_null(pc.list_value_length(x), -1).to_numpy() for x in vectors]
        for n in set(size[0].tolist()) & set(size[1].tolist()) - {-1, 0}:
            i, j = (np.flatnonzero(s == n) for s in size)
            x, y = (_matrix(vec.take(pa.array(k))) for vec, k in zip(vectors, (i, j), strict=True))
            p, q = np.nonzero(near[np.ix_(i, j)])
            for at in range(0, len(p), 1 << 16):
                some = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                ok = _exact(x[some[0]], y[some[1]]) <= support
                supported += np.bincount(i[some[0][ok]], minlength=len(supported))
        return pa.RecordBatch.from_arrays([a.column("row").combine_chunks(), pa.array(candidates), pa.array(supported)], ["row", "candidates", "supported"])

    empty = lambda df: df.withColumn("vector", F.when(_usable("vector"), F.col("vector")))
    found = met(empty(left), empty(right), ["modality", "cx", "cy", "cz"], counted, "row long, candidates long, supported long")
    return found.groupBy("row").agg(F.sum("candidates").alias("candidates"), F.sum("supported").alias("supported"))


def _near(ra1, dec1, ra2, dec2, radius_arcsec: float) -> np.ndarray:
    """Which pairs are at most the radius apart: products of directions leave few, haversines decide."""
    (ra1, dec1), (ra2, dec2) = np.radians([ra1, dec1]), np.radians([ra2, dec2])
    toward = lambda ra, dec: np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)
    near = toward(ra1, dec1) @ toward(ra2, dec2).T >= np.cos(np.radians(min(radius_arcsec / 3600, 180.0))) - 1e-13
    i, j = np.nonzero(near)
    a = np.sin((dec2[j] - dec1[i]) / 2) ** 2 + np.cos(dec1[i]) * np.cos(dec2[j]) * np.sin((ra2[j] - ra1[i]) / 2) ** 2
    near[i, j] = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, a)))) * 3600 <= radius_arcsec
    return near


class Pivots:
    """For each modality and length of vectors some of them, and how far from each the vectors next to it lie."""

    def __init__(self, vectors: dict[tuple, np.ndarray]):
        self.vectors = vectors
        self.low = {k: np.full(len(p), np.inf) for k, p in vectors.items()}
        self.high = {k: np.full(len(p), -np.inf) for k, p in vectors.items()}

    @classmethod
    def of(cls, r: DataFrame) -> Pivots:
        """Up to PIVOTS vectors of each kind, by their hashes; fewer where kinds are so many that PIVOT_BYTES would be passed."""
        kinds = r.groupBy("modality", "n").count().agg(F.coalesce(F.sum(F.col("n") * 8), F.lit(0))).first()[0]
        most = min(PIVOTS, PIVOT_BYTES // max(1, kinds))
        order = Window.partitionBy("modality", "n").orderBy(F.xxhash64("vector"), "row")
        some = r.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
        found = defaultdict(list)
        for x in some.select("modality", "n", "vector").collect():  # PIVOT_BYTES at most
            found[x["modality"], x["n"]].append(x["vector"])
        return cls({k: _unit(np.array(rows, np.float64)) for k, rows in found.items()})

    def angles(self, kind: tuple, x: np.ndarray) -> np.ndarray:
        """Angles of unit vectors to the pivots of their kind; one column of zeros for a kind without any."""
        p = self.vectors.get(kind)
        return np.zeros((len(x), 1)) if p is None else np.arccos(np.clip(x @ p.T, -1, 1))

    def bounds(self, kind: tuple, angles: np.ndarray) -> np.ndarray:
        """The least angle that a vector of each cell can have to one with these angles to the pivots (triangle inequality); infinite for empty cells."""
        if kind not in self.vectors:
            return angles
        low, high = self.low[kind], self.high[kind]
        least = np.maximum(np.maximum(angles - high, low - angles), 0)
        return np.where(np.isfinite(high), least, np.inf)


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Kind, rows and unit vectors of the rows of each kind in a batch(modality, n, vector)."""
    kinds = defaultdict(list)
    for i, k in enumerate(zip(batch.column("modality").to_pylist(), batch.column("n").to_pylist(), strict=True)):
        kinds[k].append(i)
    for k, rows in kinds.items():
        yield k, np.array(rows), _unit(_matrix(batch.column("vector").take(pa.array(rows))))


def nearest_distances(v: DataFrame, r: DataFrame, but_own: bool) -> DataFrame:
    """row, nearest and compared: the least distance of each signal to a reference of its modality and length, and with how many it was compared.

    v and r: row, id, modality, n, vector, whole and finite, each written. References are placed by the pivot next to them. A
    signal is compared with the cell that may hold the nearest one, then with all cells that the triangle
    inequality leaves room for something nearer in; the others are passed over.
    """
    pivots = Pivots.of(r)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for kind, rows, x in _by_kind(b):
                a = pivots.angles(kind, x)
                cell[rows], angle[rows] = a.argmin(axis=1), a.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *b.columns], ["cell", "angle", *b.schema.names])

    kind = lambda df: ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("row", "id", "modality", "n", "vector"))
    names = ["row", "id", "modality", "n", "vector"]
    cells = store.cut(r.select(*names).mapInArrow(placed, f"cell long, angle double, {kind(r)}"), "cells")
    for x in cells.groupBy("modality", "n", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a pivot
        if (k := (x["modality"], x["n"])) in pivots.vectors:
            pivots.low[k][x["cell"]], pivots.high[k][x["cell"]] = x["low"], x["high"]

    def asked(first: bool):
        """The cell that each signal is compared with first, or those that may hold something nearer than it has found."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple[np.ndarray, np.ndarray]] = []
                for kind, rows, x in _by_kind(b):
                    a = pivots.angles(kind, x)
                    least = pivots.bounds(kind, a)
                    best = np.lexsort((a, least), axis=1)[:, 0]
                    if first:
                        out.append((rows, best))
                        continue
                    found = b.column("nearest").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(found), np.pi, np.arccos(np.clip(1 - found, -1, 1)))
                    open_ = (least <= reach[:, None] + SLACK) & np.isfinite(least)
                    open_[np.arange(len(rows)), best] = False
                    i, c = np.nonzero(open_)
                    out.append((rows[i], c))
                i, c = (np.concatenate([o[k] for o in out] or [np.empty(0, np.int64)]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), *(b.column(n).take(pa.array(i)) for n in names)], ["cell", *names])

        return f

    def least(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        x, y = (_matrix(t.column("vector").combine_chunks()) for t in (a, b))
        d = 1 - _unit(x) @ _unit(y).T
        if but_own:
            d[np.array(a.column("id").to_pylist(), object)[:, None] == np.array(b.column("id").to_pylist(), object)[None, :]] = np.inf
        best = d.argmin(axis=1)
        there = np.isfinite(d[np.arange(len(d)), best])
        told = np.where(there, _exact(x, y[best]), np.nan)
        return pa.RecordBatch.from_arrays([a.column("row").combine_chunks(), pa.array(told, from_pandas=True), pa.array(np.full(len(x), len(y)))], ["row", "nearest", "compared"])

    def search(of: DataFrame) -> DataFrame:
        found = met(of, cells.drop("angle"), ["modality", "n", "cell"], least, "row long, nearest double, compared long")
        return store.cut(found.groupBy("row").agg(F.min("nearest").alias("nearest"), F.sum("compared").alias("compared")), "found")

    of = f"cell long, {kind(v)}"
    v = v.select(*names)
    one = search(v.mapInArrow(asked(True), of))
    two = search(v.join(one.select("row", "nearest"), "row", "left").select(*names, "nearest").mapInArrow(asked(False), of))
    return one.unionByName(two).groupBy("row").agg(F.min("nearest").alias("nearest"), F.sum("compared").alias("compared"))


def cross_reference(vectors: DataFrame, references: DataFrame, radius_arcsec: float = 2.0, support: float = 0.25, anomaly: float = 0.45, but_own: bool = False) -> DataFrame:
    """Each signal's status against references.

    vectors: signal_id, ra, dec, good_fraction, vector, modality; references: catalog_id, ra, dec, modality,
    vector or null. References without a vector count as candidates by position only; a vector that is empty, zero
    or holds a null is compared with nothing, one with a number that isn't finite is 2 from all others. With
    but_own, references whose catalog_id is, as a text, the signal's own id are left out. Rows that repeat a
    signal_id and good_fraction are added up.

    Nothing goes through the driver but pivots and their bounds; signals and references meet in blocks.
    """
    told = lambda df, name, *more: df.select(name, F.col(name).cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("ra", "dec", *more)), F.col("vector").cast("array<double>").alias("vector"), "modality")
    whole = lambda df: df.withColumns({"row": F.monotonically_increasing_id(), "n": F.size("vector").cast("long"), "usable": _usable("vector") & F.col("modality").isNotNull()})
    v = store.cut(whole(told(vectors, "signal_id", "good_fraction")), "signals")
    r = store.cut(whole(told(references, "catalog_id")), "references")
    near = _near_counts(v, r, radius_arcsec, support, but_own)
    good = r.where("usable")
    counts = good.groupBy("modality", "n").agg(F.count("*").alias("every"))
    full = lambda df: df.where(F.col("usable") & _finite("vector"))
    best = nearest_distances(full(v), full(r), but_own)
    rows = v.select("row", "signal_id", "id", "good_fraction", "modality", "n", "usable")
    rows = rows.join(near, "row", "left").join(best, "row", "left").join(small(counts), ["modality", "n"], "left")
    own = F.lit(0).cast("long")
    if but_own:
        mine = good.groupBy("id", "modality", "n").agg(F.count("*").alias("mine"))
        rows, own = rows.join(mine, ["id", "modality", "n"], "left"), F.coalesce("mine", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    comparable = F.when(F.col("usable"), zero("every") - own).otherwise(0)
    sums = rows.select("signal_id", "good_fraction", zero("supported").alias("supported"), zero("candidates").alias("candidates"), comparable.alias("comparable"), F.when(comparable > 0, F.coalesce("nearest", F.lit(2.0))).alias("nearest"))
    sums = sums.groupBy("signal_id", "good_fraction").agg(*(F.sum(c).alias(c) for c in ("supported", "candidates", "comparable")), F.min("nearest").alias("nearest"))
    return sums.withColumn("status", exprs.triage_status(F.col("supported"), F.col("candidates"), F.col("comparable"), F.col("nearest"), F.col("good_fraction"), anomaly))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if a count shows that it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df
