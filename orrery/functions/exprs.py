"""Scalar expressions of the catalog engine: each takes and returns Columns, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FractionalType, MapType, StringType


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """Whether x is a number, neither NaN nor infinite; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def rounded(x: Column, digits: int) -> Column:
    """F.round of a double, by plain arithmetic where that can only be the same: positive, not too large and not near a half; decimals are ten times slower."""
    scaled = x * 10.0**digits
    plain = (x > 0) & (scaled < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001)
    return F.when(plain, F.rint(scaled) / 10.0**digits).otherwise(F.round(x, digits))


def normalized_ra(ra: Column) -> Column:
    """Right ascension in [0, 360) (C4)."""
    return F.pmod(ra, F.lit(360.0))


def valid_position(ra: Column, dec: Column, epoch: Column | None = None) -> Column:
    """Finite coordinates with a declination within 90 degrees and, if there is one, an epoch of 1800 to 2200."""
    ok = finite(ra) & finite(dec) & (F.abs(dec) <= 90)
    return ok if epoch is None else ok & (epoch.isNull() | F.coalesce(epoch.between(1800, 2200), F.lit(False)))


def angular_separation(ra1, dec1, ra2, dec2, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Great-circle distance in arc seconds, by haversines (C1); cos1 and cos2, the declinations' cosines, if they are at hand."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    cos1, cos2 = F.cos(F.radians(dec1)) if cos1 is None else cos1, F.cos(F.radians(dec2)) if cos2 is None else cos2
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + cos1 * cos2 * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))) * 3600


def propagated(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, epoch: Column, to_epoch: Column) -> tuple[Column, Column]:
    """Position at to_epoch, with proper motions in mas a year (the one in RA times cos dec); as it is if anything is missing."""
    known = epoch.isNotNull() & to_epoch.isNotNull() & pm_ra.isNotNull() & pm_dec.isNotNull()
    r, d, dt = F.radians(ra), F.radians(dec), to_epoch - epoch
    scale = F.radians(dt / 3_600_000.0)
    a, b = pm_ra * scale, pm_dec * scale
    x = F.cos(d) * F.cos(r) - a * F.sin(r) - b * F.sin(d) * F.cos(r)
    y = F.cos(d) * F.sin(r) + a * F.cos(r) - b * F.sin(d) * F.sin(r)
    z = F.sin(d) + b * F.cos(d)
    return (
        F.when(known, normalized_ra(F.degrees(F.atan2(y, x)))).otherwise(ra),
        F.when(known, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).otherwise(dec),
    )


def match_score(separation: Column, source_error: Column, target_error: Column | None = None) -> Column:
    """Gaussian likelihood of a separation in arc seconds; linear in it if neither side's error is known."""
    own = finite_or_null(source_error)
    other = F.lit(None).cast("double") if target_error is None else finite_or_null(target_error)
    sigma = F.sqrt(F.pow(F.greatest(own, F.lit(0.1)), 2) + F.pow(F.greatest(other, F.lit(0.0)), 2))
    gauss = F.exp(-0.5 * F.pow(separation / sigma, 2))
    linear = 1.0 - F.least(separation / 3.0, F.lit(10.0)) / 10.0
    score = F.when(own.isNotNull() | other.isNotNull(), gauss).otherwise(linear)
    return F.when(separation < 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def distance_pc(parallax_mas: Column, distance: Column | None = None) -> Column:
    """Distance in parsecs: the given one, else from a parallax; null unless positive."""
    from_parallax = F.try_divide(F.lit(1000.0), finite_or_null(parallax_mas))
    found = from_parallax if distance is None else F.coalesce(finite_or_null(distance), from_parallax)
    return F.when(found > 0, found)


def year_of(x: Column) -> Column:
    """A date text or a number in text as a year, with fraction for numbers; null if neither."""
    return F.coalesce(x.try_cast("double"), F.year(F.try_to_timestamp(x)).cast("double"))


# Canonical object types and what catalogs call them.
OBJECT_TYPES = {
    "star": ("*", "star"),
    "galaxy": ("g", "galaxy"),
    "quasar": ("qso", "quasar"),
    "nebula": ("neb", "nebula"),
    "star_cluster": ("cl*", "star cluster", "star_cluster"),
}
# Text in a host, and the archive that it belongs to.
ARCHIVES = {"esa.int": "gaia", "stsci.edu": "mast", "irsa.ipac": "irsa", "sdss.org": "sdss", "heasarc": "heasarc", "simbad": "simbad", "exoplanetarchive": "exoplanet", "ned.ipac": "ned", "vizier": "vizier"}


def canonical_type(x: Column) -> Column:
    """The canonical object type, else the text itself, trimmed and in lower case."""
    low = F.lower(F.trim(x))
    return reduce(lambda out, kv: F.when(low.isin(*kv[1]), F.lit(kv[0])).otherwise(out), OBJECT_TYPES.items(), low)


def inside_polygon(ra: Column, dec: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon, by the parity of edges that a ray crosses; RA taken about the point.

    Where no turn of the circle lies between, differences are taken as they are: a point on an edge is where plain arithmetic has it.
    """

    def turns(v: float) -> Column:
        return F.floor((F.lit(v) - ra + 180.0) / 360.0)

    crossed = F.lit(0)
    for (ra1, dec1), (ra2, dec2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        along = F.lit(ra2 - ra1) - (turns(ra2) - turns(ra1)) * 360.0
        at = F.lit(ra1) - ra - turns(ra1) * 360.0 + F.try_divide((dec - dec1) * along, F.lit(dec2 - dec1))
        crossed = crossed + F.when(((F.lit(dec1) > dec) != (F.lit(dec2) > dec)) & (at > 0), 1).otherwise(0)
    return F.coalesce(crossed % 2 == 1, F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of doubles, within 0 and 2; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    distance = 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance)))  # greatest skips nulls


def proper_motion(pm_ra: Column, pm_dec: Column) -> Column:
    """Total proper motion."""
    return F.hypot(pm_ra, pm_dec)


def phase(time: Column, epoch: Column, period) -> Column:
    """Phase of a time in (-0.5, 0.5] (C11)."""
    p = F.pmod((time - epoch) / _c(period), F.lit(1.0))
    return F.when(p > 0.5, p - 1).otherwise(p)


def tangent_offsets(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Offsets from a centre in arc seconds, east and north."""
    return (F.pmod(ra - ra0 + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians(dec0)) * 3600, (dec - dec0) * 3600


def object_id(catalog: Column, source_id: Column) -> Column:
    """The stable id of the object that a source founds: 32 hex digits."""
    return F.substring(F.sha2(F.concat(F.lit('["'), catalog, F.lit('", "'), source_id, F.lit('"]')), 256), 1, 32)


def entity_id(kind: str, name: Column) -> Column:
    """kind and the percent-quoted, trimmed name."""
    return F.concat(F.lit(f"{kind}:"), F.replace(F.url_encode(F.trim(name)), F.lit("+"), F.lit("%20")))


def tic_number(x: Column) -> Column:
    """The digits of a TIC identifier; null if it isn't one."""
    return F.nullif(F.regexp_extract(F.trim(x), r"(?i)^(?:TIC\s*)?(\d+)$", 1), F.lit(""))


def safe_filename(x: Column) -> Column:
    """The last part of a path with other characters than letters, digits, dot, dash and underscore as underscores."""
    return F.regexp_replace(F.regexp_extract(x, r"([^/]*)$", 1), r"[^A-Za-z0-9._-]+", "_")


def collapsed(x: Column) -> Column:
    """Text trimmed, with each run of white space as one space."""
    return F.regexp_replace(F.trim(x), r"\s+", " ")


def provider_of(url: Column, hosts: dict[str, str] = ARCHIVES) -> Column:
    """The archive that a URL's host belongs to: the first whose text the host holds, else the host."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    return reduce(lambda out, kv: F.when(host.contains(kv[0]), F.lit(kv[1])).otherwise(out), reversed(list(hosts.items())), host)


def present(x: Column, kind: DataType) -> Column:
    """Whether a value of this type is there (F16): not null, a finite number, a text or collection that isn't empty."""
    if isinstance(kind, FractionalType):
        return finite(x.cast("double"))
    if isinstance(kind, StringType):
        return F.coalesce(x != "", F.lit(False))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def layered(*maps: Column) -> Column:
    """One map of several, in which later maps' values stand before earlier ones', nulls among them; null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    return reduce(lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high), (F.coalesce(m, empty) for m in maps))


def by_rank(rows: Column) -> Column:
    """An array of structs (rank, row) to its rows in the order of their ranks; rows may hold what can't be ordered, such as maps."""
    compared = lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)
    return F.transform(F.array_sort(rows, compared), lambda x: x["row"])


def decoded_map(text: Column) -> Column:
    """A JSON object as a map of texts; an empty map if it isn't one."""
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("{"), text), "map<string,string>"), F.create_map().cast("map<string,string>"))


def observation_id(tic: Column, sector: Column, flux: Column, data_uri: Column, version: Column) -> Column:
    """The id of a light curve from its product's address and version, or without an address from sector, target and flux."""
    key = F.substring(F.sha2(F.concat(data_uri, F.decode(F.lit(b"\0"), "UTF-8"), F.coalesce(version, F.lit(""))), 256), 1, 16)
    rest = F.concat(F.lit("sector-"), F.coalesce(F.nullif(sector.cast("string"), F.lit("0")), F.lit("unknown")), F.lit("-tic-"), tic.cast("string"), F.lit("-"), F.lower(flux))
    return F.when(F.coalesce(data_uri != "", F.lit(False)), F.concat(F.lit("tess-product-"), key, F.lit("-"), rest)).otherwise(F.concat(F.lit("tess-"), rest))


def significant(x: Column, digits: int = 3) -> Column:
    """A number in text with so many significant digits, without trailing zeros; exponents below 1e-4 and from 10 ** digits on."""
    size = F.floor(F.log10(F.abs(x))).cast("int")
    rounded = F.format_string(f"%.{digits - 1}e", x).cast("double")  # rounding may reach the next power of ten
    size = F.when(F.abs(rounded) >= F.pow(F.lit(10.0), size + 1), size + 1).otherwise(size)
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    plain = reduce(lambda rest, n: F.when(digits - 1 - size == n, F.format_string(f"%.{n}f", x)).otherwise(rest), range(digits + 4), F.lit(None).cast("string"))
    return F.when(x == 0, "0").when((size < -4) | (size >= digits), trim(F.format_string(f"%.{digits - 1}e", x))).otherwise(trim(plain))


def triage_status(supported: Column, candidates: Column, comparable: Column, nearest: Column, good_fraction: Column, anomaly: float = 0.45) -> Column:
    """What the evidence for a signal amounts to."""
    return (
        F.when(supported == 1, "matched")
        .when(supported > 1, "ambiguous")
        .when(candidates > 0, "position_only_review")
        .when(comparable == 0, "insufficient_reference_coverage")
        .when((nearest >= anomaly) & (good_fraction >= 0.8), "novelty_review_candidate")
        .otherwise("unmatched")
    )
