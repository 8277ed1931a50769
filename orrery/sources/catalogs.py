"""Catalog rows from records of many shapes to one source schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import exprs

# Canonical names of columns and what catalogs call them.
ALIASES = {
    "ra": ("ra", "ra_icrs", "raj2000", "ramean"),
    "dec": ("dec", "dec_icrs", "dej2000", "decmean"),
    "source_id": ("source_id", "objid", "designation", "id", "sourceid", "main_id", "objname", "prefname", "pl_name", "oid"),
    "pmra": ("pmra", "pm_ra", "pmra_cosdec"),
    "pmdec": ("pmdec", "pm_dec"),
    "epoch": ("ref_epoch", "epoch", "obsepoch"),
    "position_uncertainty_arcsec": ("poserr", "pos_error", "ra_error", "dec_error", "raerror", "decerror", "uncmaja", "err_pos"),
    "parallax": ("parallax", "plx_value"),
    "redshift": ("z", "redshift", "z_value"),
    "object_type": ("otype", "objtype", "prefphytype"),
    "morphology": ("morphology",),
    "spectral_type": ("sp_type", "spectral_type"),
    "observation_date": ("obsdate", "obs_date", "observation_date", "date_obs"),
    "quality_flags": ("quality", "quality_flag", "flags"),
}
NUMBERS = ("ra", "dec", "pmra", "pmdec", "epoch", "position_uncertainty_arcsec", "parallax", "redshift")
_NEEDED = ("ra", "dec", "source_id", "parallax", "pmra", "pmdec", "epoch", "position_uncertainty_arcsec")


def normalized(df: DataFrame) -> DataFrame:
    """df with aliases under their canonical names; of several, the last column that has a value wins.

    Names are compared without case and surrounding space; numbers that can't be read are null; other columns
    stay as they are.
    """
    canonical = {a: name for name, own in ALIASES.items() for a in own}
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(canonical.get(c.strip().lower(), c.strip()), []).append(c)

    def column(name: str, own: list[str]) -> Column:
        value = F.coalesce(*(F.col(f"`{c}`") for c in reversed(own)))
        if name in NUMBERS:
            value = exprs.finite_or_null(F.trim(value.cast("string")).try_cast("double"))
        return (value.cast("string") if name == "source_id" else value).alias(name)

    return df.select(*(column(n, own) for n, own in groups.items()))


def to_sources(df: DataFrame, catalog: str, endpoint: str = "", retrieved_at: str = "") -> tuple[DataFrame, DataFrame]:
    """Normalised rows as sources of a catalog, and the rows without a position, for a side table (P3, P4, F14, ST7).

    A source without an id is named by its position. The stamp is given, not taken, so runs can be repeated.
    """
    rows = normalized(df)
    for name in _NEEDED:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double" if name in NUMBERS else "string"))
    ok = exprs.valid_position(F.col("ra"), F.col("dec"))
    placed = rows.where(ok).withColumn("ra", exprs.normalized_ra(F.col("ra")))
    named = F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.format_string("%s:%.10f:%.10f", F.lit(catalog), "ra", "dec"))
    provenance = F.struct(F.lit(catalog).alias("catalog"), F.lit(endpoint).alias("endpoint"), F.lit(retrieved_at).alias("retrieved_at"))
    return placed.withColumn("source_id", named).withColumn("catalog", F.lit(catalog)).withColumn("provenance", provenance), rows.where(~ok).withColumn("error_type", F.lit("position"))


def json_records(text: Column, schema: str) -> Column:
    """Rows of a JSON body: a list, an object's data or results, or the object itself."""
    one = f"array<struct<{schema}>>"
    wrapped = F.from_json(text, f"struct<data:{one},results:{one}>")
    listed = F.from_json(text, one)
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(F.coalesce(wrapped["data"], wrapped["results"], F.array(F.from_json(text, f"struct<{schema}>"))))


def resolved(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """names(name) with the position of the object of that name or alias, compared without case and extra space.

    resolution tells names that one position answers to (resolved) from those of several (ambiguous) and none
    (unknown); only the first have a position.
    """
    key = lambda c: F.lower(exprs.collapsed(F.col(c)))
    borne = dimension.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"), "ra", "dec").select(key("n").alias("k"), F.struct("ra", "dec").alias("at"))
    known = borne.groupBy("k").agg(F.count_distinct("at").alias("n"), F.min("at").alias("at"))
    at = names.withColumn("k", key("name")).join(known, "k", "left").drop("k")
    resolution = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    one = lambda c: F.when(F.col("n") == 1, F.col("at").getField(c)).alias(c)
    return at.select(*names.columns, one("ra"), one("dec"), resolution.alias("resolution"))


def comment_records(body: Column) -> Column:
    """The rows of a CSV body as maps of texts by column: lines that begin with # after blanks are left out.

    The first line that is left holds the names; a cell in quotes may hold commas and doubled quotes, no line
    breaks. Cells that a line lacks are null.
    """
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    plain = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), '""', '"')).otherwise(c)
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),')), plain)
    names = F.transform(cells(F.get(lines, 0)), lambda n: F.trim(F.regexp_replace(n, "^\ufeff", "")))
    row = lambda line: F.map_from_arrays(names, F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.get(cells(line), i)))
    return F.when(F.size(lines) > 1, F.transform(F.slice(lines, 2, F.size(lines) - 1), row)).otherwise(F.array().cast("array<map<string,string>>"))


def evidence_sources(text: Column) -> Column:
    """Sources of an evidence document, as JSON objects with their catalog.

    Taken from catalog_results (each with its catalog's name where it has none), else counterparts, else
    sources, else the document itself if it has a catalog; a list of documents gives those of all.
    """
    one = "struct<catalog_results:map<string,struct<sources:array<string>>>,counterparts:map<string,array<string>>,sources:array<string>,catalog:string>"
    texts = "array<string>"

    def of(doc: Column) -> Column:
        d = F.from_json(doc, one)
        named = lambda e: F.transform(F.coalesce(e["value"]["sources"], F.array().cast(texts)), lambda s: F.when(F.get_json_object(s, "$.catalog").isNull(), F.concat(F.lit('{"catalog":'), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(","), F.regexp_replace(s, r"^\s*\{", ""))).otherwise(s))
        from_results = F.flatten(F.transform(F.map_entries(d["catalog_results"]), named))
        return F.coalesce(from_results, F.flatten(F.map_values(d["counterparts"])), d["sources"], F.when(d["catalog"].isNotNull(), F.array(doc)), F.array().cast(texts))

    return F.when(F.ltrim(text).startswith("["), F.flatten(F.transform(F.from_json(text, texts), of))).otherwise(of(text))


# Names of measured columns.
_MAGNITUDE = r"(?i)^(j|h|k|w[1-4])_?m(?:pro|ag)?$"
_FLUX = r"(?i)(flux|fpeak|fint|peakflux|intflux)"
_NOT_MEASURED = r"(?i)(err|sig|snr|rms|noise|flag|qual|limit|upper|chisq|chi2)"


def infrared_or_radio(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources of infrared and radio catalogs that have a position, each catalog, id and position once.

    sources: catalog, source_id, ra, dec, data and, as far as known, wavelength; the registry knows the rest.
    """
    known = F.broadcast(registry.select("catalog", F.lower("wavelength").alias("__w")))  # one row a catalog
    own = F.nullif(F.lower(F.trim("wavelength")), F.lit("")) if "wavelength" in sources.columns else F.lit(None)
    waves = sources.join(known, "catalog", "left").withColumn("wavelength", F.coalesce(own, "__w", F.lit("unknown"))).drop("__w")
    ok = waves.where(F.col("wavelength").isin("infrared", "radio") & exprs.valid_position(F.col("ra"), F.col("dec")))
    return ok.dropDuplicates(["catalog", "source_id", "ra", "dec"])


def photometry(sources: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each measurement in sources(wavelength, data map of texts): keys, label and value.

    Infrared: bands within 100 magnitudes of 0, by band; radio: all columns that tell a flux. Errors, limits
    and flags are not measurements.
    """
    at = sources.select(*keys, "wavelength", F.explode("data").alias("name", "text")).withColumn("name", F.trim("name"))
    at = at.where(~F.col("name").rlike(_NOT_MEASURED)).withColumn("value", exprs.finite_or_null(F.trim("text").try_cast("double")))
    infrared = (F.col("wavelength") == "infrared") & F.col("name").rlike(_MAGNITUDE) & F.col("value").between(-100, 100)
    radio = (F.col("wavelength") == "radio") & F.col("name").rlike(_FLUX) & F.col("value").isNotNull()
    label = F.when(F.col("wavelength") == "infrared", F.upper(F.regexp_extract("name", _MAGNITUDE, 1))).otherwise(F.col("name"))
    return at.where(infrared | radio).select(*keys, label.alias("label"), "value")
