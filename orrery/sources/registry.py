"""The registry of catalogs as a DataFrame: what exists, by provider, wavelength and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Catalog, provider, wavelength, enabled, profiles.
CATALOGS = (
    ("gaia_dr3", "tap", "optical", True, ("full", "optical", "stellar")),
    ("simbad", "tap", "multi", True, ("full", "optical", "stellar", "identity")),
    ("ned", "tap", "extragalactic", True, ("full", "optical", "extragalactic", "identity")),
    ("exoplanet_archive", "tap", "exoplanet", True, ("full", "exoplanet", "stellar")),
    ("vizier_2mass_reference", "tap", "infrared", False, ("full", "infrared", "stellar")),
    ("twomass_psc", "irsa_gator", "infrared", True, ("full", "infrared", "stellar")),
    ("allwise", "irsa_gator", "infrared", True, ("full", "infrared", "stellar")),
    ("panstarrs_dr2", "mast", "optical", True, ("full", "optical", "extragalactic")),
    ("sdss", "sdss", "optical", True, ("full", "optical", "extragalactic", "spectroscopy")),
    ("first", "heasarc_xamin", "radio", True, ("full", "radio", "extragalactic")),
    ("nvss", "heasarc_xamin", "radio", True, ("full", "radio", "extragalactic")),
    ("vlass", "heasarc_xamin", "radio", True, ("full", "radio", "extragalactic")),
    ("lotss", "heasarc_xamin", "radio", True, ("full", "radio", "extragalactic")),
    ("rosat", "heasarc_xamin", "xray", True, ("full", "xray", "high-energy")),
    ("chandra", "heasarc_xamin", "xray", True, ("full", "xray", "high-energy")),
    ("xmm", "heasarc_xamin", "xray", True, ("full", "xray", "high-energy")),
)


def registry(spark: SparkSession, rows=CATALOGS) -> DataFrame:
    return spark.createDataFrame([(*r[:4], list(r[4])) for r in rows], "catalog string, provider string, wavelength string, enabled boolean, profiles array<string>")


def with_wavelength(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources with their wavelength: their own, else the registry's, else unknown."""
    known = F.broadcast(rows.select("catalog", F.col("wavelength").alias("__w")))  # one row a catalog
    own = F.nullif(F.trim("wavelength"), F.lit("")) if "wavelength" in sources.columns else F.lit(None)
    return sources.join(known, "catalog", "left").withColumn("wavelength", F.coalesce(own, "__w", F.lit("unknown"))).drop("__w")


def quoted(text: Column) -> Column:
    """Percent-quoted, with / left alone and a space as %20."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def links(catalog: Column, source_id: Column, ra: Column, dec: Column, provider: Column, wavelength: Column | None = None) -> Column:
    """A map of outbound links by site, without the sites that don't apply (P5)."""
    at = F.concat_ws("%20", ra.cast("string"), dec.cast("string"))
    every = F.array(
        F.when(catalog == "simbad", F.struct(F.lit("SIMBAD").alias("site"), F.concat(F.lit("https://simbad.cds.unistra.fr/simbad/sim-id?Ident="), quoted(source_id)).alias("url"))),
        F.when(catalog == "ned", F.struct(F.lit("NED").alias("site"), F.concat(F.lit("https://ned.ipac.caltech.edu/byname?objname="), quoted(source_id)).alias("url"))),
        F.when(provider == "mast", F.struct(F.lit("MAST").alias("site"), F.concat(F.lit("https://mast.stsci.edu/portal/Mashup/Clients/Mast/Portal.html?searchQuery="), at).alias("url"))),
        F.when(F.lit(False) if wavelength is None else wavelength.isin("optical", "extragalactic"), F.struct(F.lit("LegacySurvey").alias("site"), F.concat(F.lit("https://www.legacysurvey.org/viewer/fits-cutout?ra="), ra.cast("string"), F.lit("&dec="), dec.cast("string"), F.lit("&pixscale=0.262&bands=griz")).alias("url"))),
        F.when(provider == "irsa_gator", F.struct(F.lit("IRSA").alias("site"), F.concat(F.lit("https://irsa.ipac.caltech.edu/applications/finderchart/servlet/api?locstr="), at).alias("url"))),
    )
    return F.map_from_entries(F.array_compact(every))
