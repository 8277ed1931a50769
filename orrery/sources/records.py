"""Open-schema records: JSON objects whose keys differ from row to row, as canonical columns and a map of the rest.

Values are variants, so whole numbers, texts, truth values and nested values stay what they are. Of several keys
that mean one column (compared without case), or are equal but for space around them, the last one in the record
counts, also if it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.sources.catalogs import ALIASES, NUMBERS

_RECORD = "map<string,variant>"


def objects_of(body: Column) -> Column:
    """The objects of a JSON body as maps: a list, an object's data or results, or the object itself (S9); null if it isn't JSON."""
    plain = F.ltrim(body)
    wrapped = F.from_json(body, f"struct<data:array<{_RECORD}>,results:array<{_RECORD}>>")
    one = F.from_json(body, _RECORD)
    listed = F.when(plain.startswith("["), F.from_json(body, f"array<{_RECORD}>")).when(plain.startswith("{"), F.coalesce(wrapped["data"], wrapped["results"], F.when(one.isNotNull(), F.array(one))))
    return F.when(F.try_parse_json(body).isNotNull(), F.filter(listed, lambda x: x.isNotNull()))


def _canonical(key: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, own in ALIASES.items() for a in own for x in (a, name)))
    return F.coalesce(F.element_at(known, F.lower(F.trim(key))), F.trim(key))


def normalized(df: DataFrame, record: str = "record") -> DataFrame:
    """df with the canonical columns of its records (P1, P2) in place of the column record, and rest, what else they hold by name.

    Numbers that can't be read, or aren't finite, are null; lists and objects are JSON where a text is wanted.
    A name of df that is a canonical one stays and the record's column is left out.
    """
    told = df.withColumn("__e", F.transform(F.map_entries(record), lambda e, i: F.struct(_canonical(e["key"]).alias("key"), i.alias("at"), e["value"].alias("value"))))
    last = lambda name: F.get(F.filter("__e", lambda e: e["key"] == name), F.size(F.filter("__e", lambda e: e["key"] == name)) - 1)["value"]

    def column(name: str) -> Column:
        if name in NUMBERS:
            return exprs.finite_or_null(F.trim(F.try_variant_get(last(name), "$", "string")).try_cast("double")).alias(name)
        return F.try_variant_get(last(name), "$", "string").alias(name)

    names = [n for n in ALIASES if n not in df.columns]
    others = F.filter("__e", lambda e: ~e["key"].isin(*ALIASES))
    newest = F.filter(others, lambda e: ~F.exists(others, lambda later: (later["key"] == e["key"]) & (later["at"] > e["at"])))
    rest = F.map_from_entries(F.transform(newest, lambda e: F.struct(e["key"], e["value"])))
    return told.select(*(F.col(f"`{c}`") for c in df.columns if c != record), *map(column, names), rest.alias("rest"))


def kinds(df: DataFrame, rest: str = "rest") -> DataFrame:
    """name and kind, the schema that holds all values of a name, for the names that records have besides the canonical ones."""
    return df.select(F.explode(rest).alias("name", "value")).groupBy("name").agg(F.expr("schema_of_variant_agg(value)").alias("kind"))
