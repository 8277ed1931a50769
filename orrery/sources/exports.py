"""Datasets out of DataFrames: a format by size and use, bounded parts, checksums and a manifest; read back they are what was written.

CSV: texts are in quotes, a null is an empty cell without them, a quote within a text is doubled, line breaks
stay. Stamps have six digits and a zone; bytes are base64; nested values are JSON. FITS holds whole numbers,
numbers, truth values and texts, and the rest as in CSV. The manifest has the schema that all are read back to.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, FractionalType, IntegralType, MapType, StructType, TimestampType, VariantType

from orrery.operators.store import cut
from orrery.sources import sinks, tables
from orrery.sources.tables import TableError, filesystem


@dataclass(frozen=True)
class Policy:
    """Sizes from which a dataset is Parquet, and rows of a part (K9)."""

    parquet_rows: int = 10_000
    parquet_fields: int = 64
    parquet_bytes: int = 8 << 20
    part_rows: int = 100_000
    part_bytes: int = 64 << 20

    def __post_init__(self):
        if any(v <= 0 for v in asdict(self).values()):
            raise ValueError("thresholds must be positive")


def nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType, VariantType))


#: How stamps are written, in JSON as well.
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_JSON = {"timestampFormat": _STAMP, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


#: No character: what CSV's reader takes for an escaped escape, and no text may hold.
_NEVER = "\uffff"


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def as_text(c: Column, kind: DataType) -> Column:
    """A value as a text that from_text reads back; null stays null."""
    if nested(kind):
        return F.when(c.isNotNull(), F.to_json(c, _JSON))
    if isinstance(kind, TimestampType):
        return F.date_format(c, _STAMP)
    return F.base64(c) if isinstance(kind, BinaryType) else c.cast("string")


def from_text(c: Column, kind: DataType) -> Column:
    if isinstance(kind, VariantType):
        return F.parse_json(c)
    if nested(kind):
        return F.from_json(c, kind, {**_JSON, "mode": "FAILFAST"})
    return F.unbase64(c) if isinstance(kind, BinaryType) else c.cast(kind)


def csv_line(df: DataFrame) -> tuple[str, Column]:
    """The head and the line of each row. A table of one column has an empty second one, so that no line is blank."""
    sound = lambda x: F.when(F.contains(x, F.lit(_NEVER)), F.raise_error(F.lit("CSV holds no U+FFFF"))).otherwise(x)
    quoted = lambda x: F.concat(F.lit('"'), F.replace(sound(x), F.lit('"'), F.lit('""')), F.lit('"'))
    plain = (IntegralType, FractionalType, BooleanType)
    cells = [as_text(named(f.name), f.dataType) if isinstance(f.dataType, plain) else quoted(as_text(named(f.name), f.dataType)) for f in df.schema]
    cells = [F.coalesce(c, F.lit("")) for c in cells] + [F.lit("")] * (len(cells) == 1)
    heads = ['"' + c.replace('"', '""') + '"' for c in df.columns] + [""] * (len(df.columns) == 1)
    return ",".join(heads) + "\n", F.concat(*[x for c in cells for x in (c, F.lit(","))][:-1])


def fits_columns(df: DataFrame) -> DataFrame:
    """df as columns that a FITS table holds, those without a plain name under a name by their place."""
    told = []
    for k, f in enumerate(df.schema, 1):
        c, kind = named(f.name), f.dataType
        held = c.cast("long") if isinstance(kind, IntegralType) else c.cast("double") if kind.typeName() in ("float", "double") else c if isinstance(kind, BooleanType) else as_text(c, kind)
        told.append(held.alias(f.name if re.fullmatch(r"\w{1,60}", f.name, re.A) else f"col{k}"))
    return df.select(*told)


def part_digests(spark, folder: str) -> DataFrame:
    """path, length and SHA-256 of each file under folder; tasks read the files in pieces."""
    names = spark.read.format("binaryFile").load(folder).select("path", "length")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for path in b.column("path").to_pylist():
                fs, file = filesystem(path)
                sha = hashlib.sha256()
                with fs.open_input_stream(file, compression=None) as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                told.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(told, pa.string())], ["path", "length", "sha256"])

    return names.repartition("path").mapInArrow(digests, "path string, length long, sha256 string")


def chosen_format(df: DataFrame, rows: int, size: int, asked: str | None = None, use: str | None = None, policy: Policy = Policy()) -> str:
    """The format asked for, else jsonl for nested columns, fits for astronomy, parquet if large, csv otherwise."""
    if asked:
        return asked
    if any(nested(f.dataType) for f in df.schema):
        return "jsonl"
    if use == "astronomy":
        return "fits"
    return "parquet" if rows >= policy.parquet_rows or len(df.columns) >= policy.parquet_fields or size >= policy.parquet_bytes else "csv"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text (K6)."""
    return df.select(*(F.to_json(f.name).alias(f.name) if nested(f.dataType) else F.col(f.name) for f in df.schema))


def part_digests(spark, folder: str) -> DataFrame:
    """path, length and SHA-256 of each file under folder; tasks read the files in pieces."""
    names = spark.read.format("binaryFile").load(folder).select("path", "length")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for path in b.column("path").to_pylist():
                fs, file = filesystem(path)
                sha = hashlib.sha256()
                with fs.open_input_stream(file, compression=None) as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                told.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(told, pa.string())], ["path", "length", "sha256"])

    return names.repartition("path").mapInArrow(digests, "path string, length long, sha256 string")


def _written(df: DataFrame, kind: str, folder: str, rows: int, size: int, policy: Policy) -> list[dict]:
    """Write df's parts under folder; path, rows (where known), bytes and sha256 of each."""
    spark = df.sparkSession
    if kind == "parquet":
        # a part's rows by the mean row: how far Parquet compresses is known only afterwards
        most = max(1, min(policy.part_rows, policy.part_bytes * max(1, rows) // max(1, size)))
        df.write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(folder)
        return [{"path": p["path"], "bytes": p["length"], "sha256": p["sha256"]} for p in part_digests(spark, folder).orderBy("path").collect()]  # one row a part
    tables.register(spark)
    if kind == "fits":
        writer = fits_columns(df).write.format("fits")
    else:
        head, line = csv_line(df) if kind == "csv" else ("", F.to_json(F.struct(*(named(c) for c in df.columns)), _JSON))
        writer = df.select(line.alias("line")).write.format("orrery_lines").option("suffix", f".{kind}").option("head", head)
        if kind == "json":
            writer = writer.option("head", "[").option("separator", ",\n").option("foot", "]\n")
    writer.option("path", folder).option("partBytes", policy.part_bytes).option("partRows", policy.part_rows).mode("append").save()
    return [{"path": f"{folder}/{p['name']}", "rows": p["rows"], "bytes": p["bytes"], "sha256": p["sha256"]} for p in sinks.parts_of(folder)]


def materialize(df: DataFrame, path: str, asked: str | None = None, use: str | None = None, policy: Policy = Policy(), facts: dict | None = None) -> dict:
    """Write df under path in parts, and a manifest with counts and checksums.

    Formats: parquet, csv, jsonl, json (an array a part) and fits. Parts of all but Parquet are closed before a
    row that would take them beyond part_bytes or part_rows. Parts are written under a name of this run; the manifest,
    written last by a rename, is what names them: a run that is lost leaves no dataset. facts, such as
    provenance() gives them, are put into the manifest as they are.
    """
    df = cut(df, "dataset")  # read once, so that the counts are those of the rows that are written
    size = df.select(F.sum(F.length(F.to_json(F.struct(*(named(c) for c in df.columns))))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    kind = chosen_format(df, size["rows"], size["bytes"] or 0, asked, use, policy)
    if kind not in ("parquet", "csv", "jsonl", "json", "fits"):
        raise TableError(f"no format {kind}")
    parts = _written(df, kind, f"{path.rstrip('/')}/data-{uuid.uuid4().hex}", size["rows"], size["bytes"] or 0, policy)
    manifest = {
        **(facts or {}), "format": kind, "asked": asked or use, "written_as": kind, "rows": size["rows"], "fields": [[f.name, f.dataType.simpleString()] for f in df.schema], "schema": df.schema.jsonValue(),
        "bytes": sum(p["bytes"] for p in parts), "parts": parts,
    }
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/.manifest.json") as f:
        f.write(json.dumps(manifest, sort_keys=True).encode())
    fs.move(f"{root}/.manifest.json", f"{root}/manifest.json")
    return manifest


def provenance(members: DataFrame, chosen: DataFrame, wanted: int) -> dict:
    """What a manifest tells of where a dataset's objects come from (K10): providers with their records, and how far it was reused.

    members: object_id, catalog, provider; chosen: object_id, reused. status is completed if as many objects as
    wanted are there.
    """
    own = members.join(chosen.select("object_id"), "object_id", "left_semi")
    providers = {r["provider"]: r["count"] for r in own.groupBy("provider").count().collect()}  # a row a provider
    catalogs = sorted(r["catalog"] for r in own.select("catalog").distinct().collect())  # a row a catalog
    total, reused = chosen.agg(F.count(F.lit(1)), F.count_if("reused")).first()
    return {"providers": providers, "catalogs": catalogs, "objects": total, "reused": reused, "reuse_ratio": reused / max(1, total), "requested": wanted, "status": "completed" if total >= wanted else "partial"}


def read_back(spark, path: str, verify: bool = False) -> DataFrame:
    """The dataset that the manifest under path names, with its columns and types.

    verify counts the rows and takes the parts' digests first, and raises TableError if they are others than
    the manifest tells.
    """
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema, kind, paths = StructType.fromJson(manifest["schema"]), manifest["written_as"], [p["path"] for p in manifest["parts"]]
    if not paths:
        found = spark.createDataFrame([], schema)
    elif kind == "parquet":
        found = spark.read.schema(schema).parquet(*paths)
    elif kind in ("jsonl", "json"):
        found = spark.read.schema(schema).options(**_JSON, mode="FAILFAST", multiLine=str(kind == "json").lower()).json(paths)
    elif kind == "csv":
        texts = ", ".join(f"c{k} string" for k in range(max(2, len(schema))))
        # an empty cell without quotes is read as a mark that no text equals, then as null
        reader = spark.read.schema(texts).options(header="true", multiLine="true", quote='"', escape='"', lineSep="\n", nullValue=uuid.uuid4().hex, emptyValue="", charToEscapeQuoteEscaping=_NEVER, mode="FAILFAST")
        found = reader.csv(paths).select(*(from_text(F.col(f"c{k}"), f.dataType).alias(f.name) for k, f in enumerate(schema)))
    else:
        tables.register(spark)
        folder = paths[0].rpartition("/")[0]
        raw = spark.read.format("fits").option("nonfinite", "keep").option("merge", "false").load(folder)
        same = (IntegralType, BooleanType)
        told = [named(n).cast(f.dataType) if isinstance(f.dataType, same) or f.dataType.typeName() in ("float", "double") else from_text(named(n), f.dataType) for n, f in zip(raw.columns, schema, strict=True)]
        found = raw.select(*(c.alias(f.name) for c, f in zip(told, schema, strict=True)))
    if verify:
        if (rows := found.count()) != manifest["rows"]:
            raise TableError(f"{rows} rows where the manifest has {manifest['rows']}")
        if paths:
            own = {p["path"].rpartition("/")[2]: p["sha256"] for p in part_digests(spark, paths[0].rpartition("/")[0]).collect()}  # one row a part
            if bad := [p["path"] for p in manifest["parts"] if own.get(p["path"].rpartition("/")[2]) != p["sha256"]]:
                raise TableError(f"parts other than they were written: {bad[:5]}")
    return found
