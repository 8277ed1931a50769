"""Readers of scientific table formats as Spark data sources: ipac, votable and fits.

Columns are learnt from headers alone. A FITS file is read by ranges of rows and an IPAC file by ranges of
bytes that end with a line, so one large file is many tasks; a VOTable is parsed as it streams by. Rows come as
Arrow batches of bounded size. With a schema given, only its columns are converted, and comparisons of FITS
columns with numbers are made before that. Files are opened through the filesystem that their URI names.
"""

from __future__ import annotations

import hashlib
import io
import math
import operator
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType


class TableError(ValueError):
    """A file that is not what its format asks for."""


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files under path with their bytes, but those whose names begin with a dot or underscore."""
    from pyarrow import fs

    system, root = filesystem(path)
    whole = system.get_file_info(root)
    if whole.type == fs.FileType.File:
        return [(root, whole.size)]
    return sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


# --- IPAC ---

_IPAC_TYPES = {"int": LongType, "long": LongType, "i": LongType, "l": LongType, "double": DoubleType, "float": DoubleType, "real": DoubleType, "d": DoubleType, "f": DoubleType, "r": DoubleType}


@dataclass
class IpacLayout:
    """Columns of a table by the bars of its header, and where its rows begin."""

    schema: StructType
    bars: list[int]
    nulls: list[str]
    at: int = 0

    @classmethod
    def of(cls, lines: Iterable[str]) -> IpacLayout:
        """From a file's first lines, with their ends; reads on to the first row only."""
        heads, at = [], 0
        for line in lines:
            if line.startswith("|"):
                heads.append(line.rstrip("\r\n"))
            elif line.strip() and not line.startswith("\\"):
                break
            at += len(line.encode())
        if not heads:
            raise TableError("no header between bars")
        bars = [i for i, c in enumerate(heads[0]) if c == "|"]
        cells = lambda line: [line[a + 1 : b].strip() for a, b in zip(bars, bars[1:], strict=False)]
        names = cells(heads[0])
        kinds = [_IPAC_TYPES.get(k.lower(), StringType) for k in cells(heads[1])] if len(heads) > 1 else [StringType] * len(names)
        return cls(StructType([StructField(n, k()) for n, k in zip(names, kinds, strict=True)]), bars, cells(heads[3]) if len(heads) > 3 else [""] * len(names), at)

    def row(self, line: str, wanted: Iterable[int] | None = None) -> list:
        """The values of a line, null where a cell is blank or the null mark; wanted: places of columns."""
        ends = [*self.bars[1:-1], None]
        out = []
        for i in range(len(ends)) if wanted is None else wanted:
            cell, kind = line[self.bars[i] : ends[i]].strip(), type(self.schema[i].dataType)
            null = cell in ("", self.nulls[i]) or cell.lower() == "null"
            out.append(None if null else int(cell) if kind is LongType else float(cell) if kind is DoubleType else cell)
        return out


def _is_row(line: str) -> bool:
    return bool(line.strip()) and not line.startswith(("\\", "|"))


def parse_ipac(text: str) -> tuple[StructType, list[list]]:
    """Columns and rows of a table with header lines between bars; null where a cell is blank or the null mark."""
    lines = text.splitlines()
    layout = IpacLayout.of(line + "\n" for line in lines)
    return layout.schema, [layout.row(line) for line in lines if _is_row(line)]


# --- VOTable ---

_VO_TYPES = {"short": LongType, "int": LongType, "long": LongType, "unsignedByte": LongType, "float": DoubleType, "double": DoubleType, "boolean": BooleanType}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _vo_value(cell: str | None, kind: type):
    if cell is None or not cell.strip() and kind is not StringType or cell == "":
        return None
    if kind is LongType:
        return int(cell, 0)
    if kind is DoubleType:
        return x if math.isfinite(x := float(cell)) else None
    return cell.strip().lower() in ("t", "true", "1") if kind is BooleanType else cell


class VotableStream:
    """The first table of a VOTable, parsed as it is read: schema, then rows(); what has gone by is let go.

    strict asks for query statuses and that all be OK; one after the table is met when the rows have been read.
    """

    def __init__(self, stream, strict: bool = False):
        self.strict, self.statuses, self.fields = strict, [], []
        self.path: list[ET.Element] = []
        self.events, self.in_table, self.ended = ET.iterparse(stream, ("start", "end")), False, False
        self.first: list | None = None
        for row in self._steps():  # up to the first row or the table's end
            self.first = row
            break
        if not self.in_table:
            raise TableError("no table")
        self.schema = StructType([StructField(n, k()) for n, k in self.fields])

    def _status(self, e: ET.Element) -> None:
        if _local(e) == "INFO" and e.get("name") == "QUERY_STATUS":
            self.statuses.append(e.get("value"))
            if e.get("value") in ("ERROR", "OVERFLOW"):
                raise TableError(f"query status {self.statuses}")

    def _steps(self) -> Iterator[list]:
        try:
            for event, e in self.events:
                name = _local(e)
                if event == "start":
                    self.path.append(e)
                    if name == "TABLE" and not self.ended:
                        self.in_table = True
                    continue
                self.path.pop()
                self._status(e)
                if self.in_table and not self.ended and name == "FIELD":
                    self.fields.append((e.get("name"), _VO_TYPES.get(e.get("datatype"), StringType) if not e.get("arraysize") else StringType))
                if self.in_table and not self.ended and name == "TR":
                    cells = [c for c in e if _local(c) == "TD"]
                    yield [_vo_value(c.text, k) for c, (_, k) in zip(cells, self.fields, strict=True)]
                if name == "TABLE":
                    self.ended = True
                if name in ("TR", "TABLE", "RESOURCE", "INFO") and self.path:
                    self.path[-1].remove(e)
        except ET.ParseError as e:
            raise TableError(f"not XML: {e}") from e
        if self.strict and (not self.statuses or any(s != "OK" for s in self.statuses)):
            raise TableError(f"query status {self.statuses}")

    def rows(self) -> Iterator[list]:
        if self.first is not None:
            yield self.first
        yield from self._steps()


def parse_votable(data: bytes, strict: bool = False) -> tuple[StructType, list[list]]:
    """Columns and rows of the first table; strict asks for query statuses and that all be OK.

    Blank cells and numbers that aren't finite are null; whole numbers of any size stay exact.
    """
    table = VotableStream(io.BytesIO(data), strict)
    return table.schema, list(table.rows())


# --- FITS ---

_FITS_CODES = {"L": ("u1", BooleanType), "B": ("u1", LongType), "I": (">i2", LongType), "J": (">i4", LongType), "K": (">i8", LongType), "E": (">f4", DoubleType), "D": (">f8", DoubleType)}
_BLOCK = 2880
#: What a float column holds for null where the header says so (NULLNAN): a NaN with a load of its own.
NULL_NAN = np.uint64(0x7FF8_0000_4E55_4C4C)


def _header(stream, at: int) -> tuple[dict[str, object], int]:
    """The cards of the header that begins at a byte of a stream, and where it ends."""
    cards: dict[str, object] = {}
    stream.seek(at)
    while True:
        block = stream.read(_BLOCK).decode("ascii", "replace")
        if len(block) < _BLOCK:
            raise TableError("header without end")
        at += _BLOCK
        for i in range(0, _BLOCK, 80):
            card = block[i : i + 80]
            if card.startswith("END") and not card[3:].strip():
                return cards, at
            if card[8:10] == "= ":
                raw = card[10:].strip()
                if raw.startswith("'"):
                    cards[card[:8].strip()] = re.match(r"'((?:[^']|'')*)'", raw)[1].replace("''", "'").rstrip()
                else:
                    raw = raw.partition("/")[0].strip()
                    cards[card[:8].strip()] = raw == "T" if raw in ("T", "F") else int(raw) if re.fullmatch(r"[+-]?\d+", raw) else float(raw.replace("D", "E")) if raw else None


def unescaped(text: str) -> str | None:
    """A text as write_fits escapes it: \\N for null, \\u and four digits for what isn't plain ASCII."""
    return None if text == "\\N" else re.sub(r"\\u([0-9a-f]{4})|\\(\\)", lambda m: chr(int(m[1], 16)) if m[1] else "\\", text).encode("utf-16", "surrogatepass").decode("utf-16")


@dataclass
class FitsLayout:
    """The first binary table of a file, from its headers alone: columns, rows and where they begin."""

    cards: dict[str, object]
    table: dict[str, object]
    names: list[str]
    formats: list[str]
    repeats: list[int]
    kinds: list[DataType] = field(default_factory=list)
    at: int = 0

    @classmethod
    def of(cls, stream) -> FitsLayout:
        stream.seek(0, 2)
        end = stream.tell()
        primary, at = _header(stream, 0)
        table = primary
        while table.get("XTENSION") != "BINTABLE":  # other extensions are passed over
            sizes = [int(table.get(f"NAXIS{i}", 0)) for i in range(1, int(table.get("NAXIS", 0)) + 1)]
            size = (math.prod(sizes) + int(table.get("PCOUNT", 0))) * abs(int(table.get("BITPIX", 8))) // 8 if sizes else 0
            at += -(-size // _BLOCK) * _BLOCK
            if at >= end:
                raise TableError("no binary table")
            table, at = _header(stream, at)
        found = cls({**table, **primary} if table is not primary else primary, table, [], [], [], [], at)
        for i in range(1, int(table["TFIELDS"]) + 1):
            repeat, code = re.match(r"(\d*)([A-Z])", str(table[f"TFORM{i}"])).groups()
            n = int(repeat or 1)
            if code != "A" and code not in _FITS_CODES:
                raise TableError(f"column format {repeat}{code} is not read")
            plain = StringType if code == "A" else _FITS_CODES[code][1]
            if plain is LongType and (table.get(f"TSCAL{i}") or table.get(f"TZERO{i}")) and not found.whole(i):
                plain = DoubleType
            found.formats.append(f"S{n}" if code == "A" else _FITS_CODES[code][0])
            found.repeats.append(1 if code == "A" else n)
            found.kinds.append(plain() if code == "A" or n == 1 else ArrayType(plain()))
            found.names.append(str(table.get(f"TTYPE{i}", f"col{i}")))
        return found

    def whole(self, i: int) -> bool:
        """Whether a scaled column of whole numbers stays one."""
        return float(self.table.get(f"TSCAL{i}") or 1) == 1 and float(self.table.get(f"TZERO{i}") or 0).is_integer()

    @property
    def rows(self) -> int:
        return int(self.table["NAXIS2"])

    @property
    def row_bytes(self) -> int:
        return int(self.table["NAXIS1"])

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, k) for n, k in zip(self.names, self.kinds, strict=True)])

    @cached_property
    def dtype(self) -> np.dtype:
        shapes = [(f, (n,)) if n != 1 else f for f, n in zip(self.formats, self.repeats, strict=True)]
        offsets = np.cumsum([0, *(np.dtype(x).itemsize for x in shapes)])[:-1].tolist()
        return np.dtype({"names": [f"c{i}" for i in range(len(shapes))], "formats": shapes, "offsets": offsets, "itemsize": self.row_bytes})

    def values(self, rows: np.ndarray, k: int, keep: bool = False) -> pa.Array:
        """Column k of raw rows; null for the null mark and, unless keep, for numbers that aren't finite."""
        x, i, kind = rows[f"c{k}"], k + 1, self.kinds[k]
        flat, inner = x.reshape(-1), kind.elementType if isinstance(kind, ArrayType) else kind
        null, scale, zero = (self.table.get(f"{c}{i}") for c in ("TNULL", "TSCAL", "TZERO"))
        if isinstance(inner, StringType):
            texts = [v.decode("ascii", "replace").rstrip() for v in flat.tolist()]
            out = pa.array(map(unescaped, texts) if self.table.get(f"TESC{i}") else texts, pa.string())
        elif isinstance(inner, BooleanType):
            out = pa.array(flat == ord("T"), mask=flat == 0)
        elif self.formats[k] in ("u1", ">i2", ">i4", ">i8"):
            mask = flat == null if null is not None else np.zeros(len(flat), bool)
            told = flat.astype(np.int64)
            if isinstance(inner, LongType):
                told = told + int(zero or 0)
            elif zero is not None or scale is not None:
                told = told * float(scale or 1) + float(zero or 0)
            out = pa.array(told, mask=mask)
        else:
            told = flat.astype(np.float64)
            mask = flat.astype(">f8").view(">u8") == NULL_NAN if keep and self.table.get("NULLNAN") else ~np.isfinite(told) & (not keep)
            if scale is not None or zero is not None:
                told = told * float(scale or 1) + float(zero or 0)
            out = pa.array(told, mask=mask)
        return out if not isinstance(kind, ArrayType) else pa.FixedSizeListArray.from_arrays(out, self.repeats[k]).cast(pa.list_(out.type))

    def read(self, stream, begin: int, end: int) -> np.ndarray:
        stream.seek(self.at + begin * self.row_bytes)
        data = stream.read((end - begin) * self.row_bytes)
        if len(data) < (end - begin) * self.row_bytes:
            raise TableError("the table ends before its last row")
        return np.frombuffer(data, self.dtype)


def parse_fits(data: bytes) -> tuple[dict[str, object], StructType, list[list]]:
    """Headers, columns, and values by column of the first binary table (S16); NaN as null."""
    stream = io.BytesIO(data)
    layout = FitsLayout.of(stream)
    rows = layout.read(stream, 0, layout.rows)
    return layout.cards, layout.schema, [layout.values(rows, k).to_pylist() for k in range(len(layout.names))]


ALLOWED_FLUX = ("PDCSAP_FLUX", "SAP_FLUX")
OBSERVATION = (
    "observation_id string, object_id string, title string, modality string, ra double, dec double, axis array<double>, `values` array<double>, uncertainties array<double>, quality array<long>, "
    "instrument string, band string, observed_at string, source_url string, time_reference double, file string"
)


def light_curve(data: bytes, flux: str = "PDCSAP_FLUX", name: str = "", uri: str = "", version: str = "") -> dict:
    """A light-curve file as an observation (S16, U6, C28): identity from its headers, samples that aren't numbers as null."""
    flux = flux.upper()
    if flux not in ALLOWED_FLUX:
        raise TableError(f"flux must be one of {ALLOWED_FLUX}")
    primary, schema, columns = parse_fits(data)
    by_name = {n.upper(): c for n, c in zip(schema.names, columns, strict=True)}
    lacking = {"TIME", flux, flux + "_ERR", "QUALITY"} - by_name.keys()
    if lacking:
        raise TableError(f"columns {sorted(lacking)} are lacking")
    ra, dec = primary.get("RA_OBJ"), primary.get("DEC_OBJ")
    if ra is None or dec is None:
        raise TableError("the headers have no position")
    if not by_name["TIME"]:
        raise TableError("no samples")
    tic, sector = primary.get("TICID") or primary.get("OBJECT") or name, primary.get("SECTOR") or "unknown"
    key = f"product-{hashlib.sha256(f'{uri}\0{version}'.encode()).hexdigest()[:16]}-" if uri else ""
    reference = primary.get("BJDREFI"), primary.get("BJDREFF")
    return {
        "observation_id": f"tess-{key}sector-{sector}-tic-{tic}-{flux.lower()}", "object_id": f"TIC {tic}", "title": f"TIC {tic}, TESS sector {sector} ({flux})", "modality": "light_curve",
        "ra": float(ra), "dec": float(dec), "axis": by_name["TIME"], "values": by_name[flux], "uncertainties": by_name[flux + "_ERR"], "quality": by_name["QUALITY"],
        "instrument": "TESS", "band": "TESS", "observed_at": primary.get("DATE-OBS"), "source_url": uri, "time_reference": None if reference == (None, None) else float(reference[0] or 0) + float(reference[1] or 0), "file": name,
    }


def light_curves(spark, path: str, flux: str = "PDCSAP_FLUX"):
    """Observations of the FITS files under path, and the files that aren't light curves with the reason (S16, ST7)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    told, error = light_curve(data.as_py(), flux, file.rsplit("/", 1)[-1]), None
                except TableError as e:
                    told, error = {"file": file.rsplit("/", 1)[-1]}, str(e)
                names = [f.strip("` ").split("` ")[0].split(" ")[0] for f in OBSERVATION.split(", ")]
                kinds = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
                types = [kinds[f.rsplit(" ", 1)[1]] for f in OBSERVATION.split(", ")]
                yield pa.RecordBatch.from_arrays([*(pa.array([told.get(n)], k) for n, k in zip(names, types, strict=True)), pa.array([error], pa.string())], [*names, "error"])

    rows = files.mapInArrow(parse, f"{OBSERVATION}, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("file", "error")


_PLAIN = re.compile(r"[ -\[\]-~]*[!-\[\]-~]|")


def escaped(text: str | None) -> str:
    r"""text in plain ASCII without a blank at its end: \N for null, \\ for a backslash, \u and four digits of UTF-16 for the rest."""
    if text is None:
        return "\\N"
    units = np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()
    end = len(text.rstrip(" ").encode("utf-16-le")) // 2
    return "".join("\\\\" if u == 92 else chr(u) if 32 < u < 127 or u == 32 and i < end else f"\\u{u:04x}" for i, u in enumerate(units))


def _card(k: str, v: object) -> bytes:
    told = "'" + f"{v:<8}".replace("'", "''") + "'" if isinstance(v, str) else ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"{v!r:>20}"
    return f"{k:<8}= {told}".ljust(80).encode()


def _cards(cards: list[tuple[str, object]]) -> bytes:
    raw = b"".join(_card(*c) for c in cards) + b"END".ljust(80)
    return raw + b" " * (-len(raw) % _BLOCK)


#: Rows of a part that are encoded at a time.
PIECE_ROWS = 50_000


def fits_pieces(table: pa.Table, header: dict[str, object] | None = None) -> Iterator[bytes]:
    """A binary table of whole numbers (K), numbers (D), truth values (L) and texts (A) as a file's bytes, some rows at a time (K5).

    Nulls are TNULL, a number that the column doesn't hold, a NaN with a load of its own (NULLNAN), a zero byte
    and, with other texts that aren't plain ASCII, escaped (TESC). Besides the table itself one piece is held.
    """
    if bad := [n for n in table.column_names if not re.fullmatch(r"[ -~]{1,60}", n)]:
        raise TableError(f"column names {bad} can't be written")
    pieces = [table.slice(at, PIECE_ROWS) for at in range(0, table.num_rows, PIECE_ROWS)]
    encoders, kinds, cards = [], [], []
    for i, name in enumerate(table.column_names, 1):
        form, kind, encode, more = _fits_column([p.column(i - 1) for p in pieces], table.schema.field(i - 1).type, i)
        encoders.append(encode)
        kinds.append((f"c{i - 1}", kind))
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form), *more]
    dtype = np.dtype(kinds)
    yield _cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *(header or {}).items()])
    yield _cards([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", dtype.itemsize), ("NAXIS2", table.num_rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(kinds)), ("NULLNAN", True), *cards])
    for p in pieces:
        rows = np.zeros(p.num_rows, dtype)
        for i, encode in enumerate(encoders):
            rows[f"c{i}"] = encode(p.column(i))
        yield rows.tobytes()
    yield b"\0" * (-table.num_rows * dtype.itemsize % _BLOCK)


def _fits_column(pieces: list[pa.ChunkedArray], kind: pa.DataType, i: int) -> tuple[str, np.dtype, Callable[[pa.ChunkedArray], np.ndarray], list[tuple[str, object]]]:
    """The format of column i, its NumPy type, what makes values of a piece of it, and cards."""
    empty = lambda c: c.is_null().to_numpy()
    if pa.types.is_boolean(kind):
        return "1L", np.dtype("u1"), lambda c: np.where(empty(c), 0, np.where(c.fill_null(False).to_numpy(), ord("T"), ord("F"))), []
    if pa.types.is_integer(kind):
        if not any(c.null_count for c in pieces):
            return "1K", np.dtype(">i8"), lambda c: c.to_numpy(), []
        mark = _unheld(pieces)
        return "1K", np.dtype(">i8"), lambda c: np.where(empty(c), mark, c.fill_null(0).to_numpy().astype(np.int64)), [(f"TNULL{i}", mark)]
    if pa.types.is_floating(kind):
        bits = lambda c: c.cast(pa.float64()).fill_null(0.0).to_numpy().view("u8")
        return "1D", np.dtype(">f8"), lambda c: np.where(empty(c), NULL_NAN, bits(c)).astype(">u8").view(">f8"), []
    escapes = any(t is None or not _PLAIN.fullmatch(t) for c in pieces for t in c.cast(pa.string()).unique().to_pylist())
    told = lambda t: (escaped(t) if escapes else t).encode("ascii")
    width = max((len(told(t)) for c in pieces for t in c.cast(pa.string()).unique().to_pylist()), default=0) or 1

    def texts(c: pa.ChunkedArray) -> np.ndarray:
        coded = c.cast(pa.string()).combine_chunks().dictionary_encode("encode")
        return np.array([told(t) for t in coded.dictionary.to_pylist()], f"S{width}")[coded.indices.to_numpy()]

    return f"{width}A", np.dtype(f"S{width}"), texts, [(f"TESC{i}", True)] if escapes else []


def _unheld(pieces: list[pa.ChunkedArray]) -> int:
    """The least number of 64 bits that a column with nulls doesn't hold, nulls counting as 0."""
    low, rows = -(1 << 63), sum(map(len, pieces))
    held: set[int] = set()
    for c in pieces:  # of so many rows one number of the least ones is free
        x = c.drop_null().to_numpy().astype(np.int64)
        held |= set(x[x <= low + rows].tolist())
    while low in held:
        low += 1
    return low


def fits_bytes(table: pa.Table, header: dict[str, object] | None = None) -> bytes:
    """fits_pieces as one text of bytes."""
    return b"".join(fits_pieces(table, header))


def write_fits(names: list[str], columns: list[np.ndarray], header: dict[str, object] | None = None) -> bytes:
    """fits_bytes of NumPy columns."""
    return fits_bytes(pa.table([pa.array(np.asarray(c)) for c in columns], names), header)


# --- the data sources ---

#: Rows, and bytes of a FITS file, that go to Spark at a time; bytes of a file from which it is several tasks, unless option splitBytes names others.
BATCH_ROWS, BATCH_BYTES, SPLIT_BYTES = 50_000, 8 << 20, 32 << 20
_ARROW = {LongType: pa.int64(), DoubleType: pa.float64(), BooleanType: pa.bool_(), StringType: pa.string()}
_COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def _arrow(kind: DataType) -> pa.DataType:
    return pa.list_(_ARROW[type(kind.elementType)]) if isinstance(kind, ArrayType) else _ARROW[type(kind)]


class _Reader(DataSourceReader):
    """Partitions are (file, begin, end) in a format's own measure; end is None for the whole file."""

    def __init__(self, source: _Tables, schema: StructType):
        self.source, self.schema = source, schema
        self.path, self.split = source.options["path"], int(source.options.get("splitBytes", SPLIT_BYTES))
        self.conditions: list[tuple[str, object, float]] = []

    def partitions(self) -> list[InputPartition]:
        """Files as they are, large ones by what the format splits them into."""
        found = []
        for file, size in files_of(self.path):
            found += [InputPartition((file, 0, None))] if size <= self.split else [InputPartition((file, *x)) for x in self.source.ranges(file, size, self.split)]
        return found

    def pushFilters(self, filters: list) -> Iterable:
        """Comparisons with numbers are made on raw values, where the format can; Spark makes all of them again."""
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
                self.conditions.append((f.attribute[0], _COMPARED[type(f)], f.value))
            yield f

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for columns, n in self.source.batches(*partition.value, self.schema.names, self.conditions):
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(_arrow(f.dataType)) if f.name in columns else pa.nulls(n, _arrow(f.dataType)) for f in self.schema], self.schema.names)


class _Tables(DataSource):
    def header(self, file: str) -> StructType:
        """The columns of a file, without reading its rows."""
        raise NotImplementedError

    def ranges(self, file: str, size: int, split: int) -> list[tuple[int, int | None]]:
        return [(0, None)]

    def batches(self, file: str, begin: int, end: int | None, names: list[str], conditions: list) -> Iterator[tuple[dict[str, pa.Array], int]]:
        """Columns of these names, as far as the file has them, and rows of each batch of a range."""
        raise NotImplementedError

    def open(self, file: str):
        return filesystem(self.options["path"])[0].open_input_file(file)

    def schema(self) -> StructType:
        """The columns of all files (of the first with option merge false); a column of several types is double if they are numbers, else an error."""
        files = files_of(self.options["path"])
        if not files:
            raise TableError("no files")
        found: dict[str, StructField] = {}
        for file, _ in files if self.options.get("merge", "true") == "true" else files[:1]:
            for f in self.header(file):
                old = found.setdefault(f.name, f)
                if old.dataType != f.dataType:
                    if {type(old.dataType), type(f.dataType)} != {LongType, DoubleType}:
                        raise TableError(f"column {f.name} of {file} has another type than before")
                    found[f.name] = StructField(f.name, DoubleType())
        return StructType(list(found.values()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)


def _by_column(rows: list[list], names: list[str], kinds: list[DataType]) -> tuple[dict[str, pa.Array], int]:
    return {n: pa.array([r[i] for r in rows], _arrow(k)) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}, len(rows)


class IpacSource(_Tables):
    """format("ipac")"""

    @classmethod
    def name(cls) -> str:
        return "ipac"

    def _layout(self, stream) -> IpacLayout:
        return IpacLayout.of(line.decode() for line in iter(stream.readline, b""))

    def header(self, file: str) -> StructType:
        with self.open(file) as f:
            return self._layout(io.BufferedReader(f)).schema

    def ranges(self, file: str, size: int, split: int) -> list[tuple[int, int | None]]:
        return [(at, min(at + split, size)) for at in range(0, size, split)]

    def batches(self, file, begin, end, names, conditions):
        """Lines that begin within the bytes."""
        with self.open(file) as f:
            stream = io.BufferedReader(f)
            layout = self._layout(stream)
            own = [i for i, n in enumerate(layout.schema.names) if n in names]
            told = [layout.schema[i].name for i in own], [layout.schema[i].dataType for i in own]
            stream.seek(max(begin, layout.at))
            if begin > layout.at:  # the line that the byte before lies in belongs to the range before
                stream.seek(begin - 1)
                stream.readline()
            rows: list[list] = []
            while (end is None or stream.tell() < end) and (line := stream.readline()):
                text = line.decode().rstrip("\r\n")
                if _is_row(text):
                    rows.append(layout.row(text, own))
                if len(rows) == BATCH_ROWS:
                    yield _by_column(rows, *told)
                    rows = []
            if rows:
                yield _by_column(rows, *told)


class VotableSource(_Tables):
    """format("votable"), option strict ("true": query statuses are asked for); a file is one task"""

    @classmethod
    def name(cls) -> str:
        return "votable"

    def header(self, file: str) -> StructType:
        with self.open(file) as f:
            return VotableStream(f).schema

    def batches(self, file, begin, end, names, conditions):
        with self.open(file) as f:
            table = VotableStream(f, self.options.get("strict", "false") == "true")
            own = [i for i, n in enumerate(table.schema.names) if n in names]
            told = [table.schema[i].name for i in own], [table.schema[i].dataType for i in own]
            rows: list[list] = []
            for row in table.rows():
                rows.append([row[i] for i in own])
                if len(rows) == BATCH_ROWS:
                    yield _by_column(rows, *told)
                    rows = []
            if rows:
                yield _by_column(rows, *told)


class FitsSource(_Tables):
    """format("fits"): the first binary table of each file; option nonfinite ("keep") leaves NaN and infinities as they are"""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def header(self, file: str) -> StructType:
        with self.open(file) as f:
            return FitsLayout.of(f).schema

    def ranges(self, file: str, size: int, split: int) -> list[tuple[int, int | None]]:
        with self.open(file) as f:
            layout = FitsLayout.of(f)
        step = max(1, split // max(1, layout.row_bytes))
        return [(at, min(at + step, layout.rows)) for at in range(0, layout.rows, step)]

    def batches(self, file, begin, end, names, conditions):
        """Rows of a range, those first that meet the conditions on plain numbers."""
        keep = self.options.get("nonfinite") == "keep"
        with self.open(file) as f:
            layout = FitsLayout.of(f)
            own = [k for k, n in enumerate(layout.names) if n in names]
            plain = {n: k for k, n in enumerate(layout.names) if isinstance(layout.kinds[k], (LongType, DoubleType)) and not any(layout.table.get(f"{c}{k + 1}") for c in ("TSCAL", "TZERO", "TNULL"))}
            end = layout.rows if end is None else end
            step = min(BATCH_ROWS, max(1, BATCH_BYTES // max(1, layout.row_bytes)))
            for at in range(begin, end, step):
                rows = layout.read(f, at, min(at + step, end))
                for name, compare, value in conditions:
                    if name in plain:
                        rows = rows[compare(rows[f"c{plain[name]}"], value)]
                if len(rows):
                    yield {layout.names[k]: layout.values(rows, k, keep) for k in own}, len(rows)


def register(spark) -> None:
    """Make the formats known to the session, and let Spark hand comparisons to Python sources."""
    from orrery.sources import sinks

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (IpacSource, VotableSource, sinks.FitsTables, sinks.Lines):
        spark.dataSource.register(source)
