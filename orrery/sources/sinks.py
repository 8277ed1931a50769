"""Sinks that write parts of bounded bytes, in two phases: FITS tables, and lines of text.

A task writes its parts to a folder of the run and closes each once the next row would take it beyond
partBytes or partRows; the commit moves the parts of the attempts that count to their final names, lists them, and takes
the folder away with whatever attempts that failed have left.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from orrery.sources import tables

PART_BYTES = 64 << 20
#: Files that are renamed at a time.
RENAMES = 16


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class PartWriter(DataSourceArrowWriter):
    """Writes what encoded() makes of a task's batches, part by part."""

    suffix = ""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.part_bytes, self.part_rows = int(options.get("partBytes", PART_BYTES)), int(options.get("partRows", 1 << 60))
        self.run = uuid.uuid4().hex

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Iterable[bytes], int]]:
        """The bytes, in pieces, and rows of each part."""
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        fs, root = tables.filesystem(self.path)
        folder = f"{root}/.writing-{self.run}"
        fs.create_dir(folder, recursive=True)
        parts = []
        for k, (pieces, rows) in enumerate(self.encoded(batches)):
            name = f"part-{task.partitionId():05d}-{k:05d}-{self.run[:12]}{self.suffix}"
            temporary = f"{folder}/{name}.{task.taskAttemptId()}"
            size, sha = 0, hashlib.sha256()
            with fs.open_output_stream(temporary, compression=None) as f:
                for piece in pieces:
                    f.write(piece)
                    size += len(piece)
                    sha.update(piece)
            parts.append({"name": name, "temporary": temporary, "rows": rows, "bytes": size, "sha256": sha.hexdigest()})
        return Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = tables.filesystem(self.path)
        fs.create_dir(f"{root}/.writing-{self.run}", recursive=True)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["name"])
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda p: fs.move(p.pop("temporary"), f"{root}/{p['name']}"), parts))
        with fs.open_output_stream(f"{root}/_parts-{self.run}.json") as f:
            f.write(json.dumps(parts).encode())
        fs.delete_dir(f"{root}/.writing-{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = tables.filesystem(self.path)
        try:
            fs.delete_dir(f"{root}/.writing-{self.run}")
        except FileNotFoundError:
            pass  # no task had begun


def parts_of(path: str) -> list[dict]:
    """name, rows, bytes and sha256 of the parts that writers have put under path."""
    fs, root = tables.filesystem(path)
    from pyarrow.fs import FileSelector

    found = []
    for info in fs.get_file_info(FileSelector(root)):
        if info.base_name.startswith("_parts-"):
            with fs.open_input_stream(info.path) as f:
                found += json.loads(f.read())
    return sorted(found, key=lambda p: p["name"])


class _FitsWriter(PartWriter):
    suffix = ".fits"

    def encoded(self, batches):
        """A part is as wide as its widest cells, so rows are taken while rows times width stays within the bound."""
        held: list[pa.RecordBatch] = []
        rows, widest = 0, None
        for batch in batches:
            width = np.stack([self._widths(c) for c in batch.columns])
            at = 0
            while at < batch.num_rows:
                own = width[:, at:] if widest is None else np.maximum(width[:, at:], widest[:, None])
                so_far = np.maximum.accumulate(own, axis=1)
                size = (rows + np.arange(1, so_far.shape[1] + 1)) * so_far.sum(axis=0) + 4 * 2880
                n = min(int(np.searchsorted(size, self.part_bytes, "right")), self.part_rows - rows)
                if n == 0 and held:
                    yield tables.fits_pieces(pa.Table.from_batches(held)), rows
                    held, rows, widest = [], 0, None
                    continue
                n = max(n, 1)
                held.append(batch.slice(at, n))
                rows, widest, at = rows + n, so_far[:, n - 1], at + n
        if held:
            yield tables.fits_pieces(pa.Table.from_batches(held)), rows

    @staticmethod
    def _widths(c: pa.Array) -> np.ndarray:
        """Bytes of each cell; a text may be escaped, which is six bytes a character at most."""
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            return 6 * pc.utf8_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        return np.full(len(c), 1 if pa.types.is_boolean(c.type) else 8, np.int64)


class FitsTables(tables.FitsSource):
    """format("fits") to write as well: one binary table a part; columns are numbers, truth values and texts."""

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise tables.TableError("a folder of tables is not overwritten")
        return _FitsWriter(self.options)


class _LineWriter(PartWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.suffix = options.get("suffix", ".txt")
        self.head, self.between, self.foot = (options.get(k, v).encode() for k, v in (("head", ""), ("separator", "\n"), ("foot", "\n")))

    def encoded(self, batches):
        held: list[bytes] = []
        size = len(self.head) + len(self.foot)
        for batch in batches:
            for line in batch.column(0).cast(pa.large_binary()).to_pylist():
                if held and (size + len(line) + len(self.between) > self.part_bytes or len(held) >= self.part_rows):
                    yield (self.head + self.between.join(held) + self.foot,), len(held)
                    held, size = [], len(self.head) + len(self.foot)
                held.append(line)
                size += len(line) + len(self.between)
        if held:
            yield (self.head + self.between.join(held) + self.foot,), len(held)


class Lines(DataSource):
    """format("orrery_lines"), to write one column of texts: options head, separator, foot (of each part), suffix, partBytes and partRows."""

    @classmethod
    def name(cls) -> str:
        return "orrery_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise tables.TableError("a folder of lines is not overwritten")
        return _LineWriter(self.options)
