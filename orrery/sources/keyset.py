"""Keyset scans: a table by pages in the order of a key, each beginning after the key that the one before ended with.

page() is one page of a DataFrame. As a stream, format("keyset") gives a Parquet table page by page; its offset is
the cursor, so a query that is stopped goes on after the last page that its checkpoint holds. A cursor that has
not moved for a day is forgotten and the scan begins anew.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from orrery.sources import tables

#: Keys of a page, and seconds that a cursor holds.
LIMIT, HOLDS = 1000, 86_400


def page(df: DataFrame, key: str, cursor: int | str | None = None, limit: int = LIMIT) -> DataFrame:
    """The first limit rows of df whose key comes after cursor, in its order; all rows without one. Null keys are in no page."""
    rows = df.where(F.col(key).isNotNull() if cursor is None else F.col(key) > cursor)
    return rows.orderBy(key).limit(limit)


def next_cursor(rows: DataFrame, key: str, limit: int = LIMIT) -> int | str | None:
    """Where the page after these rows begins; None if they are the last."""
    n, last = rows.agg(F.count("*"), F.max(key)).first()
    return last if n >= limit else None


class KeysetReader(SimpleDataSourceStreamReader):
    """Offsets are cursor (as a text, None at the beginning), exhausted (the last page was not full) and at, when it was reached.

    A page is read by the driver, which holds its rows and one batch; filters on the key reach Parquet's row groups.
    Rows that share a page's last key are all in it.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.key = options["path"], options["key"]
        self.limit, self.holds = int(options.get("limit", LIMIT)), float(options.get("holds", HOLDS))
        self.schema = schema

    def _table(self):
        import pyarrow.dataset as dataset

        fs, _ = tables.filesystem(self.path)
        return dataset.dataset([f for f, _ in tables.files_of(self.path)], format="parquet", filesystem=fs)

    def _value(self, cursor: str) -> int | str:
        return int(cursor) if pa.types.is_integer(self._table().schema.field(self.key).type) else cursor

    def _rows(self, after: str | None, upto: object = None) -> pa.Table:
        """Rows of the keys after a cursor, the first limit of them or those up to a key, in order."""
        key = pc.field(self.key)
        wanted = key.is_valid() if after is None else key > self._value(after)
        if upto is not None:
            wanted = wanted & (key <= upto)
        held = None
        for batch in self._table().scanner(columns=self.schema.names, filter=wanted, batch_size=self.limit).to_batches():
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if upto is None and held.num_rows > 4 * self.limit:
                held = held.sort_by(self.key).slice(0, self.limit)
        if held is None:
            return pa.table({})
        held = held.sort_by(self.key)
        return held if upto is not None else held.slice(0, self.limit)

    def _given(self, rows: pa.Table) -> Iterator[tuple]:
        rows = rows.cast(to_arrow_schema(self.schema)) if rows.num_rows else rows
        return iter([tuple(r.values()) for r in rows.to_pylist()])

    def initialOffset(self) -> dict:
        return {"cursor": None, "exhausted": False, "at": time.time()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["cursor"] is not None and time.time() - start["at"] > self.holds:
            start = self.initialOffset()
        rows = self._rows(start["cursor"])
        if not rows.num_rows:
            return iter([]), start
        full, last = rows.num_rows >= self.limit, rows.column(self.key)[-1].as_py()
        if full:
            rows = self._rows(start["cursor"], last)  # with all rows of the last key
        return self._given(rows), {"cursor": str(last), "exhausted": not full, "at": time.time()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        after = start["cursor"]
        if after is not None and end["cursor"] is not None and self._value(after) >= self._value(end["cursor"]):
            after = None  # the scan began anew in between
        return self._given(self._rows(after, self._value(end["cursor"]))) if end["cursor"] is not None else iter([])


class Keyset(DataSource):
    """format("keyset"), to be read as a stream: options path (a Parquet table), key (whole numbers or texts), limit and holds (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> StructType:
        return from_arrow_schema(KeysetReader(self.options, StructType())._table().schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return KeysetReader(self.options, schema)
