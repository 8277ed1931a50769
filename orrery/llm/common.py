"""Shared helpers of the corpus operators: shared storage, lineage cuts, components, text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="orrery-")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def named(column: str) -> Column:
    """A column by its whole name, dots and marks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time, and rows that a Parquet reader holds: rows with whole texts, sets or ids are large.
BATCH_BYTES, READ_ROWS = 4 << 20, 512


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches and on Parquet readers' rows, so that workers and JVMs hold little at a time."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


#: Rows of a side that may be broadcast, after they have been counted (8 to 24 bytes each).
BROADCAST_ROWS = 500_000


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) as (node, component), component being the smallest node.

    Alternates large-star and small-star rounds, each a partial aggregate and a join, until the edges
    no longer change; nodes without an edge are absent. Nulls and self-loops are ignored.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "star",
    )
    seen = None
    while True:
        sym = now.selectExpr("hi as u", "lo as v").unionByName(now.selectExpr("lo as u", "hi as v"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(least, "u").selectExpr("v as hi", "m as lo").where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").selectExpr("lo as hi", "m as lo").unionByName(low.selectExpr("hi", "m as lo")).distinct()
        now = cut(small, "star")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    return now.selectExpr("hi as node", "lo as component").unionByName(now.selectExpr("lo as node", "lo as component").distinct())


# --- hashing of words and shingles, vectorised over an Arrow buffer ---

_U = np.uint64
_GAMMA, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _series(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _GAMMA)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = _series(256)[_FOLD]  # a random value of each byte, A-Z as a-z


def _hash_window(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each word of data, a word ending at white space or where a text starts."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = starts[starts < len(data)]
    first[at] |= solid[at]
    pos = np.flatnonzero(solid)
    head = np.flatnonzero(first)
    if not len(head):
        return np.empty(0, _U), head
    begin = np.searchsorted(pos, head)
    within = pos - np.repeat(head, np.diff(np.append(begin, len(pos))))
    value = _BYTE[data[pos]] * (_series(int(within.max()) + 1) | _U(1))[within]
    return mix(np.add.reduceat(value, begin)), head


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts, and the offset of each text's first word (one more than texts)."""
    texts = texts.cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    hashes, heads, at, end = [], [], int(bounds[0]), int(bounds[-1])
    while at < end:
        to = min(at + WINDOW, end)
        while to < end and not _SPACE[data[to]]:  # a window never cuts a word
            more = np.flatnonzero(_SPACE[data[to : to + WINDOW]])
            to = to + int(more[0]) if len(more) else min(to + WINDOW, end)
        lo, hi = np.searchsorted(bounds, [at, to])
        h, head = _hash_window(data[at:to], bounds[lo:hi] - at)
        hashes.append(h)
        heads.append(head + at)
        at = to
    if not hashes:
        return np.empty(0, _U), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(heads), bounds)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; one of the whole text if it has fewer words, none if it has none."""
    h, at = word_hashes(texts)
    full = h.copy()
    for j in range(1, words):
        full = mix(full[: max(0, len(h) - j)] + _GAMMA) * _M2 + h[j:]
    full = mix(full)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n >= words:
            yield np.unique(full[lo : hi - words + 1])
        elif n:
            short = _U(n)
            for x in h[lo:hi]:
                short = mix((np.array([short]) + _GAMMA) * _M1 + x)[0]
            yield np.array([short], _U)
        else:
            yield np.empty(0, _U)


def text_batches(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most most_bytes of text, or one row."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df with a column place, a number that rises in the order of these columns (nulls first) and differs for every row.

    Rows go to tasks by ranges; rows that are equal in these columns are told apart by a hash of where they
    were read, so even a third of all rows with equal values spread over tasks. Written once, so that places
    are the same whoever reads them.
    """
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    return cut(ranged.withColumn("place", F.monotonically_increasing_id()), "ordered")


def numbered(placed: DataFrame, group: str) -> DataFrame:
    """Rows of in_order, group being its first column, with pos (from 0 within the group) and n (the group's rows).

    A task's rows of a group are counted, and the counts summed over the tasks before: a group has at most one
    count a task, and no group meets in one task.
    """
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(group, task.alias("__task")).agg(F.min(row).alias("__first"), F.count("*").alias("__n"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(by.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = cut(counts.select(F.col(group).alias("__group"), "__task", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(by).alias("n")), "counts")
    same = F.col(group).eqNullSafe(F.col("__group")) & (task == F.col("__task"))
    return placed.join(small_or_not(told), same).withColumn("pos", row + F.col("__shift")).drop("__group", "__task", "__shift")
