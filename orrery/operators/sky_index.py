"""A table stored in the order of sky cells, so that cones read the files of their cells only.

The sky is a cube's six faces, each halved in both directions LEVEL times; a cell's number is its face and its
place on a Z-shaped curve, so a coarser cell is a range of numbers. Files hold ranges of the curve with nearly
equal numbers of rows: dense cells are several files and sparse ones share one. The manifest tells each file's
range; a cone becomes a few ranges, found by going down from the faces as long as a cell's circle meets the
cone's. Files and row groups outside of them are not read, and the exact separation decides.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions import exprs
from orrery.operators import spatial
from orrery.operators.store import cut
from orrery.sources.tables import filesystem

LEVEL = 16
#: Level of the cells that many targets' surroundings are told in (6 * 4 ** COARSE of them), and ranges of one cone at most.
COARSE, MOST_RANGES = 5, 64
ROWS_PER_FILE = 1_000_000
#: The cell of rows without a valid position.
NOWHERE = -1
# each face's axis (0 to 2), its sign, and the axes that u and v run along
_FACES = [(0, 1, 1, 2), (0, -1, 1, 2), (1, 1, 0, 2), (1, -1, 0, 2), (2, 1, 0, 1), (2, -1, 0, 1)]


def with_cell(df: DataFrame, ra: Column, dec: Column, name: str = "cell") -> DataFrame:
    """df with the number of the cell of a position at LEVEL; NOWHERE if it isn't valid.

    In steps of their own, since each value goes into the next several times.
    """
    own = lambda *names: [F.col(f"__{n}") for n in names]
    step = df.withColumns({"__r": F.radians(ra.cast("double")), "__d": F.radians(dec.cast("double")), "__ok": exprs.valid_position(ra.cast("double"), dec.cast("double"))})
    r, d = own("r", "d")
    step = step.withColumns({"__x": F.cos(d) * F.cos(r), "__y": F.cos(d) * F.sin(r), "__z": F.sin(d)})
    xyz = own("x", "y", "z")
    step = step.withColumn("__m", F.greatest(*map(F.abs, xyz)))
    face = F.lit(5)
    for k, (axis, sign, _, _) in reversed(list(enumerate(_FACES))):
        face = F.when((F.abs(xyz[axis]) >= F.col("__m")) & (xyz[axis] * sign > 0), k).otherwise(face)
    step = step.withColumn("__face", face)
    which = lambda side: F.when(F.col("__face") < 2, xyz[_FACES[0][side]]).when(F.col("__face") < 4, xyz[_FACES[2][side]]).otherwise(xyz[_FACES[4][side]])
    place = lambda side: F.least(F.floor((which(side) / F.col("__m") + 1) / 2 * (1 << LEVEL)), F.lit((1 << LEVEL) - 1).cast("long"))
    step = step.withColumns({"__i": place(2), "__j": place(3)})
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):  # a zero between any two bits
        apart = lambda c: c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))  # noqa: B023, E731
        step = step.withColumns({"__i": apart(F.col("__i")), "__j": apart(F.col("__j"))})
    number = F.col("__i").bitwiseOR(F.shiftleft("__j", 1)) + F.shiftleft(F.col("__face").cast("long"), 2 * LEVEL)
    step = step.withColumn(name, F.when(F.col("__ok"), number).otherwise(F.lit(NOWHERE).cast("long")))
    return step.select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != name), name)


def _corners(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of cells as unit vectors, and the angles of the circles around them that hold the cells."""

    def toward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(face), 3))
        for k, (axis, sign, u, v) in enumerate(_FACES):
            own = face == k
            out[own, axis], out[own, u], out[own, v] = sign, a[own] / (1 << level) * 2 - 1, b[own] / (1 << level) * 2 - 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    middle = toward(i + 0.5, j + 0.5)
    widest = np.max([np.arccos(np.clip((middle * toward(i + a, j + b)).sum(axis=1), -1, 1)) for a in (0, 1) for b in (0, 1)], axis=0)
    return middle, widest


def _interleaved(i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for b in range(level):
        out |= (i >> b & 1) << 2 * b | (j >> b & 1) << 2 * b + 1
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (from, to, end exclusive) in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cover(ra: float, dec: float, radius_arcsec: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of cell numbers that hold every position within the radius, most of them at most."""
    r, d, reach = math.radians(ra), math.radians(dec), math.radians(min(radius_arcsec / 3600, 180.0)) + 1e-9
    target = np.array([math.cos(d) * math.cos(r), math.cos(d) * math.sin(r), math.sin(d)])
    face, i, j, found = np.arange(6), np.zeros(6, np.int64), np.zeros(6, np.int64), []
    for level in range(LEVEL + 1):
        middle, widest = _corners(face, i, j, level)
        near = np.arccos(np.clip(middle @ target, -1, 1)) <= np.minimum(reach + widest + 1e-9, math.pi)
        face, i, j = face[near], i[near], j[near]
        width = 2 * (LEVEL - level)
        first = (face.astype(np.int64) << 2 * LEVEL) + (_interleaved(i, j, level) << width)
        now = merged([(a, a + (1 << width)) for a in first.tolist()])
        if found and len(now) > most:
            break
        found = now
        if widest.max(initial=0) < reach / 4:
            break
        face, i, j = np.repeat(face, 4), np.repeat(i * 2, 4) + np.tile([0, 1, 0, 1], len(i)), np.repeat(j * 2, 4) + np.tile([0, 0, 1, 1], len(j))
    return found


def around(targets: DataFrame, radius_arcsec: float, target_pos=("t_ra", "t_dec")) -> list[tuple[int, int]]:
    """Ranges that hold all positions within the radius of any target: coarse cells, found by the tasks that hold the targets."""
    side = 1 << COARSE
    face, i, j = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(side), np.arange(side), indexing="ij"))
    middle, widest = _corners(face, i, j, COARSE)
    number = face.astype(np.int64) * side * side + _interleaved(i, j, COARSE)
    bar = np.cos(np.minimum(widest + math.radians(min(radius_arcsec / 3600, 180.0)) + 1e-9, math.pi))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(len(number), bool)
        for b in batches:
            r, d = (np.radians(b.column(c).to_numpy().astype(np.float64)) for c in range(2))
            xyz = np.stack([np.cos(d) * np.cos(r), np.cos(d) * np.sin(r), np.sin(d)], axis=1)
            for at in range(0, len(xyz), 1024):
                hit |= (xyz[at : at + 1024] @ middle.T >= bar - 1e-12).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(number[hit])], ["cell"])

    placed = targets.where(exprs.valid_position(F.col(target_pos[0]), F.col(target_pos[1]))).select(*(F.col(c).cast("double").alias(n) for c, n in zip(target_pos, ("ra", "dec"), strict=True)))
    width = 2 * (LEVEL - COARSE)
    cells = placed.mapInArrow(reached, "cell long").distinct().collect()  # the coarse cells of the whole sky at most
    return merged([(r["cell"] << width, r["cell"] + 1 << width) for r in cells])


@dataclass(frozen=True)
class File:
    path: str
    first: int
    last: int
    rows: int


class SkyIndex:
    """A table with a column cell under path, in files by ranges of cells that its manifest tells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            told = json.loads(f.read())
        self.schema, self.position = StructType.fromJson(told["schema"]), tuple(told["position"])
        self.files = [File(*f) for f in told["files"]]

    @classmethod
    def write(cls, df: DataFrame, path: str, position=("ra", "dec"), rows_per_file: int = ROWS_PER_FILE) -> SkyIndex:
        """Store df; a manifest that is there is replaced at the end, by a rename.

        Rows without a valid position are stored too and never found. A cell with many rows, be they at one
        place, is as many files as its rows fill.
        """
        spark, data = df.sparkSession, f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
        placed = cut(with_cell(df, F.col(position[0]), F.col(position[1])), "placed")
        parts = max(1, -(-placed.count() // rows_per_file))
        salted = placed.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
        salted.repartitionByRange(parts, "cell", "__salt").sortWithinPartitions("cell").drop("__salt").write.parquet(data)
        held = spark.read.schema(placed.schema).parquet(data).groupBy(F.input_file_name().alias("path")).agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.count("*").alias("rows"))
        files = sorted((tuple(r) for r in held.collect()), key=lambda f: f[1:])  # one row a file
        fs, root = filesystem(path.rstrip("/"))
        with fs.open_output_stream(f"{root}/.manifest.json") as f:
            f.write(json.dumps({"schema": placed.schema.jsonValue(), "position": list(position), "files": files}).encode())
        fs.move(f"{root}/.manifest.json", f"{root}/manifest.json")
        return cls(spark, path)

    def files_of(self, ranges: list[tuple[int, int]]) -> list[str]:
        """The files that may hold a cell of ranges, which are in order and apart."""
        ends = [b for _, b in ranges]
        found = []
        for f in self.files:
            k = int(np.searchsorted(ends, f.first, "right"))
            if k < len(ranges) and ranges[k][0] <= f.last:
                found.append(f.path)
        return found

    def read(self, ranges: list[tuple[int, int]], conditions: int = MOST_RANGES) -> DataFrame:
        """Rows of files with cells of ranges; up to so many ranges are conditions that reach Parquet's row groups."""
        paths = self.files_of(ranges)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if len(ranges) > conditions:
            return rows.where(F.col("cell") >= 0)
        wanted = F.lit(False)
        for a, b in ranges:
            wanted = wanted | ((F.col("cell") >= a) & (F.col("cell") < b))
        return rows.where(wanted)

    def cone(self, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
        """Rows within the radius of a position, with their separation."""
        rows = self.read(cover(ra, dec, radius_arcsec))
        return rows.withColumn("separation", exprs.angular_separation(F.lit(ra), F.lit(dec), *map(F.col, self.position))).where(F.col("separation") <= radius_arcsec).drop("cell")

    def join(self, targets: DataFrame, radius_arcsec: float, target_pos=("t_ra", "t_dec")) -> DataFrame:
        """spatial.cone_join of targets with the table, which is read as far as the targets' surroundings reach."""
        rows = self.read(around(targets, radius_arcsec, target_pos)).drop("cell")
        return spatial.cone_join(targets, rows, radius_arcsec, target_pos, self.position)
