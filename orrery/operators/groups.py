"""Components of targets' detections by the places around them: references go to where targets are, no pair is shuffled or written.

Targets fall into cubes of the sky; the sources in reach of a cube go to the tasks that hold its targets, some
BLOCK at a time. A task looks at one target after the other, so what it holds grows with the sources around a cube
and not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import exprs
from orrery.operators import spatial
from orrery.operators.store import cut

#: Bytes of the sources around a cube up to which one task holds them; targets of a cube that go to a task; rows that a task gives at a time.
NEAR_BYTES, BLOCK, OUT_ROWS = 64 << 20, 1024, 1 << 16
#: What separations of two ways to reckon may differ by, as a share and in arc seconds.
HAIR = 1e-9


def spots(targets: DataFrame, sources: DataFrame, radius_arcsec: float, key: str, near_bytes: int = NEAR_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by spot, block and side, sources (side 0, by key) before the targets that they are in reach of; and targets with too many sources around them.

    targets have t_ra and t_dec, sources key, ra and dec; no column but these positions may be in both.
    """
    edge = 2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) * 1.000001 + 1e-12
    at = ["cx", "cy", "cz"]
    v = cut(spatial.with_cells(targets.where(exprs.valid_position(F.col("t_ra"), F.col("t_dec"))), "t_ra", "t_dec", edge, False), "targets")
    r = cut(spatial.with_cells(sources.where(exprs.valid_position(F.col("ra"), F.col("dec"))), "ra", "dec", edge, False), "around")
    size = F.lit(64) + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0))
    own = v.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumns({"spot": F.monotonically_increasing_id(), **{f"own_{c}": F.col(c) for c in at}})
    for c in at:
        own = own.withColumn("__o", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(c, F.col(c) + F.col("__o")).drop("__o")
    reach = own.join(r.groupBy(*at).agg(F.sum(size).alias("bytes")), at)
    reach = cut(reach.withColumn("crowded", F.sum("bytes").over(Window.partitionBy("spot")) > near_bytes).drop("bytes"), "reach")
    asked = reach.select(*(F.col(f"own_{c}").alias(c) for c in at), "spot", "blocks", "crowded").distinct()
    near = r.join(reach.where("not crowded"), at).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    near = near.select("spot", "block", F.lit(0).alias("side"), *sources.columns)
    own = v.join(asked.where("not crowded"), at).withColumn("block", F.pmod(F.xxhash64("t_ra", "t_dec"), F.col("blocks"))).select("spot", "block", F.lit(1).alias("side"), *targets.columns)
    rows = spatial.spread(near.unionByName(own, allowMissingColumns=True), "spot", "block").sortWithinPartitions("spot", "block", "side", key)
    return rows, v.join(asked.where("crowded"), at, "left_semi").drop(*at)


class _Around:
    """The sources around a spot, by cells whose diagonal is within the radius of links: rows of a cell are linked."""

    def __init__(self, t: pa.Table, key: str, link_arcsec: float):
        keys = t.column(key).combine_chunks()
        changes = np.ones(len(keys), bool)
        if len(keys) > 1:  # sorted by their keys
            changes[1:] = ~pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
        node = np.cumsum(changes) - 1
        self.names, self.repeats = keys.take(pa.array(np.flatnonzero(changes))), not changes.all()
        ra, dec = np.radians(t.column("ra").to_numpy()), np.radians(t.column("dec").to_numpy())
        toward = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)
        self.link = link_arcsec
        self.chord = 2 * math.sin(math.radians(min(link_arcsec / 3600, 180.0)) / 2)
        cubes = np.floor(toward / (self.chord / math.sqrt(3) * 0.999999)).astype(np.int64)
        found, cell = np.unique(cubes, axis=0, return_inverse=True)
        order = np.argsort(cell.ravel(), kind="stable")
        self.cell, self.node = cell.ravel()[order], node[order]
        self.ra, self.dec, self.toward = t.column("ra").to_numpy()[order], t.column("dec").to_numpy()[order], toward[order]
        self.cos = np.cos(np.radians(self.dec))
        self.counts = t.column("counts").to_numpy(zero_copy_only=False)[order].astype(bool) if "counts" in t.column_names else None
        self.size = np.bincount(self.cell, minlength=len(found))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        place = {c: i for i, c in enumerate(map(tuple, found.tolist()))}
        steps = sorted((o for o in product(range(-2, 3), repeat=3) if o > (0, 0, 0)), key=lambda o: sum(x * x for x in o))
        pairs = [(i, j) for x, y, z in steps for (a, b, c), i in place.items() if (j := place.get((a + x, b + y, c + z))) is not None]
        self.pairs = np.array(pairs, np.int64).reshape(-1, 2)
        self.known: dict[tuple[int, int], bool] = {}

    def separations(self, rows: np.ndarray, ra: float, dec: float) -> np.ndarray:
        h = np.sin(np.radians(self.dec[rows] - dec) / 2) ** 2 + math.cos(math.radians(dec)) * self.cos[rows] * np.sin(np.radians(self.ra[rows] - ra) / 2) ** 2
        return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) * 3600

    def within(self, ra: float, dec: float, radius_arcsec: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        r, d = math.radians(ra), math.radians(dec)
        rows = np.flatnonzero(self.toward @ np.array([math.cos(d) * math.cos(r), math.cos(d) * math.sin(r), math.sin(d)]) >= least)
        apart = self.separations(rows, ra, dec)
        return rows[apart <= radius_arcsec], apart[apart <= radius_arcsec]

    def _near(self, a: np.ndarray, b: np.ndarray) -> bool:
        d = self.toward[a[0]] - self.toward[b[0]]
        if d @ d < self.chord**2 * (1 - 1e-6):
            return True
        for i, j in product(range(0, len(a), spatial.BLOCK), range(0, len(b), spatial.BLOCK)):
            p, q = a[i : i + spatial.BLOCK, None], b[None, j : j + spatial.BLOCK]
            h = np.sin(np.radians(self.dec[q] - self.dec[p]) / 2) ** 2 + self.cos[p] * self.cos[q] * np.sin(np.radians(self.ra[q] - self.ra[p]) / 2) ** 2
            if (np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) * 3600 <= self.link).any():
                return True
        return False

    def labels(self, rows: np.ndarray) -> np.ndarray:
        """A cell of the component that each of rows is in; rows rise."""
        cells = self.cell[rows]
        held = np.bincount(cells, minlength=len(self.size))
        there = held > 0
        left = int(there.sum())
        top = list(range(len(self.size)))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        def joined(x: int, y: int) -> int:
            x, y = root(x), root(y)
            top[max(x, y)] = min(x, y)
            return int(x != y)

        if self.repeats:  # a key in several cells
            order = np.argsort(self.node[rows], kind="stable")
            for k in np.flatnonzero(np.diff(self.node[rows][order]) == 0).tolist():
                left -= joined(int(cells[order[k]]), int(cells[order[k + 1]]))
        if left > 1:
            inside = np.zeros(len(self.cell), bool)
            inside[rows] = True
            own = lambda c: np.arange(self.begin[c], self.begin[c + 1])[inside[self.begin[c] : self.begin[c + 1]]]
            whole = (held == self.size).tolist()
            live = self.pairs[there[self.pairs[:, 0]] & there[self.pairs[:, 1]]]
            for i, j in live.tolist():
                if root(i) != root(j):
                    near = self.known.get((i, j)) if whole[i] and whole[j] else None
                    if near is None:
                        near = self._near(own(i), own(j))
                        if whole[i] and whole[j]:
                            self.known[i, j] = near
                    if near:
                        left -= joined(i, j)
                        if left == 1:
                            break
        if left == 1:
            return np.zeros(len(rows), np.int64)
        return np.array([root(i) if t else i for i, t in enumerate(there.tolist())], np.int64)[cells]


def _told(batches: Iterator[pa.RecordBatch], key: str, link_arcsec: float) -> Iterator[tuple[_Around, pa.Table]]:
    """For rows of spots: the sources around each block of targets, and the targets."""

    def solved(held: list[pa.RecordBatch]) -> Iterator[tuple[_Around, pa.Table]]:
        t = pa.Table.from_batches(held)
        side = t.column("side").to_numpy()
        n = int((side == 0).sum())  # sources come first
        if 0 < n < len(side):
            yield _Around(t.slice(0, n), key, link_arcsec), t.slice(n)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        spot, block = batch.column("spot").to_numpy(), batch.column("block").to_numpy()
        ends = [*(np.flatnonzero((np.diff(spot) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(spot)]
        begin = 0
        for end in ends:
            if end == begin:
                continue
            if held and (held[-1].column("spot")[0].as_py(), held[-1].column("block")[0].as_py()) != (int(spot[begin]), int(block[begin])):
                yield from solved(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield from solved(held)


def _positions(t: pa.Table) -> list[tuple[float, float]]:
    return list(zip(t.column("t_ra").to_pylist(), t.column("t_dec").to_pylist(), strict=True))


def _all(batches: Iterator[pa.RecordBatch], by: str, key: str, radius_arcsec: float, link_arcsec: float) -> Iterator[pa.RecordBatch]:
    """by, key and root of each target's sources."""
    least = math.cos(math.radians(min(radius_arcsec / 3600, 180.0))) - 1e-13
    for around, targets in _told(batches, key, link_arcsec):
        ids, owner, nodes, roots, n = targets.column(by).combine_chunks(), [], [], [], 0

        def out() -> pa.RecordBatch:
            at = pa.array(np.repeat(*map(np.array, zip(*owner, strict=True))))  # noqa: B023
            return pa.RecordBatch.from_arrays([ids.take(at), *(around.names.take(pa.array(np.concatenate(x))) for x in (nodes, roots))], [by, key, "root"])  # noqa: B023

        for k, (ra, dec) in enumerate(_positions(targets)):
            rows, _ = around.within(ra, dec, radius_arcsec, least)
            if not len(rows):
                continue
            label, node = around.labels(rows), around.node[rows]
            first = np.full(len(around.size), len(around.names))
            if label[0] == label[-1] and (label == label[0]).all():
                first[label[0]] = node.min()
            else:
                np.minimum.at(first, label, node)
            root = first[label]
            if around.repeats:
                node, at = np.unique(node, return_index=True)
                root = root[at]
            owner.append((k, len(node)))
            nodes.append(node)
            roots.append(root)
            n += len(node)
            if n >= OUT_ROWS:
                yield out()
                owner, nodes, roots, n = [], [], [], 0
        if n:
            yield out()


def cone_groups(targets: DataFrame, sources: DataFrame, radius_arcsec: float, by: str, key: str, link_arcsec: float, near_bytes: int = NEAR_BYTES) -> DataFrame:
    """spatial.close_groups of the sources within the radius of each of targets(by, t_ra, t_dec), for sources(key, ra, dec) without errors.

    Neither pairs nor detections are shuffled or written. Targets with more sources around them than near_bytes,
    or whose id repeats, go by close_groups.
    """
    v = cut(targets.select(by, "t_ra", "t_dec").withColumn("repeated", F.count("*").over(Window.partitionBy(by)) > 1), "targets")
    r = sources.select(key, F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"))
    own = v.where("not repeated").select(by, F.col("t_ra").cast("double").alias("t_ra"), F.col("t_dec").cast("double").alias("t_dec"))
    rows, crowded = spots(own, r, radius_arcsec, key, near_bytes)
    kind = ", ".join(f"`{n}` {t.simpleString()}" for n, t in ((by, v.schema[by].dataType), (key, r.schema[key].dataType), ("root", r.schema[key].dataType)))
    found = rows.mapInArrow(lambda b: _all(b, by, key, radius_arcsec, link_arcsec), kind)
    rest = crowded.select(by, "t_ra", "t_dec").unionByName(v.where("repeated").drop("repeated"))
    if rest.isEmpty():
        return found
    pairs = spatial.cone_join(rest, r, radius_arcsec).select(by, key, "ra", "dec", F.lit(0.0).alias("error_arcsec"))
    return found.unionByName(spatial.close_groups(pairs, by, key, link_arcsec))


def _nearest(batches: Iterator[pa.RecordBatch], by: str, key: str, radius_arcsec: float, threshold: int) -> Iterator[pa.RecordBatch]:
    """by, key and object where a source has its nearest target, or one as near within a hair, among those of whose components it is in and that have enough sources that count."""
    least = math.cos(math.radians(min(radius_arcsec / 3600, 180.0))) - 1e-13
    for around, targets in _told(batches, key, radius_arcsec):
        best, found, n = np.full(len(around.names), np.inf), [], 0

        def kept() -> tuple[np.ndarray, ...]:
            node, owner, apart, number = (np.concatenate(x) for x in zip(*found, strict=True))  # noqa: B023
            some = apart <= best[node] * (1 + HAIR) + HAIR  # noqa: B023
            return node[some], owner[some], apart[some], number[some]

        for k, (ra, dec) in enumerate(_positions(targets)):
            rows, apart = around.within(ra, dec, radius_arcsec, least)
            if not len(rows):
                continue
            label, node, counts = around.labels(rows), around.node[rows], around.counts[rows]
            enough = np.bincount(label, weights=counts, minlength=len(around.size))[label] >= threshold
            some = np.flatnonzero(enough & counts & (apart <= best[node] * (1 + HAIR) + HAIR))
            if not len(some):
                continue
            order = np.lexsort((node, apart))
            first = np.full(len(around.size), -1)
            components, at = np.unique(label[order], return_index=True)  # by the nearest of each
            first[components[np.argsort(at)]] = np.arange(1, len(components) + 1)
            np.minimum.at(best, node[some], apart[some])
            found.append((node[some], np.full(len(some), k), apart[some], first[label[some]]))
            n += len(some)
            if n > 4 * len(best) + OUT_ROWS:
                found = [kept()]
                n = len(found[0][0])
        if found:
            node, owner, _, number = kept()
            yield pa.RecordBatch.from_arrays([targets.column(by).combine_chunks().take(pa.array(owner)), around.names.take(pa.array(node)), pa.array(number, pa.int32())], [by, key, "object"])


def nearest_objects(targets: DataFrame, sources: DataFrame, radius_arcsec: float, by: str, key: str, threshold: int, near_bytes: int = NEAR_BYTES) -> tuple[DataFrame, DataFrame]:
    """by, key and object (numbered as search.crossmatch has it) for each source's nearest target, and those as near within a hair, and the targets that are too crowded.

    sources: key, ra, dec and counts, a condition; a component of a target's sources, linked within the radius, is
    an object of it, if threshold of its sources count. Only sources that count are told. Ids of targets are unique.
    """
    rows, crowded = spots(targets.select(by, F.col("t_ra").cast("double").alias("t_ra"), F.col("t_dec").cast("double").alias("t_dec")), sources.select(key, F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), "counts"), radius_arcsec, key, near_bytes)
    kind = f"`{by}` {targets.schema[by].dataType.simpleString()}, `{key}` {sources.schema[key].dataType.simpleString()}, object int"
    return rows.mapInArrow(lambda b: _nearest(b, by, key, radius_arcsec, threshold), kind), crowded
