"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

On a bounded sample, principal directions are found and a rotation is learnt that brings the rotated sample
as near as it can to the corners of a cube; the signs are balanced binary codes. Several such rotations give
as many bits as are needed. The code is cut into substrings, one table to each: vectors that agree in a whole
substring meet there. The bits of a substring follow the number of vectors, and the number of tables is
calibrated so that pairs just at the threshold, and the sample's own pairs beyond it, meet in some table as
often as recall asks. Pairs that meet count in the first table where they do.

Equal vectors of a label are one node with a count. Only codes travel to the tables: a bucket of a few nodes
gives those pairs whose whole codes are no further apart than those of any calibration pair, and the original
vectors are fetched for these alone and decide. The nodes of a crowded bucket meet with their vectors, block by
block: that gives, for each node, its number of links and a link to its local component, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, components, cut, small_or_not
from orrery.llm.vectors import cosines, lengths_of, matrix, sample, unit, usable

#: Rows that rotations are learnt on, and the pairs at the threshold that calibrate the number of tables.
SAMPLE_ROWS = 20_000
CALIBRATION_PAIRS = 4_000
RECALL = 0.98
#: Bits of a substring, at least and at most, and tables at most.
LEAST_BITS, MOST_BITS, MOST_TABLES = 8, 24, 96
#: Nodes of a bucket up to which it yields pairs; of larger ones, nodes of a block.
FEW, BLOCK = 24, 1024
#: Pairs of small buckets that a task compares at a time; rows of the sample whose own pairs are sought.
STEP_PAIRS, REAL_ROWS = 1 << 17, 2_000
#: Vectors that so many rows share, or a HOT_SHARE-th of all rows if that is more, are joined back by broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 100_000


@dataclass(frozen=True)
class Codes:
    """Mean, projections (one column a bit), the bits of a table's substring, the share of calibration pairs that met, and the bits in which any of them differs at most."""

    mean: np.ndarray
    projection: np.ndarray
    bits: int
    recall: float = 1.0
    apart: int = 1 << 30

    @property
    def tables(self) -> int:
        return self.projection.shape[1] // self.bits

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The substring in each table of unit vectors x."""
        signs = ((x - self.mean) @ self.projection[:, : self.tables * self.bits] > 0).reshape(len(x), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def packed(self, keys: np.ndarray) -> pa.Array:
        """The keys' bits, close together."""
        bits = (keys[:, :, None] >> np.arange(self.bits)) & 1
        return pa.array([x.tobytes() for x in np.packbits(bits.reshape(len(keys), -1).astype(np.uint8), axis=1)], pa.binary())

    def unpacked(self, codes: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
        bits = np.unpackbits(raw, axis=1)[:, : self.tables * self.bits].reshape(len(codes), self.tables, self.bits)
        return bits @ (1 << np.arange(self.bits, dtype=np.int64))


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A projection of centred x to bits: principal directions and the rotation that quantises them best."""
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    w = directions[:bits].T
    v = x @ w
    r = np.linalg.qr(rng.standard_normal((w.shape[1], w.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ vt).T
    return w @ r


def _met_share(codes: Codes, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The share of pairs that meet in the first table, the first two and so on, MOST_TABLES at most; of several sets of pairs the least."""
    return np.min([np.maximum.accumulate((codes.keys(a) == codes.keys(b))[:, :MOST_TABLES], axis=1).mean(axis=0) for a, b in sets], axis=0)


def _real_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sample, other than equal ones, that are near enough."""
    i, j = np.nonzero(np.triu(x[:REAL_ROWS] @ x.T >= threshold, 1))
    other = (x[i] != x[j]).any(axis=1)
    some = np.flatnonzero(other)[:: max(1, int(other.sum()) // CALIBRATION_PAIRS)]
    return x[i[some]], x[j[some]]


def fit_codes(x: np.ndarray, rows: int, threshold: float, recall: float = RECALL, seed: int = 11) -> Codes:
    """Codes for rows vectors in all, learnt on the sample x of unit vectors.

    If MOST_TABLES tables don't reach the recall, substrings get shorter until they do: buckets are more
    crowded then, but all that meets is compared. Raises ValueError if not even one bit is enough.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    bits = int(min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, rows))))))
    bits = max(1, bits)
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    if len(x) < 2:
        return Codes(mean, np.ones((dim, bits)), bits)
    # pairs whose cosine is just the threshold
    a = x[rng.integers(0, len(x), CALIBRATION_PAIRS)]
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * noise / np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12) if dim > 1 else a
    sets, real = [(a, b)], _real_pairs(x, threshold)
    if len(real[0]) >= 50:
        sets.append(real)
    projection = np.zeros((dim, 0))
    while True:
        projection = np.hstack([projection, learn_rotation(x - mean, min(dim, len(x)), rng)])
        codes = Codes(mean, projection, bits)
        if not codes.tables:
            continue
        met = _met_share(codes, sets)
        if met[-1] >= recall or codes.tables >= MOST_TABLES:
            break
    while met[-1] < recall and codes.bits > 1:
        codes = Codes(mean, projection[:, : MOST_TABLES * (codes.bits - 1)], codes.bits - 1)
        met = _met_share(codes, sets)
    if met[-1] < recall:
        raise ValueError(f"{codes.tables} tables of one bit reach a recall of {met[-1]:.3f} for {recall}")
    tables = int(np.argmax(met >= recall)) + 1
    codes = Codes(mean, projection[:, : tables * codes.bits], codes.bits, float(met[tables - 1]))
    apart = max(int(np.bitwise_count(codes.keys(a) ^ codes.keys(b)).sum(axis=1).max()) for a, b in (*sets, real) if len(a))
    return replace(codes, apart=apart)


def _close_pairs(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, label, table, node, code) sorted by bucket to pairs of nodes that meet here first and whose codes are close."""

    def solved(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(c["bucket"])) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(c["bucket"])]])
        size = end - begin
        for n in np.unique(size[size > 1]).tolist():  # FEW at most, but where two buckets share a hash
            i, j = np.triu_indices(n, 1)
            own = begin[size == n]
            step = max(1, STEP_PAIRS // len(i))
            for at in range(0, len(own), step):
                x, y = ((own[at : at + step, None] + k).ravel() for k in (i, j))
                same = (c["label"][x] == c["label"][y]) & (c["table"][x] == c["table"][y])
                x, y = x[same], y[same]
                differ = c["keys"][x] ^ c["keys"][y]
                table = c["table"][x]
                first = (differ == 0).argmax(axis=1) == table
                near = first & (differ[np.arange(len(x)), table] == 0) & (np.bitwise_count(differ).sum(axis=1) <= codes.apart)
                yield pa.RecordBatch.from_arrays([pa.array(c["node"][z[near]]) for z in (x, y)], ["a", "b"])

    carry: dict[str, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        c = {k: b.column(k).to_numpy() for k in ("bucket", "label", "table", "node")} | {"keys": codes.unpacked(b.column("code"))}
        if carry:
            c = {k: np.concatenate([carry[k], v]) for k, v in c.items()}
        last = int(np.searchsorted(c["bucket"], c["bucket"][-1]))  # the last bucket may go on
        carry = {k: v[last:] for k, v in c.items()}
        if last:
            yield from solved({k: v[:last] for k, v in c.items()})
    if carry:
        yield from solved(carry)


def _sure(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with both vectors to those that are near enough."""
    for b in batches:
        if b.num_rows:
            near = cosines(matrix(b.column("va")), matrix(b.column("vb"))) >= threshold
            yield b.select(["a", "b", "ca", "cb"]).filter(pa.array(near))


def _block_links(t: pa.Table, codes: Codes, threshold: float) -> pa.Table:
    """Of two blocks of a crowded bucket, or of one, node, links and least node of the local component for each node that links."""
    t = t.combine_chunks().sort_by("node")
    block, node, count, label, table = (t.column(c).to_numpy() for c in ("block", "node", "count", "label", "table"))
    v, keys = matrix(t.column("v").combine_chunks()), codes.unpacked(t.column("code").combine_chunks())
    one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    left = np.flatnonzero(block == t.column("i")[0].as_py())
    right = left if one else np.flatnonzero(block == t.column("j")[0].as_py())
    here = int(table[0])
    open_ = (label[left][:, None] == label[right][None, :]) & (keys[left, here][:, None] == keys[right, here][None, :])
    if one:
        open_ &= np.tri(len(left), dtype=bool, k=-1).T
    for k in range(here):  # pairs that met in an earlier table have been counted there
        if not open_.any():
            break
        open_ &= keys[left, k][:, None] != keys[right, k][None, :]
    links, pairs = np.zeros(len(node), np.int64), []
    u = unit(v)
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        if open_[at : at + 64].any():
            x, y = np.nonzero(open_[at : at + 64] & (u[some] @ u[right].T >= threshold - 1e-9))
            x, y = some[x], right[y]
            near = cosines(v[x], v[y]) >= threshold
            x, y = x[near], y[near]
            np.add.at(links, x, count[y])
            np.add.at(links, y, count[x])
            pairs.append((x, y))
    x, y = (np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)]) for k in (0, 1))
    least = np.arange(len(node))  # rows are in the order of nodes
    while True:
        now = least.copy()
        np.minimum.at(now, x, least[y])
        np.minimum.at(now, y, least[x])
        now = now[now]
        if (now == least).all():
            break
        least = now
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "root": node[least[some]]})


def _of_one_length(good: DataFrame, threshold: float, recall: float) -> DataFrame:
    """vec_id, n_links and component_id for rows (vec_id, label, v) of usable vectors of one length."""
    nodes = good.groupBy("tag").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("count")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes, "nodes")  # numbered as they are written
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = fit_codes(sample(nodes, F.xxhash64("label", "v"), "v", SAMPLE_ROWS), largest, threshold, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = codes.keys(unit(matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), codes.packed(keys), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "label", "code", "keys"])

    at = cut(nodes.select("node", F.xxhash64("label").alias("label"), "v").mapInArrow(coded, "node long, label long, code binary, keys array<long>"), "codes")
    at = at.select("node", "label", "code", F.posexplode("keys").alias("table", "key")).withColumn("bucket", F.xxhash64("label", "table", "key"))
    crowded = at.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    crowded = small_or_not(cut(crowded, "crowded"))

    few = at.join(crowded, "bucket", "left_anti").select("bucket", "label", "table", "node", "code")
    pairs = cut(few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _close_pairs(b, codes), "a long, b long"), "pairs")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("count").alias(f"c{x}"), F.col("v").alias(f"v{x}"))
    sure = cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda b: _sure(b, threshold), "a long, b long, ca long, cb long"), "sure")

    met = at.join(crowded, "bucket").join(nodes.select("node", "count", "v"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    met = met.select("bucket", "i", "j", "block", "table", "label", "node", "count", "code", "v").groupBy("bucket", "table", "i", "j")
    crowds = cut(met.applyInArrow(lambda t: _block_links(t, codes, threshold), "node long, links long, root long"), "crowds")

    links = crowds.select("node", "links").unionByName(sure.selectExpr("a as node", "cb as links")).unionByName(sure.selectExpr("b as node", "ca as links"))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = cut(components(crowds.selectExpr("node as a", "root as b").unionByName(sure.select("a", "b"))), "found")
    least = found.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("least_id"))
    of_node = nodes.join(links, "node", "left").join(found.join(least, "component").select("node", "least_id"), "node", "left")
    of_node = of_node.select("tag", "count", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("least_id", "least").alias("component_id"))
    of_node = cut(of_node, "of_node")
    rows, hot = good.select("vec_id", "tag"), max(HOT_ROWS, good.count() // HOT_SHARE)  # at most HOT_SHARE vectors are as frequent
    told = rows.join(F.broadcast(of_node.where(F.col("count") >= hot).select("tag", F.struct("n_links", "component_id").alias("hot"))), "tag", "left")
    rare = told.where("hot is null").select("vec_id", "tag").join(of_node.where(F.col("count") < hot), "tag").select("vec_id", "n_links", "component_id")
    return told.where("hot is not null").select("vec_id", "hot.n_links", "hot.component_id").unionByName(rare)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors.

    Two vectors of one label and one length link if their cosine is at least threshold. Vectors without a
    label, null or zero ones and those with null or non-finite components link with nothing. Every row is a
    vector of its own, also where it repeats an id or has none: it links with the other rows like any, and a
    component's id is the smallest of its rows' ids, null if none has one. Other columns are ignored; an empty
    table gives no rows. Each length that two vectors have is a run of its own.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    element = vectors.schema[vector_col].dataType.elementType
    rows = rows.withColumn("good", usable(F.col("v")) & F.col("label").isNotNull()).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0).cast(element))))
    # equal vectors of one label meet by 128 bits of a digest of both
    rows = rows.withColumn("tag", F.when(F.col("good"), F.unhex(F.md5(F.to_json(F.struct("label", "v")).cast("binary")))))
    rows = cut(rows, "vectors")
    good = rows.where("good").select("vec_id", "v", "label", "tag")
    sizes = lengths_of(good, "v", 2)
    alone = rows.where(~(F.col("good") & F.size("v").isin(sizes)))
    out = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for n in sizes:
        out = out.unionByName(_of_one_length(good.where(F.size("v") == n), threshold, recall))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
