"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree's top is fitted on a bounded sample and shipped to all tasks; every row is then assigned to a leaf.
Leaves that hold more than LEAF_MOST rows are split again, each by a tree fitted on a bounded sample of its own
rows, until none does, its vectors can't be told apart or the tree has TREE_BYTES; so the number of leaves
follows that of rows. A query walks the tree with a priority queue of nodes by the cosine to their centroids, and visits leaves in
the order in which they come off it. How many leaves it visits is calibrated: for a sample of queries the
exact neighbours are found in all rows, and visits widen until those are found as often as recall asks.
Queries and rows meet by leaf, both in blocks of bounded size, so a crowded leaf is many small tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut
from orrery.llm.vectors import cosines, lengths_of, matrix, sample, unit, usable

#: Rows that the top of the tree is fitted on, children of a node, sample rows that a leaf holds at most, and leaves of a fit at most.
SAMPLE_ROWS = 20_000
BRANCH = 8
LEAF_ROWS = 100
LEAVES_MOST = 4096
#: Rows beyond which a leaf is split, sample rows that this is fitted on, and bytes of centroids that all tasks hold at most.
LEAF_MOST = 2048
SPLIT_ROWS = 2048
#: Of the choice of these rows.
SEED = 7
TREE_BYTES = 64 << 20
#: Queries whose exact neighbours calibrate the visits, and the recall that they widen to.
CALIBRATION_QUERIES = 128
RECALL = 0.97
#: Rows and queries of a leaf that meet in one group.
BLOCK = 2048


@dataclass(frozen=True)
class Tree:
    """children[i]: first and last child of node i, or none for a leaf; centroid[i]; leaves are numbered by leaf[i]."""

    centroid: np.ndarray
    children: list[tuple[int, int] | None]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest child at every level."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = [n for n in np.unique(node) if self.children[n]]
            if not inner:
                return np.array(self.leaf)[node] if len(x) else node
            for n in inner:
                a, b = self.children[n]
                own = np.flatnonzero(node == n)
                node[own] = a + np.argmax(x[own] @ self.centroid[a:b].T, axis=1)

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves that a best-bin-first walk for the unit vector q comes to."""
        near = self.centroid @ q
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            if self.children[n] is None:
                out.append(self.leaf[n])
            else:
                for c in range(*self.children[n]):
                    heapq.heappush(queue, (-near[c], c))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


def fit_tree(x: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, leaves_most: int = LEAVES_MOST, seed: int = 7) -> Tree:
    """A tree over unit vectors x; equal vectors stay in one leaf. No vectors: one leaf."""
    rng = np.random.default_rng(seed)
    centroid, children, leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [None], [-1]
    todo, leaf_rows = [(0, np.arange(len(x)))], max(leaf_rows, -(-2 * len(x) // leaves_most))
    while todo:
        n, rows = todo.pop()
        k = min(branch, -(-len(rows) // leaf_rows))
        if k < 2 or len(np.unique(x[rows], axis=0)) < k:
            continue
        c = _kmeans(x[rows], k, rng)
        own = np.argmax(x[rows] @ c.T, axis=1)
        if (own == own[0]).all():
            continue
        children[n] = (len(centroid), len(centroid) + k)
        for j in range(k):
            todo.append((len(centroid), rows[own == j]))
            centroid.append(c[j])
            children.append(None)
            leaf.append(-1)
    count = 0
    for n, c in enumerate(children):
        if c is None:
            leaf[n], count = count, count + 1
    return Tree(np.array(centroid), children, leaf)


def grafted(tree: Tree, subtrees: dict[int, Tree]) -> Tree:
    """tree with subtrees in the place of some of its leaves."""
    centroid, children = list(tree.centroid), list(tree.children)
    for n, leaf in enumerate(tree.leaf):
        if leaf in subtrees and tree.children[n] is None:
            sub, base = subtrees[leaf], len(centroid) - 1  # its root is the leaf, its other nodes follow
            children[n] = (sub.children[0][0] + base, sub.children[0][1] + base)
            centroid += list(sub.centroid[1:])
            children += [c and (c[0] + base, c[1] + base) for c in sub.children[1:]]
    leaf = np.full(len(children), -1)
    ends = [n for n, c in enumerate(children) if c is None]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centroid), children, leaf.tolist())


def _indexed(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows(id, v) with their leaf, written."""

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.assign(unit(matrix(b.column("v")))), pa.int64()), *b.columns], ["leaf", "id", "v"])

    return cut(rows.mapInArrow(to_leaves, f"leaf long, id long, v {rows.schema['v'].dataType.simpleString()}"), "index")


def grown(tree: Tree, index: DataFrame, rows: DataFrame, leaf_most: int = LEAF_MOST, split_rows: int = SPLIT_ROWS, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, DataFrame]:
    """The tree with crowded leaves split by their own rows, and rows indexed by it."""

    def split(t: pa.Table) -> pa.Table:
        sub = fit_tree(unit(matrix(t.column("v").combine_chunks())), leaf_rows=leaf_rows)
        told = [] if sub.leaves < 2 else [(t.column("leaf")[0].as_py(), sub.centroid.ravel().tolist(), [x for c in sub.children for x in (c or (0, 0))])]
        return pa.table([pa.array([x[k] for x in told], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))], ["leaf", "centroid", "children"])

    whole: set[int] = set()  # leaves that can't be split
    while True:
        sizes = index.groupBy("leaf").count().where(F.col("count") > leaf_most)
        crowded = {r["leaf"]: r["count"] for r in sizes.collect() if r["leaf"] not in whole}  # leaves of a tree of bounded size
        room = TREE_BYTES // max(1, tree.centroid.nbytes // len(tree.centroid)) - len(tree.centroid)
        chosen = []
        for n in sorted(crowded, key=lambda n: -crowded[n]):  # the most crowded first, as far as the tree may grow
            room -= 2 * min(split_rows, crowded[n]) // leaf_rows
            if room < 0:
                break
            chosen.append(n)
        if not chosen:
            return tree, index
        share = F.broadcast(index.sparkSession.createDataFrame([(n, split_rows / crowded[n]) for n in chosen], "leaf long, share double"))  # leaves of the tree
        taken = index.join(share, "leaf").where(F.rand(SEED) < F.col("share")).select("leaf", "v")  # some split_rows rows of each
        found = {}
        for r in taken.groupBy("leaf").applyInArrow(split, "leaf long, centroid array<double>, children array<long>").collect():  # TREE_BYTES at most
            pairs = list(zip(r["children"][::2], r["children"][1::2], strict=True))
            found[r["leaf"]] = Tree(np.array(r["centroid"]).reshape(len(pairs), -1), [c if c[1] else None for c in pairs], [])
        keep = [n for n, c in enumerate(tree.children) if c is None and tree.leaf[n] not in found]
        stuck = {n for n in keep if tree.leaf[n] in whole or tree.leaf[n] in chosen}
        if not found:
            return tree, index
        tree = grafted(tree, found)
        whole = {tree.leaf[n] for n in stuck}  # nodes keep their numbers
        index = _indexed(rows, tree)


def _top(scores_of, ids: np.ndarray, own: int, rough: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k best of ids by exact cosine, ties to the smaller id, each id once; rough cosines leave out the hopeless."""
    rough = np.where(ids == own, -np.inf, rough)
    keep = np.flatnonzero(rough > -np.inf)
    spare = k
    while True:  # as many rows as give k different ids
        if len(keep) > spare:
            bar = np.partition(rough[keep], len(keep) - spare)[len(keep) - spare]
            some = keep[rough[keep] >= bar - 1e-9]
        else:
            some = keep
        exact = scores_of(some)
        best: dict[int, float] = {}
        for s, i in zip(exact.tolist(), ids[some].tolist(), strict=True):
            best[i] = max(s, best.get(i, -2.0))
        if len(best) >= k or len(some) == len(keep):
            return sorted(((s, i) for i, s in best.items()), key=lambda t: (-t[0], t[1]))[:k]
        spare *= 4


_FOUND = "query_id long, vec_id long, score double, leaf long"


def _neighbours(vec: np.ndarray, ids: np.ndarray, leaf: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """Of one block of rows the k nearest to each query, with their leaves."""
    rows: list[tuple[int, int, float]] = []
    rough = unit(queries) @ unit(vec).T if len(vec) and len(queries) else np.zeros((len(queries), 0))
    for r, q, i in zip(rough, queries, query_ids.tolist(), strict=True):
        rows += [(i, v, s) for s, v in _top(lambda some, q=q: cosines(vec[some], np.broadcast_to(q, vec[some].shape)), ids, i, r, k)]
    query, found, score = zip(*rows, strict=True) if rows else ((), (), ())
    leaf_of = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64()), pa.array([leaf_of[v] for v in found], pa.int64())], ["query_id", "vec_id", "score", "leaf"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max_by("leaf", "score").alias("leaf"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """The k nearest of all rows(leaf, id, v) to a bounded set of queries, block by block of the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _neighbours(matrix(b.column("v")), b.column("id").to_numpy(), b.column("leaf").to_numpy(), queries, query_ids, k)

    return _best(index.select("leaf", "id", "v").mapInArrow(scan, _FOUND), k)


def calibrate(tree: Tree, index: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, most: int = CALIBRATION_QUERIES) -> int:
    """How many leaves to visit: the fewest with which a sample of queries finds its exact neighbours as often as recall asks."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    if not some.num_rows:
        return 1
    q, ids = matrix(some.column("v").combine_chunks()), some.column("id").to_numpy()
    found = exact_neighbours(index, q, ids, k).select("query_id", "leaf").toArrow()  # most * k rows
    if not found.num_rows:
        return 1
    place = dict(zip(ids.tolist(), (np.argsort(tree.visits(x, tree.leaves)) for x in unit(q)), strict=True))
    ranks = np.sort([place[i][at] for i, at in zip(found.column("query_id").to_pylist(), found.column("leaf").to_pylist(), strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _search_length(rows: DataFrame, queries: DataFrame, k: int, recall: float, leaf_most: int) -> DataFrame:
    """query_id, vec_id, score, rank for rows and queries (id, v) whose vectors have one length."""
    tree = fit_tree(sample(rows, F.xxhash64("id", "v"), "v", SAMPLE_ROWS))
    tree, index = grown(tree, _indexed(rows, tree), rows, leaf_most)
    visits = min(tree.leaves, calibrate(tree, index, queries, k, recall))

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                leaves = [tree.visits(x, visits) for x in unit(matrix(part.column("v")))]
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.list_(pa.int64())), *part.columns], ["leaves", *part.schema.names])

    asked = cut(queries.mapInArrow(to_visits, f"leaves array<long>, id long, v {rows.schema['v'].dataType.simpleString()}"), "asked")
    asked = asked.select(F.explode("leaves").alias("leaf"), "id", "v")
    in_leaf = {r["leaf"]: -(-r["count"] // BLOCK) for r in index.groupBy("leaf").count().collect()}  # one row a leaf of the tree
    on_leaf = {r["leaf"]: -(-r["count"] // BLOCK) for r in asked.groupBy("leaf").count().collect()}
    blocks = rows.sparkSession.createDataFrame([(n, m, on_leaf[n]) for n, m in in_leaf.items() if n in on_leaf] or [(-1, 1, 1)], "leaf long, rb long, qb long")

    def dealt(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        mine, others = ("r", "q") if kind == 0 else ("q", "r")
        return df.join(F.broadcast(blocks), "leaf").withColumn(mine, F.pmod(F.xxhash64("id"), own)).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("leaf", "r", "q", F.lit(kind).alias("kind"), "id", "v")

    def meet(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        v, ids, leaf = matrix(t.column("v").combine_chunks()), t.column("id").to_numpy(), t.column("leaf").to_numpy()
        return pa.Table.from_batches([_neighbours(v[kind == 0], ids[kind == 0], leaf[kind == 0], v[kind == 1], ids[kind == 1], k)])

    met = dealt(index, "rb", "qb", 0).unionByName(dealt(asked, "qb", "rb", 1)).groupBy("leaf", "r", "q").applyInArrow(meet, _FOUND)
    return _best(met, k).drop("leaf")


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, leaf_most: int = LEAF_MOST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, its k nearest rows of other ids by cosine.

    Vectors that are null, zero, or hold null or non-finite components take no part; a vector has a cosine with
    those of its length only, and each length is a search of its own. Ties go to the smaller id. Rows that
    repeat an id count as one candidate with the best of their cosines; repeated query rows give one result.
    Fewer than k candidates give as many rows as there are.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = cut(rows, "vectors")
    queries = rows.where(is_query(F.col("id")))
    sizes = lengths_of(queries, "v")
    found = rows.sparkSession.range(0).selectExpr("id as query_id", "id as vec_id", "cast(null as double) as score", "cast(null as int) as rank")
    for n in sizes:
        same = F.size("v") == n
        found = found.unionByName(_search_length(rows.where(same), queries.where(same), k, recall, leaf_most))
    one = _best(found.withColumn("leaf", F.lit(0).cast("long")), k) if len(sizes) > 1 else found  # an id may have vectors of several lengths
    return one.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
