"""A Merkle manifest of a dataset with a proof for every row, by fractal traversal of aligned blocks.

A leaf is the digest of a row; by source, leaves in the order of their ids are put together 16 at a time until
one is left, the source's subroot, and the subroots in the same way until the root is left. A row's proof is,
level by level, the digests that are put together with its own.

A source's leaves are split into aligned blocks of 16 ** HEIGHT. A task goes through one block's leaves in
order and keeps, for each level, the run of digests that the current path lies in (the existing subtrees) and
the next run as far as it has been built (the desired ones): each leaf advances each desired run by one leaf,
so a run is done just when it is needed. The levels above the blocks are joins of tables that are 16 times
smaller each; their part of the proof goes before the block's leaves and ends every proof of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, cut, in_order, numbered

ARITY = 16
#: Levels within a block, which has ARITY ** HEIGHT leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the run's digests, and which of them is the path's own.
STEP = "struct<at:int,run:array<string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: of each field "-" if it is null, else its bytes in UTF-8, ":" and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Traversal:
    """The authentication paths of one block's leaves, in order: existing runs by level, and the next ones as they grow."""

    def __init__(self, leaves: list[str], height: int, arity: int = ARITY):
        self.leaves, self.height, self.arity = leaves, height, arity
        self.existing: list[list[str]] = []
        nodes, self.sizes = leaves, []
        for _ in range(height):
            self.existing.append(nodes[:arity])
            self.sizes.append(len(nodes))
            nodes = [digest(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        self.root = nodes[0]
        self.desired: list[list[str]] = [[] for _ in range(height)]
        # for each desired run: the digests below it that aren't a whole run yet, by level, and its next leaf
        self.pending = [[[] for _ in range(level)] for level in range(height)]
        self.next = [arity ** (level + 1) for level in range(height)]

    def _advance(self, level: int) -> None:
        """Take one more leaf into the desired run of a level."""
        i = self.next[level]
        if i >= len(self.leaves) or len(self.desired[level]) == self.arity:
            return
        self.next[level] += 1
        node, final = self.leaves[i], i + 1 == len(self.leaves)
        for below in self.pending[level]:
            below.append(node)
            if len(below) < self.arity and not final:
                return
            node = digest(below)
            below.clear()
        self.desired[level].append(node)

    def paths(self) -> Iterator[list[tuple[int, list[str]]]]:
        """For each leaf, from its level up, its place in the run and the run."""
        for i in range(len(self.leaves)):
            if i:
                for level in range(self.height):
                    self._advance(level)
                    if i % self.arity ** (level + 1) == 0:  # the path enters the next run of this level
                        self.existing[level], self.desired[level] = self.desired[level], []
            yield [(i // self.arity**level % self.arity, run) for level, run in enumerate(self.existing)]


def levels_of(n: int) -> int:
    """How many times n digests are put together until one is left."""
    return 0 if n < 2 else 1 + levels_of(-(-n // ARITY))


def folded(own: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its proof lead to."""
    for at, run in steps:
        own = digest([*run[:at], own, *run[at + 1 :]])
    return own


def _siblings(steps: list[tuple[int, list[str]]]) -> list[str]:
    return [h for at, run in steps for h in (*run[:at], *run[at + 1 :])]


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str, int, list[tuple]]]:
    """Source, block and rows of each block, out of batches sorted by both."""
    key, rows = None, []
    for batch in batches:
        for own, row in zip(zip(batch.column("src").to_pylist(), batch.column("block").to_pylist(), strict=True), zip(*(batch.column(n).to_pylist() for n in names), strict=True), strict=True):
            if own != key and rows:
                yield *key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield *key, rows


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("src", "block").sortWithinPartitions("src", "block", *order)


def _block_roots(leaves: DataFrame, height: int) -> DataFrame:
    """src, i (the block), n (the source's blocks) and h, the digest of each block."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, block, rows in _blocks(batches, ["leaf", "n"]):
            n, nodes = rows[0][1], [r[0] for r in rows]
            for _ in range(min(height, levels_of(n))):
                nodes = [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
            yield pa.RecordBatch.from_arrays([pa.array([src], pa.string()), *(pa.array([x], pa.int64()) for x in (block, -(-n // ARITY**height))), pa.array(nodes, pa.string())], ["src", "i", "n", "h"])

    return _by_block(leaves.select("src", "block", "pos", "leaf", "n"), "pos").mapInArrow(roots, "src string, i long, n long, h string")


def upper_paths(nodes: DataFrame) -> DataFrame:
    """src, i, path (steps from the node up) and top (its src's last digest) for nodes(src, i, n, h), i rising from 0 to n - 1.

    One round for each level: runs of ARITY nodes become one. The paths are put together from the top down.
    """
    level, floors, tops = cut(nodes, "nodes"), [], None
    while True:
        top = level.where("n = 1").select("src", F.col("h").alias("top"))
        tops = top if tops is None else tops.unionByName(top)
        below = level.where("n > 1")
        if below.isEmpty():
            break
        runs = below.groupBy("src", F.expr(f"i div {ARITY}").alias("up"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("run"))
        runs = cut(runs, "runs")
        floors.append(runs)
        level = cut(runs.select("src", F.col("up").alias("i"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.sha2(F.concat_ws("", "run"), 256).alias("h")), "nodes")
    paths = tops.select("src", F.lit(0).cast("long").alias("i"), F.expr(f"cast(array() as array<{STEP}>)").alias("path"), "top")
    for runs in reversed(floors):
        step = lambda at: F.array(F.struct(at.cast("int").alias("at"), F.col("run").alias("run")))
        own = runs.withColumnRenamed("up", "parent").join(paths.withColumnRenamed("i", "parent"), ["src", "parent"], "left")
        further = own.select("src", F.posexplode("run").alias("at", "h"), "parent", "run", "path", "top").select("src", (F.col("parent") * ARITY + F.col("at")).alias("i"), F.concat(step(F.col("at")), "path").alias("path"), "top")
        ended = paths.join(runs.select("src").distinct(), "src", "left_anti")  # single nodes of this level that no run holds
        paths = cut(further.unionByName(ended), "paths")
    return paths


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def _proofs(batches: Iterator[pa.RecordBatch], height: int, with_proof: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "claimed", "n", "path", "subroot", "root"]
    for _, _, (head, *rows) in _blocks(batches, names):
        *_, path, subroot, root = head
        upper = [(s["at"], s["run"]) for s in path]
        after = "".join(_siblings(upper)).encode()
        n = rows[0][3]
        walk = Traversal([r[1] for r in rows], min(height, levels_of(n)))
        out = []
        for (doc, leaf, claimed, *_), steps in zip(rows, walk.paths(), strict=True):
            proof = _siblings(steps)
            sha = hashlib.sha256("".join(proof).encode())
            sha.update(after)
            back = folded(claimed, steps + upper)
            out.append((doc, leaf, subroot, root, sha.hexdigest(), back, back == root, proof + _siblings(upper) if with_proof else None))
            if with_proof and len(out) == 256:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in _PROOF.split(", ")])


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", claimed: dict[str, Column] | None = None, height: int = HEIGHT, with_proof: bool = False) -> DataFrame:
    """Leaf, subroot, root and proof of each row of docs; folded_root is what the claimed row and the proof lead to.

    claimed: columns in place of a row's own for the leaf that is verified; none claims the rows as they are.
    Rows of a source are in the order of their ids (null first), then leaves; rows that are equal in all fields
    have equal leaves and a proof each. A null source comes first and is not the empty one. Columns that
    aren't fields are ignored. An empty table gives no rows and has no root.
    """
    bounded_batches(docs.sparkSession)
    plain = {f: F.col(f"`{f}`") for f in fields}
    # a source's key sorts as the source does, null before all others
    src = F.when(F.col(f"`{source_col}`").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"`{source_col}`").cast("string")))
    changed = leaf_of([(claimed or {}).get(f, plain[f]) for f in fields]) if claimed else F.lit(None).cast("string")
    rows = docs.select(src.alias("src"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf_of(list(plain.values())).alias("leaf"), changed.alias("claimed"))
    rows = rows.withColumn("claimed", F.coalesce("claimed", "leaf"))
    leaves = numbered(in_order(rows, ["src", "doc_id", "leaf"]), "src").withColumn("block", F.expr(f"pos div {ARITY**height}")).drop("place")
    blocks = upper_paths(_block_roots(leaves, height))
    blocks = cut(blocks, "blocks")
    sources = blocks.where("i = 0").select("src", F.col("top").alias("h")).withColumn("all", F.lit("all"))
    ranked = numbered(in_order(sources, ["all", "src"]), "all").select(F.col("all").alias("set"), F.col("pos").alias("i"), "n", "h", "src")
    ranked = cut(ranked, "sources")
    above = upper_paths(ranked.select(F.col("set").alias("src"), "i", "n", "h")).select("i", F.col("path").alias("above"), F.col("top").alias("root"))
    by_source = ranked.select("src", "i").join(above, "i").drop("i")
    heads = blocks.join(by_source, "src").select("src", F.col("i").alias("block"), F.lit(-1).cast("long").alias("pos"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root")
    both = leaves.unionByName(heads, allowMissingColumns=True)
    out = _by_block(both, "pos").mapInArrow(lambda b: _proofs(b, height, with_proof), _PROOF)
    return out if with_proof else out.drop("proof")


def tampered(docs: DataFrame) -> dict[str, Column]:
    """A claim that rows with a crc32 of their id that 5 divides have texts in lower case (A-Z only)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return {"text": F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}


def proofs_sql() -> str:
    """prove() with tampered() over documents, in DuckDB's SQL."""
    said = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(text if f == "text" else f) for f in FIELDS) + ")"
    byte = "list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda z: ascii(z)::bigint))"
    crc = f"xor(4294967295, list_reduce({byte}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive d as (select doc_id, source, {leaf('text')} as leaf, case when coalesce({crc} % 5 = 0, false) then {leaf(f"translate(text, '{up}', '{low}')")} else {leaf('text')} end as claimed from documents),
r as (select *, row_number() over () as rid, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d),
t as (select source, 0::bigint as lvl, i, n, leaf as h from r
    union all select source, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from t where n > 1 group by source, lvl, i // 16, n),
s as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from t where n = 1),
u as (select 100::bigint as lvl, i, n, subroot as h from s union all select lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from u where n > 1 group by lvl, i // 16, n),
steps as (
    select r.rid, t.lvl, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < r.i >> (4 * t.lvl)::int), '') as l, coalesce(string_agg(t.h, '' order by t.i) filter (t.i > r.i >> (4 * t.lvl)::int), '') as g
    from r join t on t.source is not distinct from r.source and t.n > 1 and t.i // 16 = r.i >> (4 * t.lvl + 4)::int group by r.rid, t.lvl
    union all select r.rid, u.lvl, coalesce(string_agg(u.h, '' order by u.i) filter (u.i < s.i >> (4 * u.lvl - 400)::int), ''), coalesce(string_agg(u.h, '' order by u.i) filter (u.i > s.i >> (4 * u.lvl - 400)::int), '')
    from r join s on s.source is not distinct from r.source join u on u.n > 1 and u.i // 16 = s.i >> (4 * u.lvl - 396)::int group by r.rid, u.lvl),
told as (select *, row_number() over (partition by rid order by lvl) as k from steps),
f as (select rid, 0::bigint as k, claimed as h from r union all select f.rid, f.k + 1, sha256(l || h || g) from f join told on told.rid = f.rid and told.k = f.k + 1),
proofs as (select rid, sha256(string_agg(l || g, '' order by k)) as proof_sha256 from told group by rid),
ends as (select rid, arg_max(h, k) as folded_root from f group by rid), top as (select h as root from u where n = 1)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from r join s on s.source is not distinct from r.source join ends using (rid) left join proofs using (rid), top"""
