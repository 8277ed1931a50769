"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

A piece of n ids costs linear * n + quadratic * n * n: the layers that see each id by itself, and attention
within the piece. Documents longer than the capacity are cut into the fewest pieces that fit, of nearly equal
length, which is the cheapest such cut. Pieces are dealt to groups of some GROUP_SEQUENCES sequences by a hash
of where they were read. In a group the costliest piece goes first, to the sequence that has cost the least so
far among those with enough free tokens; if none has, it fills the cheapest one that has any, and its rest
goes on as a piece of its own.

A group's ids fill its sequences to the last place; what is beyond a multiple of the capacity meets that of
other groups, FAN_IN of them in one, until one group is left. Its last ids, fewer than the capacity, fill
sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, cut, mix, text_batches
from orrery.llm.packing import CAPACITY, word_bpe

END_ID = 2
#: The cost of a piece: a layer of width d takes 24 * d * d operations for an id by itself and 4 * d for a pair of ids; d = 1024.
LINEAR, QUADRATIC = 1.0, 1 / (6 * 1024)
#: Sequences of a group, groups whose rests meet, and tasks at most.
GROUP_SEQUENCES, FAN_IN, MOST_TASKS = 256, 256, 20_000
#: Ids in one Arrow batch of packed pieces, or one piece more; bytes of an id between tasks, enough for vocabularies of up to 65,536.
BATCH_IDS, ID_BYTES = 1 << 18, 2

_U = np.uint64


def _documents(batches: Iterator[pa.RecordBatch], file: str, capacity: int, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(file)
    task, read, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(width, "little")
    for batch in batches:
        for part in text_batches(batch):
            rows, ids = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = bpe.encode(text)
                if len(found) and int(found.max()) >> 8 * width:
                    raise ValueError(f"an id does not fit into {width} bytes")
                own = found.astype(f"<u{width}").tobytes() + end
                tokens = len(own) // width
                pieces = -(-tokens // capacity)
                at = [tokens * k // pieces for k in range(pieces + 1)]
                for a, b in zip(at, at[1:], strict=False):
                    rows.append((doc, a, b - a, tokens))
                    ids.append(own[width * a : width * b])
            salt = mix(np.arange(len(rows), dtype=_U) + _U((task << 40) + read)) >> _U(1)
            read += len(rows)
            columns = [*(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), pa.array(salt.astype(np.int64)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "salt", "ids"])


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, id_bytes: int = ID_BYTES) -> DataFrame:
    """doc_id, start, length, doc_tokens, salt and ids (little-endian, id_bytes each): each document's ids and one end_id, in pieces of at most capacity.

    A null or empty text is the end_id alone. Rows that repeat an id, or have none, each give their pieces;
    other columns are ignored. salt is a hash of where a row was read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(lambda b: _documents(b, file, capacity, end_id, id_bytes), "doc_id long, start long, length long, doc_tokens long, salt long, ids binary")


def capacities(total: int, capacity: int, last: bool) -> list[int]:
    """What the sequences of total ids hold: full ones, then the rest, in one or, if it is the last, by powers of two."""
    whole, rest = divmod(total, capacity)
    if not last:
        return [capacity] * whole + [rest] * (rest > 0)
    return [capacity] * whole + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], room: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for every part of pieces of these lengths, in the order in which they are placed.

    room, the sequences' capacities, adds up to the lengths. The costliest piece is next (of equal ones the
    first); its sequence is the one with the least cost among those with enough room. Where none has enough,
    the piece fills the cheapest sequence with any room and its rest is a piece.
    """
    free, cost = np.array(room, np.int64), np.zeros(len(room))
    size = free.copy()
    waiting = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    while waiting:
        n, piece, begin = heapq.heappop(waiting)
        n = -n
        fits = free >= n
        if not fits.any():
            fits = free > 0
        s = int(np.where(fits, cost, np.inf).argmin())
        put = min(n, int(free[s]))
        yield piece, begin, put, s, int(size[s] - free[s])
        free[s] -= put
        cost[s] += linear * put + quadratic * put * put
        if put < n:
            heapq.heappush(waiting, (put - n, piece, begin + put))


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "bucket", "ids"]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, bucket long, ids binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """bucket and its pieces (doc_id, start, doc_tokens, ids), one bucket at a time, out of batches sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        own = batch.column("bucket").to_pylist()
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), strict=True)
        for b, key, ids in zip(own, keys, batch.column("ids").to_pylist(), strict=True):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append((*key, ids))
    if rows:
        yield bucket, rows


def _packed(batches: Iterator[pa.RecordBatch], level: int, last: bool, capacity: int, linear: float, quadratic: float, width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple], ids: list) -> pa.RecordBatch:
        columns = [pa.array(x, pa.bool_() if n == "open" else pa.int64()) for n, x in zip(_NAMES[:-1], zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], _NAMES)

    for bucket, pieces in _groups(batches):
        lengths = [len(p[3]) // width for p in pieces]
        room = capacities(sum(lengths), capacity, last)
        base = (level << 56) | (bucket << 20)
        rows, ids, held = [], [], 0
        for k, begin, n, s, at in assign(lengths, room, linear, quadratic):
            doc, start, tokens, own = pieces[k]
            part = own[width * begin : width * (begin + n)]
            plain = np.frombuffer(part, f"<u{width}").astype("<u4").tobytes()
            still = not last and room[s] < capacity
            rows.append((doc, start + begin, n, zlib.crc32(plain), tokens, base + s, at, still, bucket))
            ids.append(part if still else plain if with_ids else None)
            held += n
            if held >= BATCH_IDS:
                yield out(rows, ids)
                rows, ids, held = [], [], 0
        if rows:
            yield out(rows, ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True, id_bytes: int = ID_BYTES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, and ids, 4 bytes each, if asked) with a sequence_id and their offset in it, gapless from 0.

    Every id of pieces is in exactly one row. All sequences but some with a power of two of ids are full.
    Which pieces share a sequence depends on how the input was read; an empty input gives no rows. A group
    holds some GROUP_SEQUENCES * capacity ids, which is what a task holds.
    """
    bounded_batches(pieces.sparkSession)
    now = cut(pieces, "documents")
    total = now.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, total // (GROUP_SEQUENCES * capacity))
    now = now.withColumn("bucket", F.pmod("salt", F.lit(groups)))
    columns, done = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids], None
    for level in count():
        tasks, last = min(groups, MOST_TASKS), groups == 1
        dealt = now.select("doc_id", "start", "doc_tokens", "bucket", "ids").repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
        out = cut(dealt.mapInArrow(lambda b, level=level, last=last: _packed(b, level, last, capacity, linear, quadratic, id_bytes, with_ids), _SCHEMA), "packed")
        part = out.where("not open").select(*columns)
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        groups = -(-groups // FAN_IN)
        now = out.where("open").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))


def sequence_costs(packed: DataFrame, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """sequence_id, tokens and cost of each sequence."""
    n = F.col("length")
    return packed.groupBy("sequence_id").agg(F.sum(n).alias("tokens"), F.sum(linear * n + quadratic * n * n).alias("cost"))
