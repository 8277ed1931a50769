"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bounded-space online best-fit: each task packs its pieces as they come into at most OPEN_BINS open bins,
held in a bitset keyed by free space, so the bin with the least free space that still fits is its lowest
set bit from the piece's length on. If none fits and all bins are open, the fullest closes first. What is
in a task's open bins at its end is packed again, FAN_IN tasks' leftovers in one, until one task is left. That
is at most OPEN_BINS sequences of each task; they come longest first, and FAN_IN * OPEN_BINS bins may be open.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, cut, text_batches

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 256
FAN_IN = 16
#: Ids in one Arrow batch of packed pieces, or one piece more.
BATCH_IDS = 1 << 18

# Characters whose lower case, class and normal form are beyond doubt; texts with others take the library's own way.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
# The tokenizer file's splitting pattern for such characters.
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordBpe:
    """Encodes with a BPE file of the tokenizers library whose last symbol of each word carries an end mark."""

    def __init__(self, file: str):
        import json

        import public_tokenizers
        import tiktoken
        import tokenizers

        path = public_tokenizers.path(file)
        spec = json.load(open(path))
        bytes_of = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(bytes_of)]
        back = {chr(b): b for b in bytes_of} | {chr(256 + i): b for i, b in enumerate(rest)}
        end = spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(end)
                ranks[bytes(back[c] for c in (token[: -len(end)] if ends else token)) + b"\0" * ends] = i
        # NUL marks a word's end: its merges rank before all others, as if the last symbol had carried the mark
        self._words = tiktoken.Encoding(file, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self._library = tokenizers.Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()

    def encode(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or "<|" in text:
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = _WORD.findall(text.lower())
        return self._words.encode_to_numpy("\0".join(words) + "\0") if words else np.empty(0, np.uint32)


@functools.lru_cache(4)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)


def _pieces(batches: Iterator[pa.RecordBatch], file: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(file)
    for batch in batches:
        for part in text_batches(batch):
            rows, ids = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = np.append(bpe.encode(text), end_id).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    piece = own[at : at + capacity]
                    rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes())))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of at most capacity ids of each document's ids and one end_id: doc_id, piece, start, length, ids_crc32 and ids.

    A null or empty text is the end_id alone. Only documents longer than the capacity are cut, into pieces
    of it; the last may be shorter. Rows that repeat an id each give their pieces; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(lambda b: _pieces(b, file, capacity, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Bins:
    """At most open_bins open bins, by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.count = self.made = 0
        self.closed: set[int] = set()

    def _take(self, f: int) -> int:
        bins = self.by_free[f]
        b = bins.pop()
        if not bins:
            del self.by_free[f]
            self.free ^= 1 << f
        self.count -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of the next piece."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if self.count >= self.open_bins:
                self.closed.add(self._take((self.free & -self.free).bit_length() - 1))
            b, f = self.made, self.capacity
            self.made += 1
        left = f - length
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.free |= 1 << left
            self.count += 1
        else:
            self.closed.add(b)
        return b, self.capacity - f


def _pack(batches: Iterator[pa.RecordBatch], level: int, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """Each piece with its sequence and offset; open while its bin may still be packed better with other tasks' leftovers."""
    task = TaskContext.get().partitionId()
    base = (level << 56) | (task << 32)
    bins = Bins(capacity, open_bins if level == 0 else FAN_IN * open_bins)
    waiting: dict[int, list[tuple]] = {}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open", "task"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.int64()]
    ids_type = pa.list_(pa.int32())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        told = list(zip(*rows, strict=True))
        columns = [pa.array(x, k) for x, k in zip(told[:5] + told[6:], kinds, strict=True)]
        if told[5][0] is None:
            return pa.RecordBatch.from_arrays(columns, names)
        at = np.concatenate([[0], np.cumsum([len(x) for x in told[5]])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(told[5]), pa.int32()), type=ids_type)], [*names, "ids"])

    def placed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *piece, length, crc, ids in rows:
            b, at = bins.place(length)
            waiting.setdefault(b, []).append((*piece, length, crc, ids, base + b, at))
            for c in bins.closed:
                yield from ((*r, False, task) for r in waiting.pop(c))
            bins.closed.clear()
        emptiest = sorted(waiting, key=lambda b: sum(r[3] for r in waiting[b]))[:open_bins]
        still = set(emptiest)  # the open_bins bins with the most free space stay open
        for b in list(waiting):
            yield from ((*r, b in still, task) for r in waiting.pop(b))

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        ids = [None] * batch.num_rows
        if "ids" in batch.schema.names:  # copies, so that an open bin does not hold on to a whole batch
            ids = [x.values.to_numpy().copy() for x in batch.column("ids")]
        return list(zip(*(batch.column(n).to_pylist() for n in names[:5]), ids, strict=True))

    def longest_first() -> Iterator[tuple]:
        rows, tasks = [], set()
        for batch in batches:  # at most FAN_IN tasks' open bins
            rows += rows_of(batch)
            tasks |= set(batch.column("task").to_pylist())
        if len(tasks) > FAN_IN:
            raise RuntimeError(f"leftovers of {len(tasks)} tasks met in one, {FAN_IN} are the most")
        rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
        rows.reverse()
        while rows:  # a piece is let go once it is written
            yield rows.pop()

    ready, held = [], 0
    for row in placed(longest_first() if level else (r for batch in batches for r in rows_of(batch))):
        ready.append(row)
        held += row[3]
        if len(ready) >= 512 or held >= BATCH_IDS:
            yield out(ready)
            ready, held = [], 0
    if ready:
        yield out(ready)
    pa.default_memory_pool().release_unused()  # workers go on to other tasks


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, and ids if there) with a sequence_id and their offset in it, gapless from 0.

    A sequence's ids are those of its pieces by offset. No sequence is longer than capacity and no piece is cut. Which pieces share a sequence depends on how
    the input is split into tasks; every input row is in exactly one. An empty input gives no rows.
    """
    bounded_batches(pieces.sparkSession)
    ids = ["ids"] * ("ids" in pieces.columns)
    now = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *ids), "pieces")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, task long" + ", ids array<int>" * len(ids)
    done = None
    for level in itertools.count():  # each level has a FAN_IN-th of the tasks
        out = cut(now.mapInArrow(lambda b, level=level: _pack(b, level, capacity, open_bins), schema), "packed")
        last = level > 0 and out.select("task").distinct().limit(2).count() < 2
        part = out if last else out.where("not open")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = out.where("open")
        groups = (left.agg(F.max("task")).first()[0] or 0) // FAN_IN + 1
        now = left.repartitionById(groups, F.expr(f"cast(task div {FAN_IN} as int)"))
    return done.drop("open", "task")
