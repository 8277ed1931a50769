"""BPE encoding and decoding, with tree concatenation for long texts.

A text of up to two leaves is encoded where it is read. A longer one is cut into halves, again and again,
down to leaves of LEAF characters that are dealt over the cluster and encoded there; then neighbours are
joined pair by pair, level by level. At each join the tokens near the cut may be wrong on both sides, so a
window around the cut is encoded anew, growing until both sides agree with it exactly:

* at each end of the window stands a letter before white space. The splitting pattern ends a word there
  whatever precedes it, so the tokens outside are those of the whole text; or
* the window is one unsplit run of letters and its encoding keeps the first token of the left side's and
  the last of the right side's part. All neighbouring tokens of the joined run are then neighbours in some
  right encoding, and a BPE encoding is right if all its neighbours are; or
* the window is all of both sides.

Leaves are encoded with the vocabulary's ranks and the public splitting pattern, which gives what the
tokenizer file itself gives with its own library (tests compare them).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orrery.llm.common import bounded_batches, text_batches

LEAF = 1 << 14
FIRST_WINDOW = 64
SPECIAL = "<|endoftext|>"
_BLANK = " \t\n\r"


class ByteBpe:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library; its one special string is its special token."""

    def __init__(self, file: str):
        import json

        import public_tokenizers
        import tiktoken

        spec = json.load(open(public_tokenizers.path(file)))
        bytes_of = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(bytes_of)]
        back = {chr(b): b for b in bytes_of} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}

    def encode(self, text: str) -> np.ndarray:
        """The ids of text; a special string in it is its special token."""
        if any(s in text for s in self._special):
            return np.array(self._bpe.encode(text, allowed_special=self._special, disallowed_special=()), np.uint32)
        return self._bpe.encode_to_numpy(text)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters, unknown ids nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def _tokens_in(self, ids: np.ndarray, size: int, step: int) -> int | None:
        """How many tokens from the end (step -1) or start (1) make size bytes; None if a token crosses."""
        got = n = 0
        at = len(ids) - 1 if step < 0 else 0
        while got < size and 0 <= at < len(ids):
            got += len(self.bytes_of[int(ids[at])])
            n, at = n + 1, at + step
        return n if got == size else None

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """Two neighbouring texts and their ids to one; the window grows until both sides agree."""
        (a, x), (b, y) = left, right
        size = FIRST_WINDOW
        while size < max(len(a), len(b)):
            from_, to = max(0, len(a) - size), min(len(b), size)
            p = next((i for i in range(from_ + 1, len(a)) if a[i] in _BLANK and a[i - 1].isalpha()), None) if from_ else 0
            q = next((i for i in range(to - 1, 0, -1) if b[i] in _BLANK and b[i - 1].isalpha()), None) if to < len(b) else len(b)
            if p is not None and q is not None:
                i, j = self._tokens_in(x, len(a[p:].encode()), -1), self._tokens_in(y, len(b[:q].encode()), 1)
                if i is not None and j is not None:
                    return a + b, np.concatenate([x[: len(x) - i], self.encode(a[p:] + b[:q]), y[j:]])
            joined = self._join_run(a, x, b, y, size)
            if joined is not None:
                return a + b, joined
            size *= 2
        return a + b, self.encode(a + b)

    def _join_run(self, a: str, x: np.ndarray, b: str, y: np.ndarray, size: int) -> np.ndarray | None:
        """The ids if the window is inside one run of letters on whole tokens, and keeps a token on either side."""
        i = j = 0
        s = t = b""
        while i < len(x) and len(s) < size:
            i += 1
            s = self.bytes_of[int(x[-i])] + s
        while j < len(y) and len(t) < size:
            t += self.bytes_of[int(y[j])]
            j += 1
        if i == len(x) or j == len(y) or i < 2 or j < 2:
            return None
        try:
            inside = (s + t).decode()
        except UnicodeDecodeError:
            return None
        if not inside.isalpha() or not a[-len(s.decode()) - 1 : len(a) - len(s.decode())].isalpha():
            return None
        new = self.encode(inside)
        if len(new) > 1 and new[0] == x[len(x) - i] and new[-1] == y[j - 1]:
            return np.concatenate([x[: len(x) - i], new, y[j:]])
        return None

    def concatenate(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The ids of all parts in order: neighbours are joined level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1]


@functools.lru_cache(4)
def byte_bpe(file: str) -> ByteBpe:
    return ByteBpe(file)


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Halves of halves of text, none longer than leaf."""
    if len(text) <= leaf:
        return [text]
    middle = len(text) // 2
    return leaves(text[:middle], leaf) + leaves(text[middle:], leaf)


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)))


def _encode_short(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(file)
    for batch in batches:
        for part in text_batches(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _id_lists([bpe.encode(t) for t in part.column("text").to_pylist()])], ["doc_id", "ids"])


def _halve(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_batches(batch):
            rows = [(d, hashlib.sha256(t.encode()).digest(), k, s) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for k, s in enumerate(leaves(t, leaf))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.string()), strict=True)], ["doc_id", "text_hash", "leaf", "text"])


def _encode_leaves(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(file)
    for batch in batches:
        for part in text_batches(batch):
            ids = [bpe.encode(t).astype("<u4").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "ids"])


def _concatenate(table: pa.Table, file: str) -> pa.Table:
    """The leaves of one text, in each of the rows that hold it."""
    rows = sorted(zip(table.column("leaf").to_pylist(), table.column("text").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda r: r[0])
    times = sum(r[0] == 0 for r in rows)
    ids = byte_bpe(file).concatenate([(t, np.frombuffer(i, "<u4")) for _, t, i in rows[::times]])
    return pa.table([pa.array([table.column("doc_id")[0].as_py()] * times, pa.int64()), _id_lists([ids] * times)], ["doc_id", "ids"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "byte_bpe_50k.json", leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs.

    A null text counts as empty and has no ids; rows that repeat an id or a text each give a row; other
    columns are ignored. The special string in a text becomes its special token, as in the file's library.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.char_length("text") > 2 * leaf
    short = docs.where(~long).mapInArrow(lambda b: _encode_short(b, file), "doc_id long, ids array<int>")
    cut = docs.where(long).mapInArrow(lambda b: _halve(b, leaf), "doc_id long, text_hash binary, leaf int, text string")
    spread = cut.repartition("doc_id", "text_hash", "leaf").mapInArrow(lambda b: _encode_leaves(b, file), "doc_id long, text_hash binary, leaf int, text string, ids binary")
    joined = spread.groupBy("doc_id", "text_hash").applyInArrow(lambda t: _concatenate(t, file), "doc_id long, ids array<int>")
    return short.unionByName(joined)


#: Rows that are turned into Python lists at a time.
ROWS = 64


def decode(encoded: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """encoded with the text of its column ids added as decoded; null ids give an empty text."""
    names = encoded.columns

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [bpe.decode(i.as_py() or []) for i in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(texts, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip_digests(docs: DataFrame, file: str = "byte_bpe_50k.json") -> DataFrame:
    """For each document the number of its ids and digests of them and of the text that they decode to, row by row."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(file)
        for batch in batches:
            n, told, text = [], [], []
            for row in batch.column("ids"):
                ids = row.as_py()
                n.append(len(ids))
                told.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, file=file).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
