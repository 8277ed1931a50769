"""WARC archives: a deterministic sharded writer and a reader, as a Spark data source.

Records are range-sorted by id and payload digest, so shard k holds a contiguous range. The bounds of the shards
follow from the rows alone: how many there are from the bytes of all payloads, where they lie from the bytes at
a sample of ids and digests that a hash picks. So a second run writes the same files, whatever the session and
its tasks. A task writes its range as gzip members, one to a record, and begins a new file when the compressed
size reaches roll_bytes. Headers and digests are made anew from the payloads: Content-Length, HTTP
Content-Length, SHA-1 block and payload digests, and record ids and dates that depend on nothing but the record.
Tasks write under temporary names in a folder of their run; the commit renames the files of the attempts that
succeeded, writes a manifest with the bounds and removes the folder. Readers go by the manifest: files without
one are not part of an archive, and a folder that has one is never written again.

A record whose payload equals that of a smaller id is a revisit of it and holds no payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from orrery.llm.common import cut, fresh_path, small_or_not

#: Compressed bytes at which a file is closed and the next begun.
ROLL_BYTES = 256 << 20
MANIFEST = "manifest.json"
#: Bytes of payloads to a shard, shards at least where there are as many rows, and keys that the bounds are sought among.
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 32
BOUND_KEYS = 200_000
#: Files that are renamed at a time.
RENAMES = 16
#: Payloads that so many rows share, or a HOT_SHARE-th of all rows if that is more, are joined by broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 100_000
#: The date of all records, unless an option names another: archives don't depend on when they were written.
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the standard's URL name space
_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_text(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, serial: int, date: str = DATE) -> bytes:
    """One record, compressed as a gzip member of its own."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{serial}/{digest}')}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header_text(url)}"] if url is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: gzip framing, without a name or time
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, read member by member."""
    left = b""
    while True:
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            data = left or stream.read(chunk)
            left = b""
            if not data:
                if out:
                    raise ValueError("archive ends within a record")
                return
            out.append(member.decompress(data))
        left = member.unused_data
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record of another length than its header says")
        yield headers, rest[:size]


def _refuse_written(path: str) -> None:
    fs, root = _files(path.rstrip("/"))
    if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
        raise FileExistsError(f"{path} holds an archive already; it is neither appended to nor overwritten")


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    """Rows sorted by shard, page_id, digest and kind: a row of kind 0 says that page_id's payload of that digest revisits first."""

    def __init__(self, options: dict):
        self.run = f".writing-{uuid.uuid4().hex}"
        self.bounds = json.loads(options.get("bounds", "[]"))
        self.path, self.roll, self.date = options["path"].rstrip("/"), int(options.get("rollBytes", ROLL_BYTES)), options.get("date", DATE)
        self.least = int(options.get("leastBytes", 0))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _files(self.path)
        fs.create_dir(f"{root}/{self.run}", recursive=True)
        done: list[dict] = []
        out, entry, shard, rolled = None, {}, None, 0
        key, serial, revisits = object(), 0, None
        for batch in batches:
            for own, i, kind, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "kind", "url", "html", "digest", "first")), strict=True):
                if own != shard:
                    if out is not None:
                        out.close()
                        done.append(entry)
                    out, shard, rolled = None, own, 0
                if (i, digest) != key:
                    key, serial, revisits = (i, digest), 0, None
                if kind == 0:
                    revisits = first
                    continue
                payload = (html or "").encode()
                again = serial > 0 and len(payload) >= self.least
                data = record(i, url, payload, revisits if revisits is not None else i if again else None, revisits is not None or again, serial, self.date)
                serial += 1
                if out is None:
                    name = f"part-{shard:05d}-{rolled:05d}.warc.gz"
                    rolled += 1
                    sha = hashlib.sha256()
                    entry = {"name": name, "temporary": f"{self.run}/{name}.{attempt}-{uuid.uuid4().hex}", "shard": shard, "records": 0, "bytes": 0, "first": i}
                    out = fs.open_output_stream(f"{root}/{entry['temporary']}", compression=None)
                out.write(data)
                sha.update(data)
                entry["sha256"] = sha.hexdigest()
                entry["records"] += 1
                entry["bytes"] += len(data)
                entry["last"] = i
                if entry["bytes"] >= self.roll:
                    out.close()
                    done.append(entry)
                    out = None
        if out is not None:
            out.close()
            done.append(entry)
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Parts go to a folder named by what they hold, and the manifest that names it is put up last; a folder with a manifest is left as it is."""
        _refuse_written(self.path)
        fs, root = _files(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        told = [{k: v for k, v in f.items() if k != "temporary"} for f in files]
        folder = f"parts-{hashlib.sha256(json.dumps(told).encode()).hexdigest()[:16]}"
        for f in (f"{root}/{self.run}", *([f"{root}/{folder}"] if files else [])):
            fs.create_dir(f, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: fs.move(f"{root}/{f['temporary']}", f"{root}/{folder}/{f['name']}"), files))
        with fs.open_output_stream(f"{root}/{self.run}/{MANIFEST}") as out:
            out.write(json.dumps({"bounds": self.bounds, "folder": folder, "files": told}).encode())
        _refuse_written(self.path)  # another writer may have been quicker; its parts are in a folder of their own
        fs.move(f"{root}/{self.run}/{MANIFEST}", f"{root}/{MANIFEST}")
        fs.delete_dir(f"{root}/{self.run}")  # what attempts that failed have left goes too

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _files(self.path)
        try:
            fs.delete_dir(f"{root}/{self.run}")
        except FileNotFoundError:
            pass  # no task had begun


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        fs, root = _files(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            told = json.loads(f.read())
        return [InputPartition(f"{told['folder']}/{x['name']}") for x in told["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, root = _files(self.path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        rows, size = [], 0
        with fs.open_input_stream(f"{root}/{partition.value}", compression=None) as stream:
            for head, block in records_of(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(next(line.partition(b": ")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                if f"sha1:{base32_sha1(block)}" != head["warc-block-digest"] or not revisit and (len(payload), base32_sha1(payload)) != (length, digest):
                    raise ValueError(f"a record of {partition.value} does not agree with its digests")
                whole = lambda k, h=head: int(h[k]) if k in h else None
                rows.append((whole("x-page-id"), head.get("warc-target-uri"), head["warc-type"], length, digest, whole("x-refers-to-page-id"), None if revisit or not self.payload else payload))
                size += len(payload) if self.payload else 100
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WarcDataSource(DataSource):
    """format("orrery_warc"): options path, rollBytes and date to write, path and payload ("false" leaves it out) to read."""

    @classmethod
    def name(cls) -> str:
        return "orrery_warc"

    def schema(self) -> str:
        return _READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        _refuse_written(self.options["path"])
        return _Writer(self.options)


def shard_bounds(keys: DataFrame, shards: int) -> list[tuple[int | None, int]]:
    """The first key (page_id, d) of each shard but the first, that shards keys(page_id, d, bytes) evenly by bytes.

    At most some BOUND_KEYS keys, picked by a hash of them, are collected with their bytes; the same keys give
    the same bounds. A null page_id comes last.
    """
    if shards < 2:
        return []
    every = max(1, keys.count() // BOUND_KEYS)
    some = keys.where(F.pmod(F.xxhash64("page_id", "d"), F.lit(every)) == 0).groupBy("page_id", "d").agg(F.sum("bytes").alias("bytes"))
    rows = sorted(((r["page_id"], r["d"], r["bytes"]) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    before = np.cumsum([0, *(r[2] for r in rows)])[:-1]
    at = np.searchsorted(before, before[-1] / shards * np.arange(1, shards)) if rows else []
    return [rows[i][:2] for i in sorted(set(map(int, at)) - {0})]


def _shard_of(bounds: list[tuple[int | None, int]]):
    last, known = [d for i, d in bounds if i is None], [k for k in bounds if k[0] is not None]
    low = np.array(known, np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, null: pd.Series, d: pd.Series) -> pd.Series:
        i, d = page_id.to_numpy(np.int64), d.to_numpy(np.int64)
        begin, end = np.searchsorted(low[:, 0], i, "left"), np.searchsorted(low[:, 0], i, "right")
        found = begin.copy()  # bounds of smaller ids, and those of this id up to d
        for k in np.flatnonzero(end > begin).tolist():
            found[k] = begin[k] + np.searchsorted(low[begin[k] : end[k], 1], d[k], "right")
        return pd.Series(np.where(null, len(low) + np.searchsorted(np.array(last, np.int64), d, "right"), found))

    return shard(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNull(), F.col("d"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Write a record for each row of pages into archives under path.

    A null html is an empty payload; a null URL leaves the target URI out. Of records with equal payloads of
    least_bytes bytes at least, the one with the smallest id is the response, the others revisit it; rows that
    repeat an id and a payload revisit the first of them, in the order of their URLs. Rows without an id come
    after all others. Other columns are ignored. An empty table gives a manifest without files. A folder that
    holds an archive is refused with FileExistsError.
    """
    spark = pages.sparkSession
    _refuse_written(path)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("d")
    pages = pages.withColumn("digest", F.unhex(F.sha1("html")))
    keys = cut(pages.select("page_id", "digest", F.octet_length("html").cast("long").alias("bytes")), "keys")
    total = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    bounds = shard_bounds(keys.select("page_id", d, (F.col("bytes") + 500).alias("bytes")), max(min(LEAST_SHARDS, total["rows"]), -(-total["bytes"] // shard_bytes)))

    keys = keys.where(F.col("bytes") >= least_bytes).select("page_id", "digest")
    shared = cut(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    hot = max(HOT_ROWS, total["rows"] // HOT_SHARE)  # at most HOT_SHARE payloads are as frequent
    told = keys.join(F.broadcast(shared.where(F.col("n") >= hot).select("digest", F.struct("first").alias("hot"))), "digest", "left")
    rare = told.where("hot is null").select("page_id", "digest").join(small_or_not(shared.where(F.col("n") < hot).select("digest", "first")), "digest")
    revisits = told.where("hot is not null").select("page_id", "digest", "hot.first").unionByName(rare).where("not (page_id <=> first)").distinct()
    both = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", "digest", F.lit(None).cast("long").alias("first")).unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    )
    # revisit notes go before the records of their id and digest
    sharded = both.withColumn("d", d).withColumn("shard", _shard_of(bounds)).drop("d")
    ordered = sharded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "digest", "kind", "url")
    spark.dataSource.register(WarcDataSource)
    writer = ordered.write.format("orrery_warc").option("path", path).option("rollBytes", str(roll_bytes)).option("leastBytes", str(least_bytes))
    writer.option("bounds", json.dumps(bounds)).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under path that its manifest names; every digest is checked while reading."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("orrery_warc").option("path", path).option("payload", str(payload).lower()).load()


def written_and_read(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
