"""Operator 3: WARC archives, and a normaliser for archives that are one gzip stream.

`write_archives` writes a record a page; a payload of at least `MIN_PAYLOAD` bytes
that equals an earlier page's is a revisit record, which has the headers only. An
archive of its is one gzip stream, so that nothing inside can be reached alone.
`normalise` inflates each such stream once, in steps of fixed size, and rewrites
every record as a gzip member of its own, beside a sidecar that lists each
record's offset, length and kind. `read_archives` seeks records by the sidecar.

Each file is one task's. A task writes under a name of its own attempt, and only
names in the written table of files count, so a lost executor's task runs again
without harm. Steps hold one record at a time.

Results: a null payload is the empty payload, and is always a response; rows that
repeat the smallest id with its payload are responses too, and rows equal in id
and payload share a record id; a null url is an empty target; null ids are written as such and come back as null, and don't count as smallest; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.shared import batches_of, by_bytes, shared_dir, text_of

MIN_PAYLOAD = 100
#: Pages that a task takes at once.
ROWS = 256
STEP = 1 << 20
_END = b"\r\n\r\n"


def first_copies(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to): refers_to is the smallest id with the same payload, null if it is the row's own or the payload is short."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), text_of(url).alias("url"), F.encode(text_of(payload), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Copies are counted from digests alone; only digests that repeat are joined, and Spark can split a very common one.
    repeated = rows.where(F.octet_length("payload") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(repeated, "digest", "left")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit with the headers only."""
    # The digest tells records of one id apart; the page that a revisit refers to has the same payload.
    name = lambda i: f"urn:page:{digest}:{'null' if i is None else i}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name(page_id)}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"])).encode() + _END + block + _END


def parse(data: bytes) -> dict:
    """What a record says of its page; a response's digest and length are those of the payload it holds."""
    head, _, block = data.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    number = lambda x: None if x.endswith(":null>") else int(x.rpartition(":")[2].rstrip(">"))
    kind = fields["WARC-Type"]
    announced = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": len(payload) if kind == "response" else announced, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream that comes in chunks, one held at a time."""
    data = bytearray()
    for chunk in chunks:
        data += chunk
        while (end := data.find(_END)) >= 0:
            length = int(bytes(data[:end]).lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
            whole = end + len(_END) + length + len(_END)
            if len(data) < whole:
                break
            yield bytes(data[:whole])
            del data[:whole]
    if data.strip():
        raise ValueError("the archive ends inside a record")


def inflated(source, step: int = STEP) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of at most `step` bytes; a member that doesn't end is an error."""
    inflate, begun = zlib.decompressobj(31), False
    while data := source.read(step):
        while data:
            begun = True
            yield inflate.decompress(data, step)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("the archive ends inside a gzip member")


def _per_file(files: DataFrame, work: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Does `work` on each row of a table of files, a task for each few."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (x for batch in batches for x in batch.to_pylist()):
            rows = []
            for row in work(file):
                rows.append(row)
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # As many places as files, given by number: else Spark would gather these few small rows in one task.
    return files.repartitionByRange(max(1, files.count()), "path").mapInArrow(run, schema)


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes rows of `first_copies` as archives of one gzip stream each; returns the table of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(f"{folder}/monolithic")
        store.create_dir(base, recursive=True)
        path, out, n = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        squeeze = zlib.compressobj(level, wbits=31)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            out = out or store.open_output_stream(path, compression=None)
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out.write(squeeze.compress(record(page_id, url, payload, digest, refers_to)))
                n += 1
        if out:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n": n}], schema=pa.schema([("path", pa.string()), ("n", pa.int64())]))

    slim = rows.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    with batches_of(rows.sparkSession, ROWS):
        slim.mapInArrow(run, "path string, n long").write.parquet(f"{folder}/written")
    return rows.sparkSession.read.schema("path string, n long").parquet(f"{folder}/written")


def normalise(files: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrites archives with a gzip member for each record, and a sidecar `.idx` of lines: offset, length, kind; returns the table of files."""

    def work(file: dict) -> Iterator[dict]:
        store, base = fs.FileSystem.from_uri(f"{folder}/members")
        store.create_dir(base, recursive=True)
        path, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_input_stream(file["path"], compression=None) as source, store.open_output_stream(path, compression=None) as out, store.open_output_stream(f"{path}.idx") as index:
            for data in records_of(inflated(source)):
                squeeze = zlib.compressobj(level, wbits=31)
                member = squeeze.compress(data) + squeeze.flush()
                out.write(member)
                kind = data[: data.index(_END)].partition(b"WARC-Type: ")[2].split(b"\r\n")[0]
                index.write(b"%d\t%d\t%s\n" % (offset, len(member), kind))
                offset += len(member)
        yield {"path": path, "n": file["n"]}

    _per_file(files, work, "path string, n long").write.parquet(f"{folder}/normalised")
    return files.sparkSession.read.schema("path string, n long").parquet(f"{folder}/normalised")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives, found by the sidecar's offsets."""

    def work(file: dict) -> Iterator[dict]:
        store, _ = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{file['path']}.idx") as index, store.open_input_file(file["path"]) as source:
            for line in index.read().splitlines():
                offset, length, _ = line.split(b"\t")
                source.seek(int(offset))
                yield parse(zlib.decompress(source.read(int(length)), 31))

    return _per_file(files, work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives `pages`, normalises the archives and reads them back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(first_copies(pages), folder), folder), folder)
