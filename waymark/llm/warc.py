"""WARC archives: tasks write records and an index of their places, and selected records come back as coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrays import local_path
from waymark.llm.text import slices
from waymark.session import cut, scratch_folder

GAP, READ_BYTES = 1 << 16, 1 << 23  # bytes between records that are read over, and bytes of one read
FILE_BYTES = 1 << 30  # of an archive, after which a task begins another
LEVEL = 1  # of gzip
VERSION, LINE = b"WARC/1.1", b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id {kind}, record_id string, record_type string, url string, digest string, file string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records -----------------------------------------------------------------------------------------------------------


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{name}: {value}".encode() for name, value in headers if value is not None], f"Content-Length: {len(block)}".encode()]
    return LINE.join([*lines, b"", block, b"", b""])


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(LINE + LINE)
    first, *lines = head.split(LINE)
    if first != VERSION:
        raise ValueError(f"no record of {VERSION.decode()} at this place: {first[:40]!r}")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def _address(url: str | None) -> str | None:
    """A url as a header value: one line without blanks, from which ``unquote`` gives the url back."""
    return None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=-._~")


def page_record(record_id: str, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A response with the payload, or with ``first`` a revisit of that record without it."""
    kind, profile = ("response", None) if first is None else ("revisit", _REVISIT)
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _address(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", profile), ("WARC-Refers-To", first and f"<{first}>"), ("Content-Type", "application/http;msgtype=response"),
    ]
    status = b"HTTP/1.1 200 OK" + LINE + b"Content-Type: text/html; charset=utf-8" + LINE
    body = status + b"Content-Length: " + str(len(payload)).encode() + LINE + LINE
    return _record(headers, body + payload if first is None else body)


def _header(record_id: str, date: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1" + LINE)


# ---- files of the shared folder ----------------------------------------------------------------------------------------


@contextmanager
def _writing(uri: str):
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "xb") as out:
            yield out
        return
    system, name = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name) as out:
        yield out


@contextmanager
def _reading(uri: str):
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as source:
            yield source
        return
    system, name = fs.FileSystem.from_uri(uri)
    with system.open_input_file(name) as source:
        yield source


# ---- write -------------------------------------------------------------------------------------------------------------


def _numbered(pages: DataFrame) -> DataFrame:
    """Each row with a record number of its own, its payload's digest and size. Written, so that the numbers stay."""
    kind = dict(pages.dtypes)["page_id"]
    asked = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 256, 1 << 23):
                rows = pa.array(range(n, n + part.num_rows), pa.int64())
                n += part.num_rows
                digests = [payload_digest(b) for b in part.column(2).to_pylist()]
                tasks = pa.array([task] * part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, tasks, rows, pa.array(digests, pa.string())], ["page_id", "url", "body", "task", "row", "digest"])

    return asked.mapInArrow(number, f"page_id {kind}, url string, body binary, task int, row long, digest string")


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into archives and return their index:
    (page_id, record_id, record_type, url, digest, file, offset, length).

    The payload is the html in UTF-8, empty where it is null. Of the rows of an equal payload of ``min_bytes`` bytes or more the one with the largest
    page_id is a response (of repeated ids one of them, a null id is smaller than all) and the others revisit it; shorter ones are all responses. Records are
    gzip members of their own, in files under ``folder`` (by default a new one of the shared folder). A task that runs
    twice writes other files; only those of the attempt that counts are in the index. A digest's winner comes from an aggregate, so copies never meet in one task.
    Other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch_folder(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    rows = cut(_numbered(pages))
    place = F.struct("page_id", "task", "row")
    shared = rows.where(F.octet_length("body") >= min_bytes).groupBy("digest").agg(F.max(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # written first: where few payloads repeat, its size is known to be small and the pages join it where they lie
    revisited = cut(shared.select("digest", F.col("first.task").alias("f_task"), F.col("first.row").alias("f_row")))
    copies = F.col("f_task").isNotNull() & (F.octet_length("body") >= min_bytes) & ((F.col("f_task") != F.col("task")) | (F.col("f_row") != F.col("row")))
    typed = rows.join(revisited, "digest", "left").withColumn("revisit", copies)
    asked = typed.select("page_id", "url", F.when(~F.col("revisit"), F.col("body")).alias("body"), F.octet_length("body").alias("size"), "task", "row", "digest", *[F.when(F.col("revisit"), F.col(c)).alias(c) for c in ("f_task", "f_row")])
    space = uuid.uuid4()

    def name(task: int, row: int) -> str:
        return f"urn:uuid:{uuid.uuid5(space, f'{task}:{row}')}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, files = TaskContext.get(), 0
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None:
            uri = f"{folder}/{context.partitionId():06d}-{files:04d}-{uuid.uuid4().hex}.warc.gz"
            files += 1
            with _writing(uri) as out:
                member = gzip.compress(_header(f"urn:uuid:{uuid.uuid4()}", date), LEVEL, mtime=0)
                out.write(member)
                at = begun = len(member)
                while batch is not None and (at == begun or at < FILE_BYTES):
                    for part in slices(batch, 256, 1 << 23):
                        index = {c: [] for c in ("record_id", "record_type", "offset", "length")}
                        columns = [part.column(c).to_pylist() for c in ("url", "body", "task", "row", "digest", "f_task", "f_row")]
                        for url, body, task, row, digest, f_task, f_row in zip(*columns, strict=True):
                            first = None if f_task is None else name(f_task, f_row)
                            member = gzip.compress(page_record(name(task, row), url, body or b"", digest, first, date), LEVEL, mtime=0)
                            out.write(member)
                            for c, value in zip(index, (name(task, row), "response" if first is None else "revisit", at, len(member)), strict=True):
                                index[c].append(value)
                            at += len(member)
                        n = part.num_rows
                        made = [part.column("page_id"), pa.array(index["record_id"], pa.string()), pa.array(index["record_type"], pa.string()), part.column("url"), part.column("digest"), pa.array([uri] * n, pa.string())]
                        made += [pa.array(index["offset"], pa.int64()), pa.array(index["length"], pa.int64())]
                        yield pa.RecordBatch.from_arrays(made, ["page_id", "record_id", "record_type", "url", "digest", "file", "offset", "length"])
                    batch = next(batches, None)

    return cut(asked.mapInArrow(store, _INDEX.format(kind=kind)))


# ---- read --------------------------------------------------------------------------------------------------------------


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, numbers of the places in it) of sorted (offset, length): neighbours at most ``gap`` bytes apart are one
    read of at most ``most`` bytes, a longer record one of its own."""
    found: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(places):
        end = offset + length
        if found and offset - found[-1][1] <= gap and max(end, found[-1][1]) - found[-1][0] <= most:
            start, last, held = found[-1]
            held.append(i)
            found[-1] = (start, max(end, last), held)
        else:
            found.append((offset, end, [i]))
    return found


def read(selected: DataFrame, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of the selected rows of an index: its page_id and (record_id, record_type, url, digest, refers_to, payload).

    Places are range-partitioned by file and offset and sorted, so a task reads its files forwards in few reads of
    neighbouring records, and a large file is spread over tasks. All but page_id comes from the records. ``refers_to``
    is the record a revisit refers to; its own payload is null. A response whose payload has not its digest is an error. A repeated row is read again.
    """
    kind = dict(selected.dtypes)["page_id"]
    ordered = selected.select("page_id", "file", "offset", "length").repartitionByRange(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset").sortWithinPartitions("file", "offset")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_pylist()
            cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                places = list(zip(part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True))
                with _reading(files[start]) as source:
                    for first, last, rows in ranges(places, gap, most):
                        source.seek(first)
                        block = source.read(last - first)
                        out = [_row(gzip.decompress(block[places[i][0] - first : sum(places[i]) - first])) for i in rows]
                        made = pa.RecordBatch.from_pylist(out, schema=schema)
                        yield pa.RecordBatch.from_arrays([part.column("page_id").take(pa.array(rows, pa.int64())), *made.columns], ["page_id", *schema.names])

    return ordered.mapInArrow(fetch, f"page_id {kind}, record_id string, record_type string, url string, digest string, refers_to string, payload binary")


def _row(record: bytes) -> dict:
    headers, block = _parse(record)
    url, first = headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To")
    found = {
        "record_id": headers["WARC-Record-ID"][1:-1], "record_type": headers["WARC-Type"], "url": None if url is None else unquote(url),
        "digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": first and first[1:-1], "payload": None,
    }
    if found["record_type"] == "response":
        found["payload"] = block.partition(LINE + LINE)[2]
        if payload_digest(found["payload"]) != found["digest"]:
            raise ValueError(f"payload of {found['record_id']} differs from its digest")
    return found


def resolved(records: DataFrame) -> DataFrame:
    """Per record that was read (page_id, payload_bytes, payload_digest, record_type, refers_to), a revisit's size and
    page_id of what it refers to taken from that response, which must be among the records."""
    narrow = cut(records.select("page_id", "record_id", "record_type", "digest", F.col("refers_to").alias("first"), F.octet_length("payload").cast("long").alias("bytes")))
    responses = narrow.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("first"), F.col("page_id").alias("f_page"), F.col("bytes").alias("f_bytes"))
    kind = dict(narrow.dtypes)["page_id"]
    whole = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = narrow.where("record_type = 'revisit'").drop("bytes").join(targets, "first", "left")
    return whole.unionByName(again.select("page_id", F.col("f_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("f_page").alias("refers_to")))
