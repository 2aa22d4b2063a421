"""Operator 3: a sharded WARC archive whose files are the same on every run.

Records are range-sorted by page id, each is a gzip member of its own, files roll by
compressed size and appear by renaming, and a manifest names what belongs to the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .shared import commit, file_system, small_batches, stored

# Fixed value: the profile of the WARC standard for repeated payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TASK_BYTES = 32 << 20
FILE_BYTES = 16 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; all lengths and digests are made from the payload itself.

    A revisit keeps the HTTP head, which tells the payload's length, and no payload.
    """
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed stream; digests are checked."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:20]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != head["WARC-Block-Digest"]:
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
        yield head, block


def repeats(pages: DataFrame) -> DataFrame:
    """(key, digest, first) of every page whose payload an earlier page has.

    Only ids and digests are shuffled. A payload that a third of all pages share meets in
    its minimum by partial aggregates; the minima are stored, so that the join has
    shuffles of its own and AQE splits its partition.
    """
    ids = pages.select("key", F.sha1("body").alias("digest")).where("key is not null")
    firsts = ids.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    firsts = stored(firsts.drop("last"), "warc-firsts")
    return ids.join(firsts, "digest").where("key > first").select("key", "digest", "first")


def write_warc(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", body_column: str = "html") -> DataFrame:
    """Write one record per page and return the manifest: file, records, bytes, sha256.

    Of pages with equal payloads those with the smallest id are responses and the others
    revisits of it. A null body is an empty payload; a null id is written first and always
    a response; a null URL has no target header; repeated rows are repeated records; an
    empty table gives an empty manifest. Other columns do not take part.
    """
    small_batches(pages.sparkSession)
    source = pages.select(pages[id_column].cast("bigint").alias("key"), pages[url_column].alias("url"), F.coalesce(pages[body_column], F.lit("")).alias("body"))
    marks = stored(repeats(source), "warc-revisits")
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    # A mark sorts before the pages it is about, so one shuffle of the bodies does.
    rows = source.select("key", F.sha1("body").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("first"), "url", "body").unionByName(
        marks.select("key", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit("").alias("body"))
    )
    ordered = rows.repartitionByRange(max(1, -(-size // TASK_BYTES)), "key").sortWithinPartitions("key", "digest", "kind", "url")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, place = file_system(folder)
        part, rolled, held, size, marked = TaskContext.get().partitionId(), 0, [], 0, None

        def flush():
            name = f"pages-{part:06d}-{rolled:04d}.warc.gz"
            commit(fs, place, name, held)
            digest = hashlib.sha256()
            for member in held:
                digest.update(member)
            return pa.RecordBatch.from_pylist([{"file": name, "records": len(held), "bytes": size, "sha256": digest.hexdigest()}])

        for batch in batches:
            keys, digests, kinds, firsts, urls = (batch.column(i).to_pylist() for i in range(5))
            for i, body in enumerate(batch.column(5)):
                if kinds[i] == 0:
                    marked = keys[i], digests[i], firsts[i]
                    continue
                refers = marked[2] if marked and marked[:2] == (keys[i], digests[i]) else None
                held.append(gzip_member(make_record(keys[i], urls[i], body.as_py().encode(), refers)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    rolled, held, size = rolled + 1, [], 0
        if held:
            yield flush()

    manifest = stored(ordered.mapInArrow(run, "file string, records bigint, bytes bigint, sha256 string"), "warc-manifest")
    lines = (json.dumps(r.asDict()).encode() + b"\n" for r in manifest.orderBy("file").toLocalIterator())
    commit(fs, place, "manifest.jsonl", lines)
    return manifest


def read_warc(manifest: DataFrame, folder: str, id_column: str = "page_id") -> DataFrame:
    """Read the manifest's files in parallel: id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payloads are hashed anew and must agree with their headers.
    """
    count = max(1, manifest.count())
    small_batches(manifest.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        fs, place = file_system(folder)
        kind = pa.schema([(id_column, pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def number(urn: str | None):
            return int(urn[len("<urn:x-page:") : -1]) if urn and urn != record_id(None) else None

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(posixpath.join(place, file)) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (size != len(payload) or base32_sha1(payload) != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), None if revisit else payload))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    schema = f"{id_column} bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return manifest.select("file").repartition(count, "file").mapInArrow(run, schema)


def archive_digests(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as WARC files, read them back, and tell what was found, without payloads."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder).drop("payload", "url")
