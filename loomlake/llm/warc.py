"""WARC archives: records written from rows, and read back as a table of chunks.

Archives are gzip files with one member for each record, written straight to the shared folder; the manifest, a written
table, lists segments of archives, so only files of tasks that ended well count. The reader streams a segment
and gives one row for each chunk of a payload, with the size and the digest up to there, and never holds a whole record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, new_path, small

#: Payloads of fewer bytes are always responses.
LEAST = 100
CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no bigint, data binary, payload_bytes bigint, payload_digest string, last boolean"


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, digest, first: rows whose payload of LEAST bytes or more belongs to a smaller page_id as well."""
    payload = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    rows = cut(pages.select(pages[id_col].cast("bigint").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(f"n >= {LEAST} and page_id is not null").select("page_id", "digest"), "payloads")
    heads = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("most")).filter("first <> most").select("_digest", "first")
    heads = small(cut(heads, "payload-heads"))  # a payload that very many pages share is then not in one task
    return cut(rows.join(heads, F.col("digest") == F.col("_digest")).filter("page_id <> first").select("page_id", "digest", "first").distinct(), "revisits")


def _store(uri: str):
    """The file system of a URI, and the path in it. Stores that Arrow doesn't reach are an error, on the driver already."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "file": "file", "s3": "s3", "abfss": "abfss", "abfs": "abfs"}
    if mark and scheme not in known:
        raise ValueError(f"archives can't be kept in {scheme}://; known: {', '.join(known)}")
    return fs.FileSystem.from_uri(f"{known[scheme]}://{rest}" if mark else uri)


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _head(page: int | None, url: str | None, digest: str, size: int, first: int | None) -> tuple[bytes, int]:
    """The record up to its payload, and the bytes of its block before that."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if first is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, len(http)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for every row; the manifest: path, begin, length and records of each segment, as a written table.

    A null payload is empty. Of rows with equal payloads of LEAST bytes or more, those with the smallest page_id are
    responses and others revisit it; a row without page_id is a response, and so are rows that repeat the first one.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    _store(folder)
    seen = revisits(pages, id_col, payload_col).withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest")
    payload = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(seen, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, done, segments, begin, count = None, "", 0, [], 0, 0
        for batch in batches:
            for page, url, payload, digest, first in zip(*(batch.column(i) for i in range(5))):
                page, url, digest, first = page.as_py(), url.as_py(), digest.as_py(), first.as_py()
                data = memoryview(payload.as_buffer())
                if out is None:
                    store, top = _store(folder)
                    store.create_dir(top, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{top}/{name}", compression=None)
                head, _ = _head(page, url, digest, len(data), first)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                parts = [head] if first is not None else [head, *(data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES))]
                for part in [*parts, b"\r\n\r\n"]:
                    if packed := packer.compress(part):
                        out.write(packed)
                        done += len(packed)
                packed = packer.flush()
                out.write(packed)
                done, count = done + len(packed), count + 1
                if done - begin >= SEGMENT_BYTES:
                    segments.append((path, begin, done - begin, count))
                    begin, count = done, 0
        if out is not None:
            out.close()
            if count:
                segments.append((path, begin, done - begin, count))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in segments], t) for i, t in enumerate(kinds)], names=["path", "begin", "length", "records"])

    return cut(rows.mapInArrow(run, "path string, begin bigint, length bigint, records bigint"), "warc-manifest")


class _Stream:
    """The unpacked bytes of gzip members in a row, read piece by piece."""

    def __init__(self, source, length: int):
        self.source, self.left, self.packed, self.open = source, length, b"", zlib.decompressobj(31)
        self.held = b""

    def _more(self) -> bool:
        if not self.packed:
            if not self.left:
                return False
            self.packed = self.source.read(min(self.left, 1 << 18))
            self.left -= len(self.packed)
            if not self.packed:
                raise EOFError("an archive is shorter than its manifest says")
        if self.open.eof:
            self.open = zlib.decompressobj(31)
        self.held += self.open.decompress(self.packed, CHUNK_BYTES)
        self.packed = self.open.unused_data if self.open.eof else self.open.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which goes as well; none at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise EOFError("an archive ends within a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise EOFError("an archive ends within a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def _chunks(stream: _Stream) -> Iterator[tuple]:
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        block = int(warc["content-length"])
        http_head = stream.until(b"\r\n\r\n")
        left = block - len(http_head) - 4
        said = warc["warc-payload-digest"].removeprefix("sha256:")
        page, refers = (int(warc[k]) if k in warc else None for k in ("x-page-id", "x-refers-to-page-id"))
        base = (warc["warc-record-id"], page, warc["warc-type"], refers)
        if warc["warc-type"] == "revisit":
            yield (*base, 0, b"", int(_fields(http_head)["content-length"]), said, True)
        else:
            digest, size, number = hashlib.sha256(), 0, 0
            while True:
                data = stream.read(min(left, CHUNK_BYTES))
                left -= len(data)
                size += len(data)
                digest.update(data)
                if not left and digest.hexdigest() != said:
                    raise ValueError(f"the payload of {base[0]} differs from its digest")
                yield (*base, number, data, size, digest.hexdigest(), not left)
                number += 1
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"no end of record after {base[0]}")


def read_chunks(manifest: DataFrame) -> DataFrame:
    """One row for each chunk: record_id, page_id, record_type, refers_to, chunk_no, data, payload_bytes and payload_digest up to and with it, last.

    A revisit has one empty chunk, with the size and the digest of the payload that it refers to; so has an empty payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in CHUNKS.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                rows, total = [], 0
                with store.open_input_file(path) as source:
                    source.seek(row["begin"])
                    for chunk in _chunks(_Stream(source, row["length"])):
                        rows.append(chunk)
                        total += len(chunk[5]) + 200
                        if total >= BATCH_BYTES:
                            yield pack(rows)
                            rows, total = [], 0
                yield pack(rows)

    segments = manifest.count()
    return manifest.select("path", "begin", "length").repartition(max(1, min(segments, 10_000))).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, from archives written and read back.

    Repeated rows give a record each, null ids stay null, an empty table gives none; other columns are not read.
    """
    chunks = read_chunks(write_archives(pages, **columns))
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= {LEAST} and page_id is not null then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
case when first <> page_id then first end as refers_to from f"""
