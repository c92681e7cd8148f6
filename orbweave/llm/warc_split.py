"""WARC archives: deduplicating writer, and a reader that splits files anywhere.

Every record is a gzip member of its own. A reading task gets a byte range of a file, looks for gzip magic in it, takes a
candidate for a record only if it decodes to a WARC header, a block of the stated length and a valid checksum, and is
followed by another member or the file's end; it owns the records that start inside its range, and reads on past its
end for the last of them. Writers put each task's records into files of their own and return them as rows; those rows,
stored once, are the list of files that count, so files of failed attempts are never read.

Null html is an empty payload, a null url leaves the target out. A null page_id stays null and is never the largest: such
a page revisits one with a page_id, and pages without one that share a payload among themselves alone are all responses.
Rows that repeat the largest page_id and its payload are each written as the response. Empty tables give no file. Extra columns are left out. A payload of
any length is one record, which the task that owns its start reads to its end.
Archives lie in any store that ``pyarrow.fs`` reaches; the schemes of Spark's paths are told to it by their own names
there. A task holds one range and one record in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.storage import new_dir, stored

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Schemes of Spark's paths by the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it. ``dbfs:/`` paths are the local mount of that store."""
    scheme, sep, rest = path.partition(":")
    if scheme == "dbfs" and sep:
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


def with_decisions(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest (hex), refers_to. Of the pages with equal payloads of ``least`` bytes or more, that
    with the largest page_id is kept, and the others refer to it. Pages of a payload that very many share are one skewed
    key of a join, which Spark splits as it runs."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    groups = pages.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 AND kept IS NOT NULL").select("digest", "kept"), "warc-groups")  # of a known size
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return pages.join(groups, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, which states the length of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str, *, least: int = 1000, level: int = 3, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per page below path, and returns the files: path, length, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        made, out, name, size, n = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                member = gzipped(record(row[0], row[1], row[2].encode(), row[3], row[4], date), level)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    made.append((f"{path}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{path}/{name}", size, n))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["path", "length", "records"])

    return stored(with_decisions(pages, least).mapInArrow(run, "path string, length long, records long"), "warc-files")


_MORE = 1 << 20


class Range:
    """A file's bytes from ``at`` on, read as far as asked."""

    def __init__(self, file: pa.NativeFile, at: int, size: int, length: int):
        self.file, self.at, self.length = file, at, length
        file.seek(at)
        self.data = bytearray(file.read(size))

    def more(self) -> bool:
        if self.at + len(self.data) >= self.length:
            return False
        self.file.seek(self.at + len(self.data))
        self.data += self.file.read(_MORE)
        return True

    def member(self, k: int) -> tuple[bytes, int] | None:
        """What the gzip member at k holds and where it ends, if a WARC record is in it."""
        z, out, checked = zlib.decompressobj(31), bytearray(), False
        try:
            while True:
                fed = bytes(self.data[k : k + 65536])
                out += z.decompress(fed)
                if not checked and len(out) >= 5:
                    if out[:5] != b"WARC/":
                        return None
                    checked = True
                k += len(fed) - len(z.unused_data)
                if z.eof:
                    break
                if k >= len(self.data) and not self.more():
                    return None
        except zlib.error:
            return None
        while len(self.data) < k + 3 and self.more():
            pass
        follows = bytes(self.data[k : k + 3])
        return (bytes(out), k) if checked and (not follows or follows == MAGIC) else None


def parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields by lower-case name, and the block."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n) + 4 or rest[int(n) :] != b"\r\n\r\n":
        return None
    return fields, rest[: int(n)]


def records_in(file: pa.NativeFile, start: int, stop: int, length: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, fields, block) of the records that start in [start, stop)."""
    r, k = Range(file, start, stop - start + 2, length), 0
    while True:
        k = r.data.find(MAGIC, k)
        if k < 0 or start + k >= stop:
            return
        got = r.member(k)
        record_ = parsed(got[0]) if got else None
        if record_ is None:
            k += 1
            continue
        yield start + k, got[1] - k, *record_
        k = got[1]


_ID = re.compile(r"<urn:page:(-?\d+)>")
SCHEMA = "path string, offset long, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def read(files: DataFrame, *, range_bytes: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """The records of the files (path, length): one row each. Digest and length of a response are those of the payload
    that was read; those of a revisit are from its headers."""
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    spark = files.sparkSession
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                store, name = opened(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, _, fields, block in records_in(file, start, min(start + range_bytes, length), length):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        ids = [int(m[1]) if (m := _ID.match(fields.get(f, ""))) else None for f in ("warc-record-id", "warc-refers-to")]
                        kind = fields.get("warc-type")
                        if kind == "revisit":
                            n, digest = int(stated[1]) if stated else None, base64.b32decode(fields.get("warc-payload-digest", "sha1:")[5:]).hex()
                        else:
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        row = (path, offset, kind, ids[0], fields.get("warc-target-uri"), n, digest, ids[1])
                        rows.append((*row, payload) if payloads else row)
                        held += len(payload) if payloads else 200
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    names = [c.split(" ")[0] for c in SCHEMA.split(", ")] + ["payload"] * payloads
    kinds = [pa.string() if "string" in c else pa.int64() for c in SCHEMA.split(", ")] + [pa.binary()] * payloads

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ranges.mapInArrow(run, SCHEMA + ", payload binary" * payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
"""
