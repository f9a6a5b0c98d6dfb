"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent zstd frames of about FRAME_BYTES. After the frames comes a skippable frame
with the record index (record identifier, frame, offset in the frame's content, length) and last the seek table
of the Zstandard seekable format, also a skippable frame. So any zstd tool can unpack a bundle, and a reader gets
one record with three reads: the footer, the index, the record's frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SALTS, arrow_batches, cut, filesystem, lookup, publish, table, texts, work_dir

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Content of a frame, and frames' bytes in a bundle, after which the next begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
#: Fixed values of the Zstandard seekable format and of skippable frames.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the WARC profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: object) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of the page refers_to without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    fields.append(("X-Payload-Length", str(len(payload))))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record, checked against its lengths and, for responses, its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong length")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong digest")
    return fields, payload


class Writer:
    """Collects records into a bundle; bytes() gives the file."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.content, self.held, self.size = [], 0, 0
        self.index: list[tuple[str, int, int, int]] = []
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.table), self.held, len(data)))
        self.content.append(data)
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.content:
            raw = b"".join(self.content)
            self.frames.append(self.zstd.compress(raw))
            self.table.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(self.frames[-1])
            self.content, self.held = [], 0

    def bytes(self) -> bytes:
        self._close()
        names, frames, offsets, sizes = zip(*self.index, strict=True) if self.index else ((), (), (), ())
        rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["record_id", "frame", "offset", "length"])
        stream = io.BytesIO()
        with pa.ipc.new_stream(stream, rows.schema) as out:
            out.write_batch(rows)
        index = self.zstd.compress(stream.getvalue())
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = [*self.table, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        seek = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
        return b"".join([*self.frames, index, struct.pack("<II", SKIPPABLE_SEEK, len(seek)), seek])


class Bundle:
    """A bundle in any store that pyarrow opens; reads only what is asked for."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        width = 12 if descriptor & 0x80 else 8
        raw = self._read(end - 9 - n * width, n * width)
        self.table = [struct.unpack_from("<III" if width == 12 else "<II", raw, k * width) for k in range(n)]
        self.starts, at = [], 0
        for x in self.table:
            self.starts.append(at)
            at += x[0]
        rows = zstandard.ZstdDecompressor().decompress(self._read(self.starts[-1] + 8, self.table[-1][0] - 8))
        self.index = pa.ipc.open_stream(rows).read_next_batch()
        self._places: dict[str, int] | None = None

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        """The content of frame k, checked against the seek table."""
        raw = zstandard.ZstdDecompressor().decompress(self._read(self.starts[k], self.table[k][0]))
        if len(raw) != self.table[k][1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k][2]:
            raise ValueError(f"frame {k} doesn't match the seek table")
        return raw

    def record(self, name: str) -> bytes:
        """One record by its identifier, unpacking its frame only. Of records that share it, the last."""
        if self._places is None:
            self._places = {x: k for k, x in enumerate(self.index.column(0).to_pylist())}
        _, k, offset, size = (c[self._places[name]].as_py() for c in self.index.columns)
        return self.frame(k)[offset : offset + size]

    def records(self) -> Iterator[bytes]:
        """All records in order, a frame in memory at a time."""
        last, raw = -1, b""
        for k, offset, size in zip(*(self.index.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            if k != last:
                last, raw = k, self.frame(k)
            yield raw[offset : offset + size]


def write_bundles(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages' records; returns one row a bundle: path, n_records, n_bytes.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id is the response and
    the others are revisits of it; smaller payloads are always responses. A null html is an empty payload, a null
    url is left out. A page with a null page_id is never referred to; it becomes a revisit if an equal payload has
    an identifier. Rows that repeat the identifier that stays are all responses. Payloads stay where they are read:
    only digests are grouped, and the groups of two or more are looked up (broadcast if few, by count, else by a
    salted join). A lost task's bundle is written again under the same name. An empty table gives no bundle."""
    spark = pages.sparkSession
    arrow_batches(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= LEAST_REVISIT, F.unhex(F.sha2("html", 256))))
    groups = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    found = lookup(rows, cut(groups.where("n > 1").select("key", "keep"), "groups"), "key", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    found = found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, writer = TaskContext.get().partitionId(), 0, Writer()

        def flush() -> pa.RecordBatch:
            name, data = f"{folder}/bundle-{part:06d}-{seq:06d}.warc.zst", writer.bytes()
            publish(name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.index)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "n_records", "n_bytes"])

        for batch in batches:
            for page, link, payload, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                writer.add(record_id(page), record(page, link, payload, refers))
                if writer.size >= BUNDLE_BYTES:
                    yield flush()
                    writer, seq = Writer(), seq + 1
        if writer.index:
            yield flush()

    return cut(found.mapInArrow(write, "path string, n_records long, n_bytes long"))


_PAGE = re.compile(r"<urn:page:(.*)>")


def _page(name: str | None) -> int | None:
    page = _PAGE.fullmatch(name)[1] if name else "null"
    return None if page == "null" else int(page)


def read_bundles(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex SHA-1), record_type and refers_to of each record; bytes and
    digest are of the full payload, for revisits from the record's fields. Identifiers are integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in Bundle(path).records():
                    fields, _ = parsed(data)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    paths = index.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return read_bundles(index).drop("url")


def oracle() -> str:
    return """
    WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages
    ), s AS (SELECT page_id, octet_length(b) AS n, d, max(page_id) OVER (PARTITION BY b) AS keep FROM t)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
        CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
    FROM s
    """
