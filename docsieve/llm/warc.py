"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records, and a skippable frame with the seek table of the seekable
format at its end. An index maps each record to bundle, frame and offset inside the frame, so one record costs one frame to read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import saved

#: Bytes of records per frame and of frames per bundle, after which the next one begins.
FRAME = 1 << 20
BUNDLE = 1 << 28
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
_FOOTER, _FOOTER_BYTES = "<IBI", 9
_ENTRY, _ENTRY_BYTES = "<II", 8
#: Copy groups up to this many are sent to every task, at about 100 bytes each; above, Spark joins them by shuffle.
BROADCAST_GROUPS = 100_000
#: Date of every record: a bundle depends on its records alone.
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame long, frame_start long, frame_bytes long, record_start long, record_bytes long"


def record_bytes(record_id: str, kind: str, url: str, payload: bytes, digest: str, page_id: int | None, refers_to: int | None) -> bytes:
    """One record. The block is an HTTP response head, whose Content-Length is the payload's size, and for responses the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.split()) or "urn:none",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(fields, payload size as the HTTP head says, payload as far as it is held)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, size, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, uncompressed) bytes of each frame, to be read from the end of the file."""
    entries = b"".join(struct.pack(_ENTRY, *frame) for frame in frames)
    body = entries + struct.pack(_FOOTER, len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Frames of a bundle from its last bytes; more than the table may be given."""
    count, flags, magic = struct.unpack(_FOOTER, tail[-_FOOTER_BYTES:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table without checksums at the end")
    start = len(tail) - _FOOTER_BYTES - count * _ENTRY_BYTES
    return [struct.unpack_from(_ENTRY, tail, start + i * _ENTRY_BYTES) for i in range(count)]


class BundleWriter:
    """Writes records to one bundle after the other. A bundle gets its name when it is whole, so a lost task leaves none half written."""

    def __init__(self, folder: str, frame: int, bundle: int, level: int):
        import zstandard
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.limits = folder, (frame, bundle)
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.out = None

    def _open(self) -> None:
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}.part")
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.ids: list[tuple[str, int | None]] = []
        self.size = self.written = 0

    def add(self, record_id: str, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record filled, if it did."""
        if self.out is None:
            self._open()
        self.held.append(record)
        self.ids.append((record_id, page_id))
        self.size += len(record)
        if self.size < self.limits[0]:
            return []
        rows = self._frame()
        if self.written >= self.limits[1]:
            self.close()
        return rows

    def _frame(self) -> list[tuple]:
        data = self.compress(b"".join(self.held))
        self.out.write(data)
        rows, at = [], 0
        for (record_id, page_id), record in zip(self.ids, self.held):
            rows.append((record_id, page_id, f"{self.uri}/{self.name}", len(self.frames), self.written, len(data), at, len(record)))
            at += len(record)
        self.frames.append((len(data), self.size))
        self.written += len(data)
        self.held, self.ids, self.size = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        rows = self._frame() if self.held else []
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.out = None
        self.fs.move(f"{self.folder}/{self.name}.part", f"{self.folder}/{self.name}")
        return rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string()] + [pa.int64()] * 5
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def _writer(folder: str, frame: int, bundle: int, level: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame, bundle, level)
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, first, kind in zip(*(column.to_pylist() for column in batch.columns)):
                record_id = f"urn:uuid:{uuid.uuid4()}"
                rows += writer.add(record_id, page_id, record_bytes(record_id, kind, url, payload, digest, page_id, first))
            yield _index_batch(rows)
        yield _index_batch(writer.close())

    return run


def write_bundles(
    pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
    frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL,
) -> DataFrame:
    """Write one record per row below ``folder`` (a URI that executors reach) and return the index, a table beside the bundles.

    The payload is the text in UTF-8, of a null text nothing. Among rows of equal payload of at least ``least`` bytes those with the
    smallest id are responses, the others revisit it; rows of smaller payloads, and rows with a null id, are responses. Payloads are
    the same if SHA-1 and size are. Null URLs are written as ``urn:none``. Rows stay where they are unless groups of copies are too
    many to send to every task. An empty table gives an empty index.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{path}/bundles")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    groups = rows.where(f"bytes >= {least} and page_id is not null").groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1").drop("n"), "copies")
    few = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, ["sha", "bytes"], "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    records = joined.select("page_id", "url", "payload", _base32("sha").alias("digest"), "first", F.when(revisit, "revisit").otherwise("response").alias("kind"))
    records.mapInArrow(_writer(f"{folder}/bundles", frame, bundle, level), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _base32(sha: str):
    """Upper-case base32 of a hexadecimal SHA-1: 32 digits of 5 bits, four at a time from 5 hexadecimal digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for part in range(8):
        number = F.conv(F.substring(sha, 5 * part + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(alphabet), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyarrow import fs

    decompress = zstandard.ZstdDecompressor().decompress
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    opened = frame_at = data = file = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if opened != row["bundle"]:
                if file is not None:
                    file.close()
                files, path = fs.FileSystem.from_uri(row["bundle"])
                file, opened, frame_at = files.open_input_file(path), row["bundle"], None
            if frame_at != row["frame_start"]:
                file.seek(row["frame_start"])
                data, frame_at = decompress(file.read(row["frame_bytes"])), row["frame_start"]
            fields, size, payload = parse_record(data[row["record_start"] : row["record_start"] + row["record_bytes"]])
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            if fields["WARC-Record-ID"] != f"<{row['record_id']}>":
                raise ValueError(f"{opened}: index and record differ")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{opened}: payload damaged")
            page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
            out.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, row["record_id"], payload))
        yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records an index (or any part of it) names, read by seeking to their frames: (page_id, payload_bytes, payload_digest,
    record_type, refers_to, record_id[, payload]). Each frame is read by one task, once if its rows are together; a revisit has no
    payload of its own. Digests of responses are checked."""
    spread = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "record_start")
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"
    read = spread.mapInArrow(_reader, kind)
    return read if payloads else read.drop("payload")
