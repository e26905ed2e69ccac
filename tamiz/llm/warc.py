"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records,
and a last skippable frame with a seek table: compressed and decompressed size of
every frame, their number, a descriptor byte and a magic number. Any Zstandard
reader reads it from the front; with the seek table, or with the index that maps
record identifiers to frame and offset, one frame is enough for one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tamiz.llm.files import create, open_random
from tamiz.session import materialize, scratch

# Fixed values of the seekable Zstandard format and of the record identifiers.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, "
    "start long, size long"
)
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, url string, bundle string, frame int, start long"
)


def assign_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds ``payload`` (null as empty), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest
    ``page_id`` is the response and the others revisit it; repeated rows of that id
    are responses too. A null id is never the largest; if all are null, all are
    responses. Copies are counted by digest before anything else moves.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    latest = (
        pages.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("latest"), F.count("*").alias("copies"))
        .where("copies > 1 and latest is not null")
        .drop("copies")
    )
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return (
        pages.join(materialize(latest), "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("latest")))
        .withColumn("payload", F.when(~revisit, F.col("payload")))
        .drop("latest")
    )


def record_id(page_id: int | None, digest: str) -> str:
    return uuid.uuid5(NAMESPACE, f"{page_id}:{digest}").urn


def _header(lines: list[tuple[str, object]]) -> bytes:
    named = (f"{k}: {re.sub('[\r\n]+', ' ', str(v))}\r\n" for k, v in lines if v is not None)
    return ("WARC/1.1\r\n" + "".join(named) + "\r\n").encode()


def write_record(page_id, url, payload, size, digest, kind, refers_to, date: str) -> bytes:
    """One record. A revisit has no block; its payload's size and digest are in its header."""
    block = b""
    if kind == "response":
        body = payload.encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("Page-ID", page_id),
        ("Payload-Length", size),
    ]
    if kind == "revisit":
        lines += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"),
            ("Refers-To-Page-ID", refers_to),
        ]
    return _header(lines) + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Writes frames one after another; at most one frame's records are in memory."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.uri, self.frame_bytes = uri, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.out = create(uri)
        self.frames: list[tuple[int, int]] = []
        self.at = 0
        self.buffer: list[bytes] = []
        self.held = 0
        self.pending: list[tuple] = []
        self.index: list[tuple] = []

    def add(self, identifier: str, page_id, record: bytes) -> None:
        self.pending.append((identifier, page_id, self.held, len(record)))
        self.buffer.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        frame = self.compress(b"".join(self.buffer))
        self.out.write(frame)
        place = (self.uri, len(self.frames), self.at, len(frame))
        self.index += [(i, p, *place, start, size) for i, p, start, size in self.pending]
        self.frames.append((len(frame), self.held))
        self.at += len(frame)
        self.buffer, self.held, self.pending = [], 0, []

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()

    def taken(self) -> list[tuple]:
        index, self.index = self.index, []
        return index


def seek_table(file) -> list[tuple[int, int]]:
    """Start and size of every frame, from the end of a bundle."""
    end = file.size()
    frames, _, magic = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    sizes = ENTRY.iter_unpack(file.read_at(frames * ENTRY.size, end - FOOTER.size - frames * ENTRY.size))
    table, at = [], 0
    for compressed, _ in sizes:
        table.append((at, compressed))
        at += compressed
    return table


def fetch(bundle: str, frame: int, start: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: reads the seek table and a single frame."""
    with open_random(bundle) as file:
        at, length = seek_table(file)[frame]
        data = zstandard.ZstdDecompressor().decompress(file.read_at(length, at))
    return read_record(data[start : start + size])


def write_bundles(
    records: DataFrame,
    folder: str,
    frame_bytes: int = 1 << 18,
    bundle_bytes: int = 1 << 27,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the records of ``assign_revisits`` below ``folder``; returns the stored index.

    Every task writes bundles of its own under fresh names, so a task that runs
    twice never touches another's file. The index is committed by Spark and names
    only the bundles of the attempts that counted; a reader starts from it.
    ``folder`` is a URI that all executors reach. A record larger than a frame gets
    a frame of its own size. Without rows there are no bundles.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if writer is None:
                    writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                record = write_record(
                    page_id, row.url, row.payload, row.payload_bytes, row.payload_digest, row.record_type, refers_to, date
                )
                writer.add(record_id(page_id, row.payload_digest), page_id, record)
                if writer.at >= bundle_bytes:
                    writer.close()
                    done += writer.taken()
                    writer = None
            if writer:
                done += writer.taken()
            yield _rows(done, INDEX)
        if writer:
            writer.close()
            yield _rows(writer.taken(), INDEX)

    wanted = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return materialize(records.select(wanted).mapInPandas(write, INDEX))


def _rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {f.split()[0]: "Int64" for f in schema.split(", ") if f.endswith("long")}
    return pd.DataFrame(rows, columns=names).astype(kinds)


def read_bundles(index: DataFrame) -> DataFrame:
    """Read every record of an index back, frame by frame, and measure its payload anew.

    The unit of work is a frame. Its place in the index must be that of the bundle's
    own seek table, and a response's payload must have the digest in its header.
    """
    place = ["bundle", "frame", "frame_start", "frame_size"]
    # A small index stands for much to read: dealt to all tasks, not by its own size.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = index.repartition(parts, *place).groupBy(*place).agg(
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("records")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for bundle, some in batch.groupby("bundle"):
                with open_random(bundle) as file:
                    table = seek_table(file)
                    for row in some.itertuples(index=False):
                        if table[row.frame] != (row.frame_start, row.frame_size):
                            raise ValueError(f"index and seek table of {bundle} differ")
                        data = decompress(file.read_at(row.frame_size, row.frame_start))
                        yield _rows(
                            [(*_measured(data[r["start"] : r["start"] + r["size"]]), bundle, row.frame, r["start"]) for r in row.records],
                            READ,
                        )

    return frames.mapInPandas(read, READ)


def _measured(data: bytes) -> tuple:
    fields, payload = read_record(data)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(fields["Payload-Length"])
    if fields["WARC-Type"] == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("Page-ID", "Refers-To-Page-ID"))
    return page_id, size, digest, fields["WARC-Type"], refers_to, fields["WARC-Record-ID"].strip("<>"), fields.get("WARC-Target-URI")


def archive(pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as bundles and read them all back.

    Null payloads are empty, a null url leaves its field out, other columns play no
    part, repeated rows keep a record each; an empty table gives no rows.
    """
    folder = folder or scratch(pages.sparkSession, "bundles")
    return read_bundles(write_bundles(assign_revisits(pages, least), folder))
