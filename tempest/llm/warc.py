"""WARC archives as seekable Zstandard bundles.

A bundle holds WARC/1.1 records grouped into frames.  A frame is compressed on its own and ends with
the record that fills it, so a record never crosses frames; a record larger than a frame is a frame.
The bundle ends with the seek table of the Zstandard seekable format (a skippable frame, which plain
decompressors pass over), so ``zstd -d`` gives the plain WARC file.  Next to the bundles lies an
index with one row per record: record identifier, bundle, frame, offset in the decompressed frame.

``write_archive`` writes bundles and index, ``read_archive`` reads everything back by the seek
tables alone, ``lookup`` reads only the frames that hold the wanted records.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id
is a response, the others are revisits without payload that name it; ``resolve`` gives revisits the
payload figures of their response.

A task writes its bundles under names of its own attempt and the index names only those of
successful tasks, so a repeated task leaves at most files that nothing refers to.  Files are opened
through ``pyarrow.fs`` by the URI of the archive's folder, which must be one all executors share.

Defined results: null html is an empty payload; a null url leaves out the target; null page_ids
are larger than all others (a group of null ids only is all responses); rows that repeat the smallest
page_id with the same payload are all responses; an empty table gives an empty archive; control
characters in a url are percent-encoded; further columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches
from tempest.session import materialise, run_folder

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
TASK_BYTES = 32 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
SKIP_HEAD = struct.Struct("<II")

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = ("record_id string, page_id long, url string, record_type string, refers_to_id string, "
                 "declared_digest string, payload binary, bundle string, frame int, offset long")


# ------------------------------------------------------------------ records

def plan_records(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_id, refers_to (page_id, null for responses), refers_to_id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digest = F.sha2(payload, 256)
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
                             F.coalesce("url", F.lit("-")), digest).cast("binary"))
    record_id = F.concat(F.lit("urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"), record_id.alias("record_id"))
    # copies are pre-aggregated where they are read; only digests that occur twice go on
    first = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("first"),
                  F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull())
             .select(F.col("digest").alias("f_digest"), F.col("first.page_id").alias("f_page"), F.col("first.record_id").alias("f_record")))
    first = materialise(first, folder, "first")
    j = rows.join(first, F.col("digest") == F.col("f_digest"), "left")
    revisit = F.col("f_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("f_page"))
    return j.select("page_id", "url", "payload", "digest", "record_id", F.when(revisit, F.col("f_record")).alias("refers_to_id"))


def record_bytes(page_id, url, payload: bytes, digest: str, record_id: str, refers_to_id, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to_id else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to_id else 'response'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        clean = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to_id:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to_id}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` of a frame, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at offset {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start, stop) + 4
    kind = head["WARC-Type"]
    return {
        "record_id": head["WARC-Record-ID"][1:-1],
        "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None,
        "url": head.get("WARC-Target-URI"), "record_type": kind,
        "refers_to_id": head["WARC-Refers-To"][1:-1] if kind == "revisit" else None,
        "declared_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None if kind == "revisit" else data[body:stop],
    }, stop + 4


# ------------------------------------------------------------------ bundles

def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*e) for e in entries) + FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return SKIP_HEAD.pack(SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - FOOTER.size)
    n, flags, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the file")
    f.seek(size - FOOTER.size - n * ENTRY.size)
    table, out, at = f.read(n * ENTRY.size), [], 0
    for c, d, x in ENTRY.iter_unpack(table):
        out.append((at, c, d, x))
        at += c
    return out


def read_frame(f, at: int, packed: int, size: int, checksum: int) -> bytes:
    import xxhash
    import zstandard

    f.seek(at)
    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError("checksum of a frame does not match")
    return data


class BundleWriter:
    """Writes the records of one task; ``index`` rows of a frame come out as the frame closes."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.fs, self.root = _open(folder)
        self.uri, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.attempt, self.number, self.out = uuid.uuid4().hex, 0, None
        self.parts: list[bytes] = []
        self.size, self.rows = 0, []

    def add(self, record_id: str, page_id, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.attempt}-{self.number:05d}.warc.zst"
            self.out, self.entries, self.written = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0
        self.rows.append((record_id, page_id, f"{self.uri}/{self.name}", len(self.entries), self.size, len(data)))
        self.parts.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            yield from self.end_frame()
            if self.written >= self.bundle_bytes:
                self.end_bundle()

    def end_frame(self) -> Iterator[tuple]:
        import xxhash

        if not self.parts:
            return
        data = b"".join(self.parts)
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        yield from self.rows
        self.parts, self.size, self.rows = [], 0, []

    def end_bundle(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.entries))
            self.out.close()
            self.out, self.number = None, self.number + 1


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles below ``folder``; returns the index table."""
    records = plan_records(pages, folder, min_revisit)
    names = INDEX_SCHEMA.replace(",", "").split()[::2]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = BundleWriter(folder, frame_bytes, bundle_bytes, level)
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "record_id", "refers_to_id")}
            rows = []
            for page_id, url, payload, digest, record_id, refers_to_id in zip(*c.values(), strict=True):
                rows += w.add(record_id, page_id, record_bytes(page_id, url, payload, digest, record_id, refers_to_id))
            yield _batch(names, rows)
        rows = list(w.end_frame())
        w.end_bundle()
        yield _batch(names, rows)

    return run_batches(records.mapInArrow(write, INDEX_SCHEMA), folder, "index")


_TYPES = {"page_id": pa.int64(), "frame": pa.int32(), "offset": pa.int64(), "length": pa.int64(), "payload": pa.binary(),
          "payload_bytes": pa.int64(), "packed": pa.int64(), "size": pa.int64(), "at": pa.int64(), "checksum": pa.int64()}


def _batch(names: list[str], rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], names)


# ------------------------------------------------------------------ reading

def frames(bundles: DataFrame) -> DataFrame:
    """One row per frame of the bundles named in column ``bundle``, from their seek tables."""
    names = ["bundle", "frame", "at", "packed", "size", "checksum"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("bundle").to_pylist():
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    yield _batch(names, [(uri, i, *e) for i, e in enumerate(read_seek_table(f))])

    return bundles.select("bundle").mapInArrow(tables, "bundle string, frame int, at long, packed long, size long, checksum long")


def read_frames(frames: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given frames: ``RECORD_SCHEMA`` with payload_bytes and payload_digest of
    the payload as read (null for revisits)."""
    names = RECORD_SCHEMA.replace(",", "").split()[::2] + ["payload_bytes", "payload_digest"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = _open(r["bundle"])
                with fs.open_input_file(path) as f:
                    data = read_frame(f, r["at"], r["packed"], r["size"], r["checksum"])
                rows, at = [], 0
                while at < len(data):
                    x, after = parse_record(data, at)
                    p = x["payload"]
                    figures = (None, None) if p is None else (len(p), hashlib.sha256(p).hexdigest())
                    if not with_payload:
                        x["payload"] = None
                    rows.append((*x.values(), r["bundle"], r["frame"], at, *figures))
                    at = after
                yield _batch(names, rows)

    return frames.mapInArrow(read, RECORD_SCHEMA + ", payload_bytes long, payload_digest string")


def read_archive(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archive; tasks get frames of about ``TASK_BYTES`` of content together.

    The number of tasks is given: the rows are descriptors, whose own size says nothing about the work.
    """
    f = run_batches(frames(index.select("bundle").distinct()), folder, "frames")
    n = max(1, -(-(f.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    return read_frames(f.repartition(n, "bundle", "frame"), with_payload)


def lookup(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """The records whose identifier is in ``wanted.record_id``, by their frames alone."""
    hits = index.join(wanted.select("record_id").distinct(), "record_id").select("record_id", "bundle", "frame", "offset")
    where = run_batches(frames(hits.select("bundle").distinct()), folder, f"frames-{uuid.uuid4().hex}")
    need = where.join(hits.select("bundle", "frame").distinct(), ["bundle", "frame"])
    return read_frames(need).join(hits, ["record_id", "bundle", "frame", "offset"])


def resolve(records: DataFrame, folder: str) -> DataFrame:
    """Revisits get payload_bytes and payload_digest of their response, and refers_to, its page_id."""
    records = run_batches(records.drop("payload"), folder, "records")
    # only responses that are referred to; repeated rows have one identifier
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("w_id")).distinct()
    target = (records.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("w_id"))
              .groupBy("record_id").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("t"))
              .select(F.col("record_id").alias("t_id"), "t"))
    target = materialise(target, folder, "targets")
    j = records.join(target, F.col("refers_to_id") == F.col("t_id"), "left")
    return j.select("page_id", F.coalesce("payload_bytes", "t.payload_bytes").alias("payload_bytes"),
                    F.coalesce("payload_digest", "t.payload_digest").alias("payload_digest"), "record_type",
                    F.col("t.page_id").alias("refers_to"), "record_id", "declared_digest", "url")


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages``, read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or run_folder(pages.sparkSession, "warc")
    index = write_archive(pages, folder)
    out = resolve(read_archive(index, folder, with_payload=False), folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
