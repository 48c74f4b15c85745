"""WARC archives as seekable Zstandard bundles.

Each task writes the records of its rows into one bundle: records are grouped into independent frames, a skippable
frame with the seek table ends the file, and the manifest maps every record to its frame and its offset inside it.
Equal payloads are stored once; the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.scratch import Scratch, shared_dir

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, LEVEL = 1 << 18, 3
FRAMES_PER_TASK = 64
MANIFEST = "bundle string, record string, frame int, start int, length int"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str):
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", uri)  # as Hadoop names it
    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return where, path


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """One record: its headers by lower-cased name, and ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    out["payload"] = rest[: int(out["content-length"])]
    if rest[int(out["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    return out


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain size) of each frame, from the last bytes of a bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    f.seek(size - 9 - 8 * n)
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        where, path = _open(folder)
        task = TaskContext.get()
        # each attempt has a bundle of its own: rows may come in another order, and a manifest must name what it describes
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        mine = f"{path}/.{name}"
        press = zstandard.ZstdCompressor(level=LEVEL)
        frames: list[tuple[int, int]] = []
        index: list[tuple] = []
        out, frame = None, io.BytesIO()

        def close_frame():
            plain = frame.getvalue()
            packed = press.compress(plain)
            out.write(packed)
            frames.append((len(packed), len(plain)))
            frame.seek(0)
            frame.truncate()

        for batch in batches:
            if out is None and batch.num_rows:
                out = where.open_output_stream(mine, compression=None)  # frames are compressed already
            index = []
            for page_id, url, html, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                payload = (html or "").encode()
                record = record_of(page_id, url, payload, len(payload), digest32(payload), refers_to, date)
                index.append((f"{folder}/{name}", f"urn:page:{page_id}", len(frames), frame.tell(), len(record)))
                frame.write(record)
                if frame.tell() >= FRAME_BYTES:
                    close_frame()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*index, strict=True)) or [[]] * 5, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["bundle", "record", "frame", "start", "length"])
        if out is not None:
            if frame.tell():
                close_frame()
            out.write(seek_table(frames))
            out.close()
            where.move(mine, f"{path}/{name}")  # whole bundles only

    return run


def write_archives(pages: DataFrame, spark: SparkSession, folder: str, *, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under ``folder``; returns the manifest, already stored.

    Of records whose payloads are equal and at least ``least`` bytes long, the one with the largest page_id is the
    response and the others revisit it; a null page_id takes part, but is never the largest (records without any id in
    their group are all responses). Rows that repeat the largest page_id are all responses. A null html is an empty
    payload. Other columns are ignored, whatever their names; an empty table gives an empty manifest and no bundle.

    Each attempt of a task writes a bundle under a name of its own and moves it into place; the manifest of the attempt
    that Spark commits names it. Bundles of lost or repeated attempts are whole files that no manifest names. The
    folder's scheme must be one that pyarrow opens (file, hdfs, s3, gs, abfss).
    """
    scratch = Scratch(spark)
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    last = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("size")).filter("size > 1 AND last IS NOT NULL")
    last = scratch.save(last.select("digest", "last"), "largest")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()) & (F.octet_length("html") >= least), F.col("last"))
    rows = rows.join(last, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return scratch.save(rows.mapInArrow(_writer(folder.rstrip("/"), date), MANIFEST), "manifest", scan=True)


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        opened, frames = None, []
        for batch in batches:
            for bundle, number, at in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "places")], strict=True):
                where, path = _open(bundle)
                with where.open_input_file(path) as f:
                    if bundle != opened:  # a task's frames come sorted by bundle
                        opened, frames = bundle, read_seek_table(f, f.size())
                    start, packed, plain = frames[number]
                    f.seek(start)
                    data = expand.decompress(f.read(packed), max_output_size=plain)
                rows = []
                for place in at:
                    r = parse_record(data[place["start"] : place["start"] + place["length"]])
                    kind, payload = r["warc-type"], r["payload"]
                    digest, size = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
                        raise ValueError(f"{r['warc-record-id']} doesn't have the payload that its headers tell")
                    of = lambda x: None if x in (None, "None") else int(x)
                    refers = r.get("warc-refers-to")
                    rows.append((of(r["warc-record-id"][10:-1]), r.get("warc-target-uri"), payload if keep_payload else None, size, digest, kind, of(refers[10:-1]) if refers else None))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(manifest: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """The records that a manifest (or any selection of its rows) names, frame by frame through the seek tables.

    A revisit record has no payload of its own; payload_bytes and payload_digest are those of the full one.
    """
    frames = manifest.groupBy("bundle", "frame").agg(F.collect_list(F.struct("start", "length")).alias("places"))
    # a row of the manifest is small and what it names is not: tasks follow the number of frames, not of its bytes
    tasks = max(1, manifest.select("bundle", "frame").distinct().count() // FRAMES_PER_TASK)
    frames = frames.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return frames.mapInArrow(_reader(keep_payload), RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/answerlens-warc-{uuid.uuid4().hex[:12]}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark, folder)
    return read_archives(manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
