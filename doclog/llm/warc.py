"""Zstandard WARC archives: written one frame per record, read back with checked headers and lengths.

Layout of an archive: a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a zstd frame, then one zstd frame per
record, compressed with that dictionary. The dictionary is trained by each writing task on the first 20,000 bytes of the first
DICTIONARY_ROWS records of its own archive (what is written is whole, whatever the dictionary has seen); with too few to train on the frame is empty and records are compressed without one.

Tasks write whole archives under their partition's number into the shared folder, first under a name of their own and then
renamed, so a repeated task leaves the same file. Their listing is a table beside them; nothing goes through the driver.

Null payloads are empty ones. Of equal payloads of LEAST bytes or more the smallest id is the response and the others revisit
it; rows that repeat an id are records of their own (each a response, if theirs is the smallest). Rows with a null id have no
record to be found by and are left out. Other columns are ignored. A broken archive raises ValueError and names the record.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, lean

#: Magic numbers of the dictionary's skippable frame and of a zstd frame.
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
LEAST = 100
DICTIONARY_ROWS, DICTIONARY_BYTES = 200, 16_384
#: Payload bytes that one archive holds on average.
ARCHIVE_BYTES = 8 << 20
RECORD = "record_type string, page_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def records(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to of each row, dealt by id into a partition for
    every `archive_bytes` of payload.
    """
    base = pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    keys = base.filter(F.col("payload_bytes") >= LEAST).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = keys.join(first, "payload_digest").filter("first < page_id").select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "first").distinct()
    # payloads travel once, by id, to where their archive is written; a repeated id may hold several payloads
    archives = max(1, -(-(base.agg(F.sum("payload_bytes")).first()[0] or 0) // archive_bytes))
    same = (F.col("page_id") == F.col("id")) & (F.col("payload_digest") <= F.col("digest")) & (F.col("payload_digest") >= F.col("digest"))
    marked = base.repartition(archives, "page_id").join(again.repartition(archives, "id"), same, "left")
    return marked.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"))


def record_bytes(row: dict) -> bytes:
    """One WARC record with its header block; a revisit carries no payload."""
    body = b"" if row["record_type"] == "revisit" else row["payload"]
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Target-URI: {row['url'].replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"Payload-Length: {row['payload_bytes']}",
    ]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too little to train on
        return b""


def archive(rows: Iterator[dict], out: io.BufferedIOBase) -> int:
    """Write an archive; gives its number of records."""
    import zstandard

    head = list(islice(rows, DICTIONARY_ROWS))
    trained = dictionary([record_bytes(row)[:20_000] for row in head])
    packed = zstandard.ZstdCompressor().compress(trained) if trained else b""
    out.write(DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed)
    compressor, n = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None), 0
    for part in (head, rows):
        for row in part:
            out.write(compressor.compress(record_bytes(row)))
            n += 1
    return n


def write_warc(found: DataFrame, path: str) -> None:
    """An archive for each partition of records() under `path`/archives, and their listing under `path`/listing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        name, own = f"part-{TaskContext.get().partitionId():06d}.warc.zst", f"{folder}/.{uuid.uuid4().hex}"
        rows = (row for batch in batches for low in range(0, batch.num_rows, 100) for row in batch.slice(low, 100).to_pylist())
        first = next(rows, None)
        if first is None:
            return
        store.create_dir(f"{folder}/archives")
        with store.open_output_stream(own) as out:
            n = archive((row for part in ((first,), rows) for row in part), out)
        store.move(own, f"{folder}/archives/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "records"])

    found.sortWithinPartitions("page_id").mapInArrow(lean(run), "name string, records long").write.parquet(f"{path}/listing")


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame of an archive; the dictionary comes from its first frame."""
    import zstandard

    if data[:4] != DICTIONARY_MAGIC or len(data) < 8:
        raise ValueError("no dictionary frame at the start of the archive")
    at = 8 + struct.unpack("<I", data[4:8])[0]
    if at > len(data):
        raise ValueError("the dictionary frame is cut short")
    packed = data[8:at]
    trained = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == FRAME_MAGIC else packed
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        one = reader.decompressobj()
        parts, start = [], at
        while not one.eof:
            step = view[at : at + 65_536]
            if not len(step):
                raise ValueError(f"the frame at {start} is cut short")
            try:
                parts.append(one.decompress(step))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame at {start} is broken: {e}") from None
            at += len(step)
        at -= len(one.unused_data)
        yield start, b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of a record; its version, needed headers, lengths, end mark and payload digest are checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    try:
        kind, length = fields["warc-type"], int(fields["content-length"])
        record, digest = fields["warc-record-id"], fields["warc-payload-digest"]
        full = int(fields.get("payload-length", length))
    except (KeyError, ValueError) as e:
        raise ValueError(f"missing or bad header {e}") from None
    if kind not in ("response", "revisit") or not record.startswith("<urn:page:") or not digest.startswith("sha256:"):
        raise ValueError(f"bad header in {record[:80]!r}")
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{record}: {len(rest)} bytes after the header, Content-Length {length}")
    body, refers = rest[:length], fields.get("warc-refers-to")
    if kind == "response" and (full != length or hashlib.sha256(body).hexdigest() != digest[7:]):
        raise ValueError(f"{record}: the payload differs from its digest or length")
    if kind == "revisit" and (length or not refers):
        raise ValueError(f"{record}: a revisit must refer and carry no payload")
    return {"record_type": kind, "page_id": record[10:-1], "target_uri": fields.get("warc-target-uri"), "payload_digest": digest[7:], "payload_bytes": full, "refers_to": refers[10:-1] if refers else None, "payload": body}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives in a folder; `payload` is empty for revisits (see with_payloads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[dict] = []
                for at, data in frames(content.as_py()):
                    try:
                        rows.append(parse_record(data))
                    except ValueError as e:
                        raise ValueError(f"{name} at {at}: {e}") from None
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(lean(run), RECORD)


def with_payloads(found: DataFrame) -> DataFrame:
    """Records of read_warc() with the payload that a revisit refers to; its response must exist and have its digest."""
    held = found.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("held"), F.col("payload_digest").alias("digest"))
    joined = found.join(held.dropDuplicates(["refers_to"]), "refers_to", "left")
    good = (F.col("record_type") == "response") | (F.col("digest") == F.col("payload_digest"))
    whole = F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.concat(F.lit("no response for revisit "), "page_id"))).otherwise(F.coalesce("held", "payload"))
    return joined.withColumn("payload", whole.cast("binary")).drop("held", "digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    path = fresh_dir(pages.sparkSession, "warc")
    write_warc(records(pages), path)
    if pages.sparkSession.read.parquet(f"{path}/listing").isEmpty():
        return pages.sparkSession.createDataFrame([], RECORD)
    return read_warc(pages.sparkSession, f"{path}/archives")
