"""Web archives in WARC 1.1 with Zstandard frames and a shared dictionary.

Layout of an archive: a skippable frame with the dictionary (plain or itself compressed), then one
frame per record. The reader loads the dictionary from that frame, walks the frames by their block
sizes, decodes one record at a time and checks it: version line, required header fields, length of
the block, the two empty lines behind it, block and payload digests. Anything else raises
``BadArchive`` with the place.

Payloads of at least ``SMALLEST_REVISIT`` bytes that are equal are stored once: the row with the
smallest page id is a response, the others are revisits that name it. The writer's tasks each
write archives of about ``ARCHIVE_BYTES`` of records into the shared folder, under names of their
own attempt, and return a list of what they wrote; only archives on the list are read, so a task
that is lost and runs again leaves nothing that counts.

The dictionary is trained on about ``SAMPLE_PAGES`` pages, chosen by a hash, and at most
``SAMPLE_BYTES`` of each.

Defined cases: a missing page is an empty payload and a response; a missing url leaves the target
field out; rows without id are stored with the id field empty and are responses unless a row with
an id has their payload; rows that repeat the smallest id and payload are all responses; an empty
table gives no archive and an empty result; too few pages to train on give archives without
dictionary.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.llm.common import arrow_schema, hash_sample, join_sized, shared_path
from rippleflow.session import cut_lineage

SMALLEST_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8 << 10, 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the two formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


# ---- records --------------------------------------------------------------------------------

def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def clean_url(url: str) -> str:
    """Characters that a header line can't hold are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None, revisit: bool) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{sha256(block)}")]
    if url is not None:
        fields.append(("WARC-Target-URI", clean_url(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes, place: str) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise BadArchive(f"{place}: version line {lines[0][:20]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"{place}: header line {line[:40]!r}")
        if name.strip().lower() in fields:
            raise BadArchive(f"{place}: field {name} twice")
        fields[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if not fields.get(k)]:
        raise BadArchive(f"{place}: no {', '.join(missing)}")
    return fields


def parse_record(data: bytes, place: str) -> dict:
    """Headers, HTTP headers and payload of one record, all lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive(f"{place}: header does not end")
    fields = parse_headers(head, place)
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"{place}: {len(rest)} bytes behind the header, content-length {length}")
    block = rest[:-4]
    digest = fields.get("warc-block-digest")
    if digest is not None and digest != f"sha256:{sha256(block)}":
        raise BadArchive(f"{place}: block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive(f"{place}: HTTP header does not end")
    size = re.search(rb"(?mi)^Content-Length:\s*(\d+)\s*$", http)
    kind = fields["warc-type"]
    stated = fields.get("warc-payload-digest", "")
    if size is None or not stated.startswith("sha256:"):
        raise BadArchive(f"{place}: payload length or digest missing")
    if kind == "response":
        if len(payload) != int(size[1]) or stated != f"sha256:{sha256(payload)}":
            raise BadArchive(f"{place}: payload length or digest")
    elif kind != "revisit" or payload or not fields.get("warc-refers-to"):
        raise BadArchive(f"{place}: record type {kind}")
    return {"fields": fields, "payload": payload if kind == "response" else None,
            "payload_bytes": int(size[1]), "payload_digest": stated.removeprefix("sha256:")}


# ---- frames ---------------------------------------------------------------------------------

def frame_size(data: memoryview, at: int, place: str) -> int:
    """Bytes of the frame at ``at``, from its header and block headers."""
    import zstandard

    try:
        header = zstandard.frame_header_size(data[at:at + 18])
        checksum = zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
    except zstandard.ZstdError as error:
        raise BadArchive(f"{place}: {error}") from error
    end = at + header
    while True:
        if end + 3 > len(data):
            raise BadArchive(f"{place}: frame is cut off")
        block = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise BadArchive(f"{place}: frame is cut off")
    return end - at


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_frames(content: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """Decoded frames with their places, by the dictionary of the leading skippable frame."""
    import zstandard

    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        length = struct.unpack_from("<I", data, 4)[0]
        if 8 + length > len(data):
            raise BadArchive(f"{name}: dictionary is cut off")
        plain, at = bytes(data[8:8 + length]), 8 + length
        if plain[:4] == struct.pack("<I", FRAME_MAGIC):
            plain = zstandard.ZstdDecompressor().decompressobj().decompress(plain)
        dictionary = zstandard.ZstdCompressionDict(plain)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        place = f"{name} at {at}"
        size = frame_size(data, at, place)
        try:
            record = decoder.decompressobj().decompress(data[at:at + size])
        except zstandard.ZstdError as error:
            raise BadArchive(f"{place}: {error}") from error
        yield place, record
        at += size


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages; empty if that is too small to train on."""
    import zstandard

    sample = hash_sample(pages.where("html IS NOT NULL"), SAMPLE_PAGES, 13, "page_id", "url").select(
        F.substring(F.encode("html", "UTF-8"), 1, SAMPLE_BYTES).alias("part"))
    parts = sorted(bytes(r["part"]) for r in sample.collect())[:2 * SAMPLE_PAGES]
    size = min(DICTIONARY_BYTES, sum(map(len, parts)) // 10)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


# ---- operator -------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives under ``folder`` (any URI pyarrow can open) and return the list
    of archives: name, records, bytes."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= SMALLEST_REVISIT
    same = rows.where(large).groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("page_id").alias("first")).where(
        "copies > 1 AND first IS NOT NULL").drop("copies")
    joined = join_sized(rows, same, "digest").withColumn(
        "revisit", F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull()
                              & large, F.lit(False)))
    dictionary = train_dictionary(pages)
    layout = arrow_schema("name string, records long, bytes long")

    def run(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        plan = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=plan, write_checksum=True)
        done, stream, size, records = 0, None, 0, 0

        def close():
            nonlocal stream, done
            stream.close()
            stream, done = None, done + 1
            return pa.RecordBatch.from_pylist(
                [{"name": name, "records": records, "bytes": size}], schema=layout)

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name = f"{context.partitionId()}-{context.taskAttemptId()}-{done}.warc.zst"
                    stream = place.open_output_stream(f"{root}/{name}", compression=None)
                    head = dictionary_frame(dictionary) if dictionary else b""
                    stream.write(head)
                    size, records = len(head), 0
                frame = encoder.compress(make_record(
                    row["page_id"], row["url"], row["html"].encode(), row["digest"],
                    row["first"], row["revisit"]))
                stream.write(frame)
                size, records = size + len(frame), records + 1
                if size >= archive_bytes:
                    yield close()
        if stream is not None:
            yield close()

    make_folder(pages.sparkSession, folder)
    written = joined.select("page_id", "url", "html", "digest", "first", "revisit").mapInArrow(
        run, "name string, records long, bytes long")
    return cut_lineage(written)


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_archives(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """Records of the listed archives: page_id, url, record_type, payload, payload_bytes,
    payload_digest, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    listed = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(
        written.select("name", "records"), "name").select("name", "records", "content")
    schema = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
              "payload_digest string, refers_to long")
    layout = arrow_schema(schema)

    def number(field: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*)>", field)
        if not found:
            raise BadArchive(f"record id {field}")
        return int(found[1]) if found[1] else None

    def run(batches):
        for batch in batches:
            for name, records, content in zip(*(c for c in batch.columns)):
                rows, held, count = [], 0, 0
                for place, data in read_frames(content.as_py(), name.as_py()):
                    record = parse_record(data, place)
                    fields = record.pop("fields")
                    refers = fields.get("warc-refers-to")
                    rows.append(record | {
                        "page_id": number(fields["warc-record-id"]),
                        "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
                        "refers_to": number(refers) if refers else None})
                    held, count = held + len(data), count + 1
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=layout)
                        rows, held = [], 0
                if count != records.as_py():
                    raise BadArchive(f"{name}: {count} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=layout)

    return listed.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder))
