"""Web archives of Zstandard frames: one frame a record behind a dictionary, written and read by Spark.

An archive begins with a skippable frame that holds the dictionary of its
records; each record is a frame of its own, so that a reader decodes one record
at a time. Records are WARC/1.1: a response with the page, or a revisit that
names the response with the same payload.

Frames are written by Spark's text sink, which commits whole files only: an
empty skippable frame, which every decoder passes over, is its line separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from weft.lineage import bounded, checkpointed, shared_folder
from weft.llm.common import release_memory, small_batches

# Fixed values of the formats: magic numbers of a Zstandard frame, of skippable
# frames (sixteen of them) and of the one that holds a dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An empty skippable frame, as a line separator.
SEPARATOR = (SKIPPABLE.to_bytes(4, "little") + bytes(4)).decode("ascii")
#: Bytes of pages in an archive, about.
ARCHIVE_BYTES = 32 << 20
#: A dictionary's bytes, and those of the first records of an archive that it is made of.
DICTIONARY_BYTES, SAMPLE_BYTES, LEAST_SAMPLES = 16 << 10, 1 << 20, 16
#: Bytes that a record may have at most when it is read.
MOST_BYTES = 1 << 30

RECORD = (
    "archive string, offset long, record_id string, record_type string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def payload_digest(payload: bytes) -> str:
    """The base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    """A header's value: white space and control characters are percent-encoded, so that no value makes a line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with an HTTP head and the payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", _plain(uri))] if uri is not None else []),
        *([("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")] if refers_to is not None else []),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record's bytes, by RECORD's names; ValueError tells what is wrong with it."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS or not blank:
        raise ValueError("no version line or no end of the header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "strict").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header field: {name[:80]}")
        fields[name.lower()] = value.strip()
    lacking = [name for name in REQUIRED if name not in fields]
    if lacking:
        raise ValueError(f"no {lacking[0]}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("content-length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {size}, the block has {max(0, len(rest) - 4)}")
    kind, block = fields["warc-type"], rest[:size]
    payload, told = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no end of the HTTP header")
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        told = int(found[1]) if found else None
    own = kind != "revisit"
    if own and told is not None and told != len(payload):
        raise ValueError(f"the HTTP header tells {told} bytes, the payload has {len(payload)}")
    method, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if own and method.lower() == "sha1" and digest.upper() != payload_digest(payload):
        raise ValueError("the payload's digest differs")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind,
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "target_uri": fields.get("warc-target-uri"), "payload_bytes": len(payload) if own else told,
        "payload_digest": digest.upper() or (payload_digest(payload) if own else None), "payload": payload if own else None,
    }


def _frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at a place, from the headers of its blocks; ValueError if it is cut off."""

    def number(start: int, count: int) -> int:
        if start + count > len(data):
            raise ValueError("a frame is cut off")
        return int.from_bytes(data[start : start + count], "little")

    descriptor = number(at + 4, 1)
    single, check = descriptor >> 5 & 1, descriptor >> 2 & 1
    content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    place = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[descriptor & 3] + content
    last = 0
    while not last:
        header = number(place, 3)
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        place += 3 + (1 if kind == 1 else size)
    place += 4 * check
    if place > len(data):
        raise ValueError("a frame is cut off")
    return place - at


def frames(data: bytes):
    """(offset, magic, content or whole frame as a view) of every frame of an archive; ValueError where none begins."""
    view, at = memoryview(data), 0
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & ~0xF == SKIPPABLE:
            size = 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if at + size > len(view):
                raise ValueError(f"a frame is cut off at {at}")
            yield at, magic, view[at + 8 : at + size]
        elif magic == FRAME:
            size = _frame_size(view, at)
            yield at, magic, view[at : at + size]
        else:
            raise ValueError(f"no frame at {at}")
        at += size


def decode(data: bytes, most_bytes: int = MOST_BYTES):
    """(offset, fields, problem) of every record of an archive: parse_record()'s fields, or None and what is wrong.

    The dictionary is the content of the first frame, as it is or compressed.
    Behind a frame that is cut off, or where none begins, nothing is read.
    """
    decompressor, at = zstandard.ZstdDecompressor(), 0
    try:
        for at, magic, content in frames(data):
            if magic == DICTIONARY and at == 0:
                known = bytes(content)
                if known[:4] == FRAME.to_bytes(4, "little"):
                    known = zstandard.ZstdDecompressor().decompressobj().decompress(known)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
            elif magic == FRAME:
                try:
                    size = zstandard.frame_content_size(content)
                    if size > most_bytes:
                        raise ValueError(f"a record of {size} bytes")
                    whole = decompressor.stream_reader(content).read(most_bytes + 1)
                    if len(whole) > most_bytes or size not in (-1, len(whole)):
                        raise ValueError(f"a record of {len(whole)} bytes, where the frame tells {size}")
                    yield at, parse_record(whole), None
                except (ValueError, zstandard.ZstdError) as error:
                    yield at, None, str(error)
    except (ValueError, zstandard.ZstdError) as error:
        yield at, None, str(error)


def encode(records):
    """The frames of an archive from its records: the dictionary's, if one can be made of the first ones, and one each.

    The records behind the samples are not held.
    """
    held, size = [], 0
    records = iter(records)
    for data in records:
        held.append(data)
        size += len(data)
        if size >= SAMPLE_BYTES:
            break
    known = None
    if len(held) >= LEAST_SAMPLES and size >= 8 * DICTIONARY_BYTES:
        try:
            known = zstandard.train_dictionary(DICTIONARY_BYTES, [x[: 64 << 10] for x in held], k=256, d=8)
        except zstandard.ZstdError:  # samples that have nothing in common
            known = None
    if known is not None:
        content = known.as_bytes()
        yield DICTIONARY.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
    compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
    while held:
        yield compressor.compress(held.pop(0))
    for data in records:
        yield compressor.compress(data)


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a record for each row of pages(page_id, url, html) to archives in a new folder path.

    The payload is html in UTF-8, a null one is empty; a null url is left out.
    Of rows with equal payloads of at least least_bytes the one with the
    smallest page_id is a response (null ids come last; rows that share that
    id, or a payload whose ids are all null, are responses all) and the others
    revisit it; rows with smaller payloads are responses. A record is named
    urn:page:, the page_id, a colon and 32 digits of the payload's SHA-256, so
    only rows that repeat both share a name. An archive holds about
    archive_bytes of payloads, and an empty table gives a folder without
    records. Other columns of pages are ignored.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload, 256).alias("sha"))
    marks = checkpointed(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("size")))
    # Equal payloads meet as one row each, first inside each task; pages that stand alone need no join.
    groups = marks.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = checkpointed(groups.where((F.col("rows") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).select("sha", "first"))
    total = marks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    joined = rows.join(bounded(groups, 200_000), "sha", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    named = joined.select("page_id", "url", "html", "sha", first.alias("first"))

    def build(batches):
        def records():
            for batch in batches:
                for page, url, html, sha, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    name = lambda number: f"urn:page:{'' if number is None else number}:{sha[:32]}"
                    yield record(name(page), url, date, html.encode(), None if refers is None else name(refers))

        for frame in encode(records()):
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])
        release_memory()

    small_batches(pages.sparkSession)
    dealt = named.repartition(max(1, -(-total // archive_bytes)))
    frames_ = dealt.mapInArrow(build, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames_.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def read_archives(spark, path: str, payloads: bool = True, report: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The records of all archives in a folder: see RECORD; offset is the frame's byte in its archive.

    A task decodes one archive, a record at a time, and checks the version
    line, the required fields, the lengths of block and payload and the
    payload's digest. A record that fails is an error, or if asked for, a row
    with a problem and nulls; behind a frame that is cut off an archive has no
    more rows. payload is null in a revisit, or if payloads are not asked for.
    payload_bytes of a revisit is what its HTTP header tells of the full one.
    """

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for offset, fields, problem in decode(content.as_buffer(), most_bytes):
                    if problem is not None and not report:
                        raise ValueError(f"{archive} at {offset}: {problem}")
                    row = {"archive": archive, "offset": offset, "problem": problem, **(fields or {})}
                    if not payloads:
                        row.pop("payload", None)
                    yield row
                release_memory()

    def batched(batches):
        held, size = [], 0
        for row in run(batches):
            held.append(row)
            size += 200 + len(row.get("payload") or b"")
            if size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])
    archives = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return archives.mapInArrow(batched, RECORD)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written to archives beside the checkpoints, and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    found = read_archives(spark, path, payloads=False)
    number = lambda name: F.nullif(F.split(F.col(name), ":")[2], F.lit("")).cast("long")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )
