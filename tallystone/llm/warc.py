"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

An archive is a skippable frame that holds the dictionary, then one independent frame per record.
Archives are rows of a table in the shared folder, each of bounded size, so that any task can read
any of them and a lost executor costs only the archives it was working on. ``save_files`` writes
them out as .warc.zst files, and ``read_files`` reads such files, this module's or others'. Records of
any type are read; of those that carry no page (warcinfo, request, metadata) the whole block is the
payload. Whatever breaks the format raises ArchiveError, and so fails the job.

Defined cases: a null html is an empty payload, a null url gives the record a urn as its target. A
null page_id is kept as null; such a record is a revisit where a row with an id has its payload.
Rows that repeat a page_id and payload make equal records with one id. A record whose id names no page
has a null page_id. Extra input columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

#: Fixed values of the format: the magic numbers of the dictionary's frame and of data frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

VERSION = b"WARC/1.1"
#: No crawl time is known for table rows.
NO_DATE = "1970-01-01T00:00:00Z"
_control = re.compile(r"[\x00-\x20\x7f]")


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload if refers_to is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    target = _control.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else name(page_id)[1:-1]
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", NO_DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)),
        *([("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


_page = re.compile(r"<?urn:page:(-?\d+)>?")


def _number(fields: dict[str, str], name: str) -> int:
    if not re.fullmatch(r"\d{1,18}", fields[name]):
        raise ArchiveError(f"{name} is no length: {fields[name]!r}")
    return int(fields[name])


def _page_id(fields: dict[str, str], name: str) -> int | None:
    found = _page.fullmatch(fields.get(name, ""))
    return int(found[1]) if found else None


def _headers(lines: list[bytes]) -> dict[str, str]:
    fields: dict[str, str] = {}
    for line in lines:
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError as e:
            raise ArchiveError(f"a header is not UTF-8: {e}") from e
        if text[:1] in (" ", "\t") and fields:  # a folded line goes on with the one before
            fields[next(reversed(fields))] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        if not colon or key.lower() in fields and key.lower() != "warc-concurrent-to":
            raise ArchiveError(f"bad or repeated header {key!r}")
        fields[key.lower()] = value.strip()
    return fields


def parse_record(data: bytes) -> dict:
    """The fields of one record, after checks of its version, headers, lengths and digest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/[01]\.\d+", lines[0]):
        raise ArchiveError("no WARC version line or no end of headers")
    fields = _headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    length = _number(fields, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {length} does not fit the record")
    kind, block = fields["warc-type"], rest[:length]
    is_page = kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_page else (b"", b"", block)
    size = _number(fields, "x-payload-length") if "x-payload-length" in fields else len(payload)
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if is_page and "x-payload-length" in fields and f"Content-Length: {size}".encode() not in http.split(b"\r\n"):
        raise ArchiveError("the response's length differs from the payload's")
    if kind == "revisit" and payload and is_page:
        raise ArchiveError("a revisit carries a payload")
    if kind != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if len(payload) != size or algorithm == "sha256" and is_page and own != digest:
            raise ArchiveError("the payload differs from its length or digest")
        digest = own  # other algorithms are not checked
    return {
        "page_id": _page_id(fields, "warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload": payload, "payload_bytes": size,
        "payload_digest": digest or None, "refers_to": _page_id(fields, "warc-refers-to") if kind == "revisit" else None,
    }


def open_archive(dictionary: bytes) -> bytes:
    """The leading frame."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at a position ends, found from its block headers."""
    if data[at : at + 4] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at {at}")
    if at + 6 > len(data):
        raise ArchiveError("a frame is cut short")
    checksum = data[at + 4] >> 2 & 1
    try:
        at += zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"bad frame header: {e}") from e
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    if at + 4 * checksum > len(data):
        raise ArchiveError("a frame is cut short")
    return at + 4 * checksum


def _unpacked(decoder: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """A frame's content, whether or not its header states the size."""
    try:
        return decoder.decompressobj().decompress(frame)
    except zstandard.ZstdError as e:
        raise ArchiveError(f"a frame does not decode: {e}") from e


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, one frame each. A dictionary may itself be a frame; other skippable frames are passed over."""
    if len(data) < 8:
        raise ArchiveError("no dictionary frame at the start")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ArchiveError("no dictionary frame at the start")
    raw = data[8 : 8 + size]
    if raw[:4] == FRAME_MAGIC:
        raw = _unpacked(zstandard.ZstdDecompressor(), raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        if at + 8 <= len(data) and int.from_bytes(data[at : at + 4], "little") >> 4 == DICTIONARY_MAGIC >> 4:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                raise ArchiveError("a skippable frame is cut short")
            continue
        end = frame_end(data, at)
        yield parse_record(_unpacked(decoder, data[at:end]))
        at = end


def train_dictionary(pages: DataFrame, sample_rows: int = 256, sample_bytes: int = 8192, size: int = 16_384) -> bytes:
    """A dictionary from the heads of at most sample_rows pages; it changes sizes only, never results."""
    heads = pages.select(F.substring(F.col("html").cast("binary"), 1, sample_bytes).alias("head")).filter("length(head) >= 64").limit(sample_rows).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r.head) for r in heads]).as_bytes()
    except zstandard.ZstdError:  # too few or too even samples: an empty dictionary
        return b""


def marked(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload (binary), payload_digest and refers_to per row of pages.

    Only digests held by several rows are joined back, so a corpus without copies shuffles nothing
    but its digests, pre-counted in each task.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    copies = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1").select("payload_digest", "first_id")
    # Written first: its size is then known, and a join that shuffles can split a hot digest's rows.
    copies = written(copies, f"{shared_dir(pages.sparkSession)}/copies")
    joined = rows.join(copies, "payload_digest", "left")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, path: str, dictionary: bytes, archive_bytes: int = 4_000_000, level: int = 3) -> DataFrame:
    """Writes marked() rows as a table of archives (data binary, n_records int) at a shared path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **known)
        frames, held = [open_archive(dictionary)], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary()), pa.array([len(frames) - 1], pa.int32())], ["data", "n_records"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                frames.append(packer.compress(build_record(*row)))
                held += len(frames[-1])
                if held >= archive_bytes:
                    yield close()
                    frames, held = frames[:1], 0
        if len(frames) > 1:
            yield close()

    return written(records.mapInArrow(run, "data binary, n_records int"), path)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of a table of archives; a broken archive fails the job."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    types = {"url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, expected in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                records = list(read_archive(data.as_py()))
                if expected is not None and len(records) != expected:
                    raise ArchiveError(f"{len(records)} records where {expected} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], types.get(n, pa.int64())) for n in names], names)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return archives.select("data", "n_records").mapInArrow(run, schema)


def save_files(archives: DataFrame, folder: str) -> None:
    """Writes each archive to a .warc.zst file in a folder that all executors have mounted, under a name made from its content.

    A file appears whole or not at all, and a task that runs again writes the same files.
    """

    def run(rows: Iterator) -> None:
        for r in rows:
            path = f"{folder}/{hashlib.sha256(r.data).hexdigest()[:32]}.warc.zst"
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(r.data)
            os.replace(f.name, path)

    archives.select("data").foreachPartition(run)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the .warc.zst files at a path; a file is read by one task, and has under 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return read_archives(files.select(F.col("content").alias("data"), F.lit(None).cast("int").alias("n_records")), with_payload)


def round_trip(pages: DataFrame, least_bytes: int = 100, with_payload: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and returns the records read back from them."""
    archives = write_archives(marked(pages, least_bytes), f"{shared_dir(pages.sparkSession)}/warc", train_dictionary(pages))
    return read_archives(archives, with_payload)
