"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Archives are files in the shared folder. Spark's text sink writes them, as it writes the bytes of a value as they are,
one value a file; what it puts behind each value is an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, attach, stage, tidy, work_dir

#: Fixed values of the formats: the skippable frame that holds a dictionary, and a date, as records carry one.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 1000
#: Raw bytes of an archive, bytes of its dictionary, and records that the dictionary is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLES = 16_000_000, 8_192, 64
#: Bytes of a frame that are held at once, and of a record's headers. Payloads are read as streams, so they may be longer.
MOST_FRAME, MOST_HEAD = 1 << 30, 1 << 20
#: Records, and bytes of their payloads, that a reader hands on together.
TOGETHER, TOGETHER_BYTES = 500, 16_000_000
#: Bytes of a frame that are decoded at once.
STEP = 1 << 13
#: An empty skippable frame: its magic number 0x184D2A50 and the length 0.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


@any_names
def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """pages with payload_digest (SHA-1, hex), payload_bytes, record_type and refers_to.

    Of equal payloads of at least `least` bytes the one with the largest id is a response, the others revisit it;
    shorter ones are all responses. Null html counts as empty. Rows that repeat the largest id are all responses.
    A row with a null id revisits the others' largest id; if all ids are null, all are responses.
    """
    rows = pages.drop("payload_digest", "payload_bytes", "record_type", "refers_to")
    rows = rows.withColumns({"payload_digest": F.sha1(payload(F.col(html_col))), "payload_bytes": F.octet_length(payload(F.col(html_col))).cast("long")})
    key = f"{P}key"
    rows = rows.withColumn(key, F.when(F.col("payload_bytes") >= least, F.col("payload_digest")))
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(id_col).alias(f"{P}kept"), F.count("*").alias(f"{P}size"))
    groups = stage(groups.where(F.col(f"{P}size") > 1), "payloads")
    rows = attach(rows, groups, key, f"{P}size", pages.count(), F.col(id_col))
    revisit = F.col(f"{P}kept").isNotNull() & ~F.col(f"{P}kept").eqNullSafe(F.col(id_col))
    return rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col(f"{P}kept"))}).drop(key, f"{P}kept", f"{P}size")


def record(number: int | None, url: str | None, body: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) has the HTTP header but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub("[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary's frame and a frame for each record."""
    samples = [r[:4096] for r in records[:SAMPLES]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves are the dictionary
        trained = b"".join(samples)[:DICTIONARY_BYTES]
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained + b"".join(map(packer.compress, records))


def write_archives(records: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write the archives of planned records, all tasks at once; the folder, a new one in the shared folder by default.

    An archive holds up to ARCHIVE_BYTES of records (a longer record is alone in its own). Spark names the files. Null
    html counts as empty, a null url is left out, a null id gives an empty one; repeated rows are records each. An empty
    table gives a folder without archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["content"])

        for batch in batches:
            for row in range(batch.num_rows):
                number, url, body, digest, n, refers_to = (batch.column(i)[row].as_py() for i in range(6))
                held.append(record(number, url, body, digest, n, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    columns = [F.col(id_col), F.col(url_col), F.when(F.col("refers_to").isNull(), payload(F.col(html_col))).alias("body"), "payload_digest", "payload_bytes", "refers_to"]
    path = path or f"{work_dir(records.sparkSession)}/archives.warc.zst"
    made = records.select(*columns).mapInArrow(tidy(run), "content binary").select(F.col("content").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)
    return path


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all archives of a folder; files without bytes, as Spark writes for empty tasks, are left out. A
    folder without archives gives an empty table, one that is not there is an error."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


class Broken(ValueError):
    """A frame that cannot be decoded to its end; where the next one begins is not known."""


def streams(content: bytes) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, decoded parts) of each frame, under the dictionary of the leading skippable frame; ValueError if broken.

    Parts that are not taken are decoded and dropped when the next frame is asked for.
    """
    view, at, opener = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(view[8 : 8 + size])
                try:
                    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be packed
                        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError as e:
                    raise ValueError(f"the dictionary does not decode: {e}") from e
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        ends: list[int] = []
        parts = _decoded(view, at, opener.decompressobj(), ends)
        yield at, parts
        for _ in parts:
            pass
        at = ends[0]


def _decoded(view: memoryview, at: int, reader: zstandard.ZstdDecompressionObj, ends: list[int]) -> Iterator[bytes]:
    """The parts of the frame at a place; where it ends is added to `ends`. Small steps keep parts small."""
    while not reader.eof:
        if at >= len(view):
            raise Broken("a frame is cut off")
        try:
            part = reader.decompress(view[at : at + STEP])
        except zstandard.ZstdError as e:
            raise Broken(f"a frame does not decode: {e}") from e
        at += min(STEP, len(view) - at) - len(reader.unused_data)
        yield part
    ends.append(at)


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each frame; ValueError if broken or over MOST_FRAME."""
    for start, parts in streams(content):
        made, held = 0, []
        for part in parts:
            made += len(part)
            if made > MOST_FRAME:
                raise ValueError(f"a frame decodes to more than {MOST_FRAME} bytes")
            held.append(part)
        yield start, b"".join(held)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        out[name.strip().lower()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """Fields of one record; ValueError if its headers or lengths are wrong."""
    return parsed(iter([raw]))


def parsed(parts: Iterator[bytes], keep: bool = True) -> dict:
    """Fields of a record that comes in parts, without its payload if not asked to keep it; ValueError as in parse.

    The payload passes through its digest and a count. One of more than MOST_FRAME bytes is not kept; `error` says so.
    """
    held = bytearray()
    for part in parts:
        held += part
        if held.count(b"\r\n\r\n", 0, MOST_HEAD) > 1 or len(held) > MOST_HEAD:
            break
    head, blank, rest = bytes(held).partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    fields = _headers(lines[1:])
    if missing := [n for n in REQUIRED if n.lower() not in fields]:
        raise ValueError(f"no {missing[0]}")
    http, blank, first = rest.partition(b"\r\n\r\n")
    size = _headers(http.split(b"\r\n")[1:]).get("content-length", "") if blank else ""
    # what follows the HTTP header is the body and four bytes that end the record
    sha, n, kept, last = hashlib.sha1(), 0, [], b""
    for part in itertools.chain([first], parts) if blank else ():
        last, part = (last + part)[-4:], (last + part)[:-4]
        sha.update(part)
        n += len(part)
        if keep and n <= MOST_FRAME:
            kept.append(part)
        else:
            kept.clear()
    block = len(http) + len(blank) + n
    if not blank:
        block, last = len(rest) - 4, rest[-4:]
    if not fields["content-length"].isdigit() or block != int(fields["content-length"]) or last != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    if not size.isdigit():
        raise ValueError("no HTTP header with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (n != int(size) or sha.hexdigest() != digest):
        raise ValueError("the payload is not what the headers say")
    if kind == "revisit" and (n or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload or refers to nothing")
    ids = [number(fields["warc-record-id"]), number(fields.get("warc-refers-to"))]
    if kind == "revisit" and ids[1] is None:
        raise ValueError("a revisit refers to no page")
    if int(size) >> 63:
        raise ValueError("a length of more than 63 bits")
    found = {"page_id": ids[0], "url": fields.get("warc-target-uri"), "payload_bytes": int(size), "payload_digest": digest, "record_type": kind, "refers_to": ids[1]}
    if keep and kind == "response" and n > MOST_FRAME:
        found["error"] = f"a payload of more than {MOST_FRAME} bytes is not given"
    elif keep and kind == "response":
        found["payload"] = b"".join(kept)
    return found


def number(urn: str | None) -> int | None:
    """The page that a record id names, or None; ValueError if it has more than 64 bits."""
    if not (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")):
        return None
    if len(m[1]) > 20 or not -(1 << 63) <= int(m[1]) < 1 << 63:
        raise ValueError("a record id of more than 64 bits")
    return int(m[1])


RECORDS = T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path, content), RECORDS: fields, payload, and `error` for what is not valid.

    A record with wrong headers or lengths gives a row with its place and error; an archive whose frames break off
    gives its records up to there and a row with the error. Payloads are validated as streams, of any length; one of more
    than MOST_FRAME bytes is null, with its fields and an error, and all are null without `payloads`. An empty table gives
    an empty table.
    """
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def rows(path: str, content: bytes) -> Iterator[dict]:
        at = 0
        try:
            for at, parts in streams(content):
                try:
                    found = parsed(parts, payloads)
                except Broken:
                    raise
                except ValueError as e:
                    found = {"error": str(e)}
                yield {"path": path, "at": at, **found}
        except ValueError as e:
            yield {"path": path, "at": at, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for row in rows(path.as_py(), content.as_py() or b""):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if len(held) == TOGETHER or size > TOGETHER_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path", "content").mapInArrow(tidy(run), RECORDS)
