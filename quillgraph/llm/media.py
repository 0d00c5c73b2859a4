"""Media columns: documents as sequences of text and references to media, whose payloads a digest join resolves.

Payloads are stored as 8-bit greyscale images (PNG) that are 64 samples wide: lossless, and any image reader opens them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, attach, rebatch, stage, tidy

WIDTH = 64
#: Fixed values of the image format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = frozenset(("img", "video", "audio", "source", "embed"))
HIDDEN_TAGS = frozenset(("script", "style", "noscript", "template"))
BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


class _Sequence(HTMLParser):
    """Items in document order: [kind, text, ref, caption, figure]; figures: captions of each, with where they stood."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.open: list[int] = []
        self.figures: list[list[tuple[int, str]]] = []
        self.captions: list[tuple[int, int, list[str]]] = []

    def _flush(self) -> None:
        if text := " ".join("".join(self.buffer).split()):
            self.items.append(["text", text, None, None, None])
        self.buffer = []

    def _end_caption(self) -> None:
        figure, at, parts = self.captions.pop()
        if text := " ".join("".join(parts).split()):
            self.figures[figure].append((at, text))

    def _end_figure(self) -> None:
        """Captions go to the figure's own media; a figure without any leaves them as text where they stood."""
        self._flush()
        while self.captions and self.captions[-1][0] == self.open[-1]:
            self._end_caption()
        figure = self.open.pop()
        found, self.figures[figure] = self.figures[figure], []
        media = [i for i in self.items if i[4] == figure]
        for item in media if found else ():
            item[3] = " ".join(text for _, text in found)
        for at, text in () if media else reversed(found):
            self.items.insert(at, ["text", text, None, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag in MEDIA_TAGS:
            found = dict(attrs)
            if ref := found.get("src"):
                self._flush()
                self.items.append([{"img": "image", "embed": "object"}.get(tag, tag), None, ref, found.get("alt") or None, self.open[-1] if self.open else None])
        elif tag == "figure":
            self._flush()
            self.open.append(len(self.figures))
            self.figures.append([])
        elif tag == "figcaption" and self.open:
            self._flush()
            self.captions.append((self.open[-1], len(self.items), []))
        elif tag in BLOCK_TAGS:
            self._break()

    def _break(self) -> None:
        self._flush()
        if self.captions:
            self.captions[-1][2].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.captions and self.captions[-1][0] == self.open[-1]:
            self._end_caption()
        elif tag == "figure" and self.open:
            self._end_figure()
        elif tag in BLOCK_TAGS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            in_caption = self.captions and self.captions[-1][0] == self.open[-1]
            (self.captions[-1][2] if in_caption else self.buffer).append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered text and media references of a page. A figure's caption goes to the media that are its own and not an inner
    figure's, else the alt text does."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader._end_figure()
    reader._flush()
    return [{"position": i, "kind": kind, "text": text, "ref": ref, "caption": caption} for i, (kind, text, ref, caption, _) in enumerate(reader.items)]


def sequences(pages: DataFrame, html_col: str = "html", out: str = "items") -> DataFrame:
    """All columns of pages but the html, with `out`: an array of ITEM in document order. Null and empty html give no
    items; a column named as `out` is replaced; repeated rows stay; an empty table gives an empty table."""
    rest = pages.drop(out).columns
    kept = [c for c in rest if c != html_col]
    item = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], html_col):
                items = [sequence(h) for h in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(items, item)], [*kept, out])

    rows = pages.select(*kept, html_col)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.drop(html_col).schema.fields, T.StructField(out, T.ArrayType(ITEM))]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A greyscale image of WIDTH columns whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered, 1)) + _chunk(b"IEND", b"")


def decode_image(image: bytes) -> bytes:
    """The samples of an image that encode_image wrote; ValueError if it is not one or is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("not such an image")
    at, data, height = 8, [], 0
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(image[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if width != WIDTH or form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale of the right width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def pad(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return payload + bytes(max(1, -(-len(payload) // WIDTH)) * WIDTH - len(payload))


def feature(payload: bytes) -> str:
    """Size, mean and spread of the samples, and which of 64 equal stretches are brighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    cuts = np.arange(64) * len(samples) // 64
    means = np.add.reduceat(samples.astype(np.int64), cuts) / np.diff(np.append(cuts, len(samples)))
    bits = int(np.packbits(means > samples.mean()).view(">u8")[0])
    return f"{WIDTH}x{len(samples) // WIDTH};mean={samples.mean():.4f};std={samples.std():.4f};hash={bits:016x}"


def store_media(payloads: DataFrame, digest_col: str, payload_col: str) -> DataFrame:
    """(digest, media): payloads as images, written to and read from the shared folder.

    Payload values are text or binary; null counts as empty. A task keeps one of equal payloads that meet in a batch;
    a digest may still have several rows, which are equal. Other columns play no part; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], "payload", 4_000_000):
                found = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                media = [encode_image(pad(p or b"")) for p in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    rows = payloads.select(F.col(digest_col).alias("digest"), F.col(payload_col).cast("binary").alias("payload"))
    return stage(rows.mapInArrow(tidy(run), "digest string, media binary"), "media", compression="none")


def media_features(store: DataFrame) -> DataFrame:
    """One row for each digest of a store, however many it has there, from the bytes read back: sizes, checksums and a
    feature. Null media are an error; an empty store gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], "media", 4_000_000):
                columns: list[list] = [[] for _ in range(6)]
                for image in batch.column(1):
                    image = image.as_py()
                    payload = decode_image(image)
                    for column, value in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = store.mapInArrow(tidy(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in names[1:]])


def resolve(documents: DataFrame, media: DataFrame, items_col: str = "items", prefix: str = "sha256:") -> DataFrame:
    """A row for each item of each document, with the columns of `media` (one row for each digest) where it refers to one.

    Position and caption stay with their item. References that media lacks, and text items, have nulls there. A hot
    digest's references are spread over all tasks. Documents without items give no row. Columns of the documents that are
    named like an item's fields or like columns of `media` are left out.
    """
    rest = [c for c in documents.columns if c not in (items_col, *ITEM.names, *media.columns)]
    items = documents.select(*rest, F.explode(items_col).alias(f"{P}item")).select(*rest, f"{P}item.*")
    items = items.withColumn(f"{P}digest", F.when(F.col("ref").startswith(prefix), F.substring("ref", len(prefix) + 1, 64)))
    sizes = items.where(F.col(f"{P}digest").isNotNull()).groupBy(f"{P}digest").agg(F.count("*").alias(f"{P}size"))
    known = stage(media.withColumnRenamed("digest", f"{P}digest").join(sizes, f"{P}digest"), "resolved")
    total = known.agg(F.sum(f"{P}size")).first()[0] or 0
    return attach(items, known, f"{P}digest", f"{P}size", total, F.xxhash64(*rest, "position")).drop(f"{P}digest", f"{P}size")
