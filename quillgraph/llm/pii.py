"""Personal data: fixed patterns for what has a fixed form, and a conditional random field for what else looks like it."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import any_names, rebatch, tidy
from .crf import Crf, luhn, train

#: Kinds, in the order in which spans of one start are listed. The field alone finds the last.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every span has one of these, so texts without any have no span.
MARK = re.compile(r"[0-9@]|[\[(](?:at|AT|dot|DOT)[\])]")
#: Characters of texts that are decoded together, and bytes of texts that a worker takes from a batch at once.
TOGETHER, BATCH_BYTES = 1_000_000, 2_000_000
#: At most so many rows of a labelled table are trained on.
MOST_ROWS = 2_000
SPAN = "array<struct<kind:string,start:int,end:int>>"

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @, which takes linear time on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in code points; the kinds are numbers in KINDS."""
    found = [(s, e, 0) for s, e in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def tagged_spans(text: str, tags: np.ndarray, names: list[str], base: list[Span]) -> list[Span]:
    """Spans of the tags of a text's words that have a mark and meet no base span; without a sentence's marks around them."""
    if not tags.any():
        return []
    words, found = list(re.finditer(r"\S+", text)), []
    at = -1
    for i in np.flatnonzero(tags).tolist():
        if i < at:
            continue
        kind, at = names[tags[i]][2:], i + 1
        while at < len(tags) and names[tags[at]] == "I-" + kind:
            at += 1
        start, stop = words[i].start(), words[at - 1].end()
        while start < stop and text[start] in "\"'<[,;:=":
            start += 1
        while stop > start and text[stop - 1] in "\"'>],;:.!?*#%&$":
            stop -= 1
        if start < stop and MARK.search(text, start, stop) and not any(s < stop and start < e for s, e, _ in base):
            found.append((start, stop, KINDS.index(kind)))
    return found


def all_spans(texts: list[str], field: Crf) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans sorted) of each text; the field decodes the words of whole texts."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (held == 0 or held + len(texts[end]) <= TOGETHER):
            held += len(texts[end])
            end += 1
        some = [t if MARK.search(t) else "" for t in texts[at:end]]
        for text, tags in zip(some, field.decode([t.split() for t in some]), strict=True):
            base = base_spans(text)
            yield base, sorted(base + tagged_spans(text, tags, field.tags, base), key=lambda x: (x[0], x[2]))
        at = end


def labelled_table(spark: SparkSession, n: int = 300, seed: int = 7) -> DataFrame:
    """A small labelled table (words, tags), made by rule: invented sentences with and without personal data."""
    return spark.createDataFrame(labelled_rows(n, seed), "words array<string>, tags array<string>")


def labelled_rows(n: int = 300, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    plain = lambda: "".join(rng.choice(["an", "er", "the", "in", "ou", "st", "re", "que", "ung", "ción"]) for _ in range(rng.randint(1, 4)))
    mail = lambda: (f"{plain()}.{digits(2)}", f"{plain()}{rng.choice(['', digits(1)])}")
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 40])))

    def number(valid: bool) -> str:
        """16 digits that pass Luhn's check or fail it."""
        while luhn(found := digits(16)) != valid:
            pass
        return found

    def personal() -> tuple[str, list[str], int]:
        """Kind, words, and how many of the first words belong to the context only."""
        user, host = mail()
        return rng.choice(
            [
                lambda: ("email", [f"{user}@{host}.example.com"], 0),
                lambda: ("email", [user, rng.choice(["(at)", "[at]"]), f"{host}.example", rng.choice(["(dot)", "[dot]"]), "com"], 0),
                lambda: ("email", [f"{user}[at]{host}[dot]com"], 0),
                lambda: ("ip", [".".join(str(rng.randint(1, 255)) for _ in range(4))], 0),
                lambda: ("card", [number(True)], 0),
                lambda: ("phone", [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], 0),
                lambda: ("phone", [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], 0),
                lambda: ("phone", [f"{digits(3)}-{digits(3)}-{digits(4)}"], 0),
                lambda: ("secret", [rng.choice(["token", "api_key", "secret", "password"]), "=", f'"{hexes()}"'], 2),
                lambda: ("secret", [rng.choice(["token:", "key:", "password:"]), hexes()], 1),
            ]
        )()

    def other() -> list[str]:
        return rng.choice(
            [
                lambda: [str(rng.randint(1900, 2030))],
                lambda: ["Version", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}."],
                lambda: ["BY-NC", "4.0."],
                lambda: [f"{digits(2)}%"],
                lambda: ["page", digits(rng.randint(1, 3))],
                lambda: [f"{digits(2)}:{digits(2)}"],
                lambda: [f"{digits(4)}-{digits(2)}-{digits(2)}"],
                lambda: [f"{digits(1)},{digits(3)}", plain()],
                lambda: [f"{digits(1)}rd"],
                lambda: ["@", plain()],
                lambda: [f"@{plain()}"],
                lambda: ["isbn", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"],
                lambda: [f"{plain()}{digits(1)}"],
                lambda: [digits(rng.choice([1, 2, 3, 5, 6, 7]))],
                lambda: [number(False)],
                lambda: [number(False)],
                lambda: ["token", "=", plain()],
            ]
        )()

    rows = []
    for i in range(n):
        words, tags = [], []
        for _ in range(rng.randint(1, 5)):
            words.append(plain() + rng.choice(["", "", "", ",", "."]))
            tags.append("O")
        if i % 2:
            kind, some, context = personal()
            some = [*some[:-1], some[-1] + rng.choice(["", "", ",", ".", "%%%", "!!"])]
            words += some
            tags += ["O"] * context + ["B-" + kind] + ["I-" + kind] * (len(some) - context - 1)
        else:
            some = other()
            words += some
            tags += ["O"] * len(some)
        for _ in range(rng.randint(1, 5)):
            words.append(plain() + rng.choice(["", "", "", ",", ".", "###"]))
            tags.append("O")
        rows.append((words, tags))
    return rows


def train_field(labelled: DataFrame) -> Crf:
    """A field from a small labelled table (words, tags) of at most MOST_ROWS rows; an empty one gives a field that finds
    nothing. Rows without words are left out, repeated ones count each; null words or tags are not allowed. Of a larger
    table Spark takes the rows that it comes to first."""
    return train([(list(r.words), list(r.tags)) for r in labelled.limit(MOST_ROWS).collect()])


@any_names
def find_spans(docs: DataFrame, field: Crf, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with base_spans and spans: (kind, start, end) in code points, end exclusive.

    base_spans are the matches of the fixed patterns, leftmost and not overlapping within a kind; spans has them and
    those that the field adds, which overlap none of them and hold a digit, an @ or one spelled out. Both are sorted by
    start and kind. Null text counts as empty. Columns of these names are replaced; repeated rows stay; an empty table gives an empty table.
    """
    rows = docs.drop("base_spans", "spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], text_col, BATCH_BYTES):
                found = list(all_spans([t or "" for t in batch.column(text_col).to_pylist()], field))
                columns = [pa.array([as_rows(spans[i]) for spans in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "base_spans", "spans"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"base_spans {SPAN}, spans {SPAN}").fields]))


@any_names
def redact(docs: DataFrame, field: Crf, text_col: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    Texts without spans, null ones too, stay as they are. Repeated rows stay; other columns play no part; an empty table
    gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rebatch([whole], text_col, BATCH_BYTES):
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], field)
                texts = [_redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def _redacted(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
