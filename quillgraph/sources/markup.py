"""Marked-up pages and records as rows: units of articles, links, table cells, XML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and columns that a cell of an HTML table may span.
MOST_ROWS, MOST_COLUMNS = 1_000, 100

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
UNIT_KINDS = {"p": "paragraph", "li": "paragraph", "td": "table_cell", "th": "table_cell", "caption": "caption", "figcaption": "caption"}
OUTSIDE = frozenset(("script", "style", "nav", "footer", "header", "aside"))


class _Article(HTMLParser):
    """Units (kind, section, text) of what stands inside the article, or the whole page if there is none."""

    def __init__(self, everything: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.inside = everything
        self.skip = 0
        self.headings: list[tuple[int, str]] = []
        self.unit: str | None = None
        self.words: list[str] = []
        self.units: list[tuple[str, str, str]] = []

    def close_unit(self) -> None:
        text = " ".join("".join(self.words).split())
        if self.unit and text:
            if self.unit in HEADINGS:
                level = int(self.unit[1])
                self.headings = [h for h in self.headings if h[0] < level] + [(level, text)]
            else:
                self.units.append((UNIT_KINDS[self.unit], " > ".join(t for _, t in self.headings), text))
        self.unit, self.words = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "article":
            self.inside = True
        elif tag in OUTSIDE:
            self.skip += 1
        elif tag in UNIT_KINDS or tag in HEADINGS:
            self.close_unit()
            self.unit = tag

    def handle_endtag(self, tag: str) -> None:
        if tag == "article":
            self.close_unit()
            self.inside = False
        elif tag in OUTSIDE:
            self.skip = max(0, self.skip - 1)
        elif tag == self.unit:
            self.close_unit()

    def handle_data(self, data: str) -> None:
        if self.unit and self.inside and not self.skip:
            self.words.append(data)


def article_units(html: str) -> list[tuple[str, str, str]]:
    reader = _Article("<article" not in html.lower())
    reader.feed(html)
    reader.close()
    reader.close_unit()
    return reader.units


class _Links(HTMLParser):
    """Links as [address, text, place], the place being the navigation or footer that they stand in, else None."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open = False
        self.places: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("nav", "footer"):
            self.places.append(tag)
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, "", self.places[-1] if self.places else None])
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("nav", "footer") and self.places:
            self.places.pop()
        elif tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][1] += data


class _Tables(HTMLParser):
    """Cells at their places in the grids of tables, which may be nested; `problem` says what is wrong with a cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.n = 0
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"number": self.n, "row": 0, "taken": set(), "cell": None, "nested": bool(self.open)})
            self.n += 1
        elif not self.open:
            return
        elif tag == "tr":
            self.finish()
            self.open[-1]["row"] += 1
        elif tag in ("td", "th"):
            self.finish()
            self.start(tag, dict(attrs))
        elif tag == "img" and self.open[-1]["cell"]:
            self.open[-1]["cell"]["images"] += 1

    def start(self, tag: str, found: dict[str, str | None]) -> None:
        table, spans, wrong = self.open[-1], [], "nested" if self.open[-1]["nested"] else None
        for name, most in (("rowspan", MOST_ROWS), ("colspan", MOST_COLUMNS)):
            value = found.get(name) or "1"
            good = re.fullmatch("[0-9]{1,9}", value) is not None and 1 <= int(value) <= most
            spans.append(int(value) if good else 1)
            wrong = wrong if good else "span"
        row, column = max(1, table["row"]), 1
        while (row, column) in table["taken"]:
            column += 1
        places = {(row + i, column + j) for i in range(spans[0]) for j in range(spans[1])}
        if places & table["taken"]:
            wrong = "overlap"
        table["taken"] |= places
        table["cell"] = {"table": table["number"], "row": row, "column": column, "rowspan": spans[0], "colspan": spans[1], "header": tag == "th", "text": "", "images": 0, "problem": wrong}

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self.finish()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"]["text"] += data

    def finish(self) -> None:
        if self.open and (cell := self.open[-1]["cell"]):
            self.cells.append(cell | {"text": " ".join(cell["text"].split())})
            self.open[-1]["cell"] = None


def _flat(rows: DataFrame, id_col: str, columns: list[str], expand, schema: str) -> DataFrame:
    """expand(*columns) gives the tuples that a row becomes; the id goes with each. Null input gives none."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r[0], i, *x) for r in pdf.itertuples(index=False) if isinstance(r[1], str) for i, x in enumerate(expand(*r[1:]))]
            yield pd.DataFrame(out, columns=[id_col, "position", *names])

    full = T.StructType([rows.schema[id_col], T.StructField("position", T.IntegerType()), *T._parse_datatype_string(schema).fields])
    return rows.select(id_col, *columns).mapInPandas(run, full)


def html_units(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, kind, section, text): paragraphs, cells and captions of the article with their headings."""
    return _flat(pages, id_col, [html_col], article_units, "kind string, section string, text string")


def html_links(pages: DataFrame, id_col: str, html_col: str, url_col: str, everywhere: bool = False) -> DataFrame:
    """(id, position, url, text, place): links resolved against the page, http(s) only. place is the `nav` or `footer` that
    a link stands in, else null; links of these two are left out unless asked for `everywhere`."""

    def expand(html: str, base: str | None) -> list[tuple[str, str, str | None]]:
        reader = _Links()
        reader.feed(html)
        found = [(urljoin(base or "", href), " ".join(text.split()), place) for href, text, place in reader.found if everywhere or not place]
        return [x for x in found if urlsplit(x[0]).scheme in ("http", "https")]

    return _flat(pages, id_col, [html_col, url_col], expand, "url string, text string, place string")


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, table, row, column, rowspan, colspan, header, text, images, problem): cells at their place in the grid.

    problem is null, or 'span' (no number from 1 to MOST_ROWS or MOST_COLUMNS; taken as 1), 'overlap' (a place that
    another cell spans) or 'nested' (a table inside a cell). Pages without tables give no rows.
    """

    def expand(html: str) -> list[tuple]:
        reader = _Tables()
        reader.feed(html)
        while reader.open:
            reader.handle_endtag("table")
        return [tuple(c.values()) for c in reader.cells]

    return _flat(pages, id_col, [html_col], expand, "table int, row int, column int, rowspan int, colspan int, header boolean, text string, images int, problem string")


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag as rows of a given schema; Spark's XML source splits large files over tasks."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _node(element: ElementTree.Element) -> dict:
    out: dict = {"tag": element.tag.rpartition("}")[2], "attributes": dict(element.attrib)}
    if text := (element.text or "").strip():
        out["text"] = text
    return out | {"children": [_node(child) for child in element]}


def xml_trees(records: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, position, json): each record's tree as JSON (tag, attributes, text, children), in order, to any depth."""
    return _flat(records, id_col, [xml_col], lambda x: [(json.dumps(_node(ElementTree.fromstring(x)), ensure_ascii=False),)], "json string")


def jats_units(articles: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, position, kind, section, text) of JATS articles: abstract first, then the body; references are left out."""

    def walk(element: ElementTree.Element, path: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
        for child in element:
            tag = child.tag.rpartition("}")[2]
            text = " ".join("".join(child.itertext()).split())
            if tag == "sec":
                title = child.find("{*}title")
                name = " ".join("".join(title.itertext()).split()) if title is not None else ""
                yield from walk(child, (*path, name) if name else path)
            elif tag in ("p", "caption", "table-wrap", "fig"):
                if text:
                    yield ({"p": "paragraph", "caption": "caption", "table-wrap": "table", "fig": "figure"}[tag], " > ".join(path), text)
            elif tag not in ("title", "ref-list"):
                yield from walk(child, path)

    def expand(xml: str) -> Iterator[tuple[str, str, str]]:
        root = ElementTree.fromstring(xml)
        for abstract in root.findall(".//{*}abstract"):
            yield from walk(abstract, ("Abstract",))
        for body in root.findall(".//{*}body"):
            yield from walk(body, ())

    return _flat(articles, id_col, [xml_col], expand, "kind string, section string, text string")


def pages_of_pdf_text(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, text): extracted text split at form feeds, pages from 1."""
    return texts.select(id_col, F.posexplode(F.split(text_col, "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
