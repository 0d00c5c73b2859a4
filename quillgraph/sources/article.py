"""Articles of saved pages as typed units: paragraphs, methods, captions, footnotes and table cells with their geometry.

A page is read once into a flat outline: elements in order of their start, each with the span of events that lies inside
it, so what an element holds is a slice and what holds it is found by its parent's number.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without an end, elements whose text is none, and the classes and names that mark kinds of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "noscript"))
WRAPPERS = frozenset(("tw", "table-wrap"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MOST_COLUMNS = 100

IMAGE = "array<struct<url:string,alt:string,path:string>>"
UNIT = "array<struct<unit_id:string,kind:string,role:string,locator:string,text:string,section:string,source_element_id:string,images:array<struct<url:string,alt:string,path:string>>,table_id:string,row:int,column:int,rowspan:int,colspan:int,header:boolean>>"
TABLE = "array<struct<table_id:string,number:int,path:string,section:string,wrapper_path:string,role:string,row_count:int,column_count:int,cell_count:int,empty_cells:int,image_cells:int,section_id:string,cells:array<struct<row:int,column:int,header:boolean,text:string,image_count:int,unit_id:string>>>>"
LINK = "array<struct<url:string,text:string,path:string>>"
REPAIR = "array<struct<closing_tag:string,unclosed_tags:array<string>,path:string>>"


class Refused(ValueError):
    """What keeps a page from being an article; nothing of it is taken."""


@dataclass
class Element:
    """number: place among the elements; inside: its elements' numbers end before this; events: span of its text."""

    number: int
    parent: int
    tag: str
    attributes: dict[str, str | None]
    path: str
    first: int
    inside: int = 0
    last: int = 0
    counted: Counter = field(default_factory=Counter)

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()


class Outline(HTMLParser):
    """The elements of a page, its text events (text, number of the element), and the repairs of ends left out.

    An end tag closes the nearest open element of its name, and with it all that are open inside, which is logged. An end
    without a start is passed over. Paths count among siblings of one name.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element(0, -1, "", {}, "", 0)]
        self.events: list[tuple[str, int]] = []
        self.repairs: list[dict] = []
        self.open = [0]
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        """Close the open elements from a depth on."""
        for number in self.open[depth:]:
            self.elements[number].inside, self.elements[number].last = len(self.elements), len(self.events)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        parent = self.elements[self.open[-1]]
        parent.counted[tag] += 1
        self.open.append(len(self.elements))
        self.elements.append(Element(len(self.elements), parent.number, tag, dict(attrs), f"{parent.path}/{tag}[{parent.counted[tag]}]", len(self.events)))
        if tag == "br":
            self.events.append((" ", self.open[-1]))
        if tag in VOID:
            self._end(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        names = [self.elements[n].tag for n in self.open]
        if tag in names[1:]:
            depth = len(names) - 1 - names[::-1].index(tag)
            if left := names[depth + 1 :]:
                self.repairs.append({"closing_tag": tag, "unclosed_tags": left, "path": self.elements[self.open[depth]].path})
            self._end(depth)

    def handle_data(self, data: str) -> None:
        self.events.append((data, self.open[-1]))

    def above(self, element: Element) -> Iterator[Element]:
        """The elements around one, the nearest first."""
        number = element.parent
        while number > 0:
            yield self.elements[number]
            number = self.elements[number].parent

    def within(self, element: Element) -> list[Element]:
        """An element and all inside it, in order."""
        return self.elements[element.number : element.inside]

    def text(self, element: Element) -> str:
        """Its text with single spaces; that of scripts and styles is none."""
        silent = {e.number for e in self.within(element) if e.tag in SILENT}
        for e in self.within(element):
            if e.parent in silent:
                silent.add(e.number)
        return " ".join("".join(text for text, number in self.events[element.first : element.last] if number not in silent).split())

    def children(self, element: Element, *tags: str) -> list[Element]:
        return [e for e in self.within(element)[1:] if e.parent == element.number and e.tag in tags]

    def section(self, element: Element) -> str:
        """The first headings of the sections around an element, from the outside in."""
        heads = (self.children(e, *HEADINGS[:4])[:1] for e in self.above(element) if e.tag in ("section", "article"))
        return " / ".join([self.text(h[0]) for h in heads if h][::-1])

    def images(self, element: Element, base: str) -> list[dict]:
        return [{"url": web_address(base, e.attributes.get("src") or ""), "alt": e.attributes.get("alt") or "", "path": e.path} for e in self.within(element) if e.tag == "img"]


def web_address(base: str, value: str) -> str | None:
    """The address that a reference in a page stands for, None unless it is of the web."""
    try:
        found = urljoin(base, value)
        return found if urlsplit(found).scheme in ("http", "https") else None
    except ValueError:  # no address at all
        return None


def grid(outline: Outline, table: Element) -> tuple[list[tuple[Element, int, int, int, int]], int, int]:
    """(cells with row, column, rowspan and colspan; rows; columns) of a table. Spans out of the table, over MOST_COLUMNS
    columns or over another cell are refused, as places would be guesses."""
    rows, taken, cells = [e for e in outline.within(table) if e.tag == "tr"], set(), []
    for row, tr in enumerate(rows, 1):
        column = 1
        for cell in outline.children(tr, "th", "td"):
            while (row, column) in taken:
                column += 1
            spans = [cell.attributes.get(n, "1") or "" for n in ("rowspan", "colspan")]
            if not all(s.strip().isdecimal() and len(s) < 10 for s in spans):
                raise Refused(f"invalid span at {cell.path}")
            height, width = map(int, spans)
            if not (1 <= height <= len(rows) - row + 1 and 1 <= width <= MOST_COLUMNS):
                raise Refused(f"invalid span at {cell.path}")
            places = {(row + i, column + j) for i in range(height) for j in range(width)}
            if places & taken:
                raise Refused(f"overlapping cells at {cell.path}")
            taken |= places
            cells.append((cell, row, column, height, width))
            column += width
    return cells, len(rows), max((c for _, c in taken), default=0)


def parse_article(html: str, document_id: str, base: str) -> dict:
    """The units of a page's one article, its tables, images and supplement links, and what was repaired; Refused if the
    page has no or several articles, nested tables or impossible spans."""
    page = Outline(html)
    articles = [e for e in page.elements if e.tag == "article"]
    if len(articles) != 1:
        raise Refused(f"one article is needed, found {len(articles)}")
    article, units, tables = articles[0], [], []
    inside = page.within(article)

    def add(element: Element, kind: str, role: str | None, locator: str, **shape: object) -> str | None:
        if not (text := page.text(element)):
            return None
        none = dict.fromkeys(("table_id", "row", "column", "rowspan", "colspan", "header"))
        name = f"{document_id}:html:{sha256(element.path.encode()).hexdigest()[:20]}"
        units.append({"unit_id": name, "kind": kind, "role": role, "locator": locator, "text": text, "section": page.section(element), "source_element_id": element.attributes.get("id"), "images": page.images(element, base), **none, **shape})
        return name

    for number, table in enumerate((e for e in inside if e.tag == "table"), 1):
        around = list(page.above(table))
        if any(e.tag == "table" for e in around):
            raise Refused("nested tables")
        cells, rows, columns = grid(page, table)
        table_id, placed = f"{document_id}:table:{number}", []
        for cell, row, column, height, width in cells:
            where = f"html:{cell.path}; table {number}; row {row}; column {column}; rowspan {height}; colspan {width}"
            unit = add(cell, "table_cell", None, where, table_id=table_id, row=row, column=column, rowspan=height, colspan=width, header=cell.tag == "th")
            placed.append({"row": row, "column": column, "header": cell.tag == "th", "text": page.text(cell), "image_count": len(page.images(cell, base)), "unit_id": unit})
        named = next((e.attributes["id"] for e in around if e.tag == "section" and e.attributes.get("id")), None)
        wrapper = next((e for e in around if WRAPPERS.intersection(e.classes())), page.elements[table.parent])
        role = "equation" if "disp-formula" in (table.attributes.get("class") or "") else "table"
        tables.append({"table_id": table_id, "number": number, "path": table.path, "section": page.section(table), "wrapper_path": wrapper.path, "role": role, "row_count": rows, "column_count": columns, "cell_count": len(cells), "empty_cells": sum(c["unit_id"] is None for c in placed), "image_cells": sum(c["image_count"] > 0 for c in placed), "section_id": named, "cells": placed})

    after = 0  # inside a unit no other begins
    for e in inside:
        if e.number < after:
            continue
        if e.tag == "table":
            after = e.inside
            continue
        classes = e.classes()
        footnote, caption = "tw-foot" in classes or e.tag == "footer", "caption" in classes
        item = e.tag == "li" and not any(x.tag == "p" for x in page.within(e))
        if e.tag in ("td", "th") or not (footnote or caption or item or e.tag == "p" or e.tag in HEADINGS):
            continue
        after = e.inside
        kind = "footnote" if footnote else "caption" if caption else "methods" if "method" in page.section(e).lower() else "paragraph"
        marks = " ".join(x.attributes.get(n) or "" for x in (e, *page.above(e)) for n in ("class", "id"))
        add(e, kind, "bibliography" if "ref-list" in marks else "heading" if e.tag in HEADINGS else "text", "html:" + e.path)

    links = [(e, e.attributes["href"]) for e in inside if e.tag == "a" and e.attributes.get("href")]
    links = [{"url": web_address(base, href), "text": page.text(e), "path": e.path} for e, href in links if "/bin/" in href or "supplement" in href.lower()]
    return {
        "units": sorted(units, key=lambda u: u["unit_id"]), "tables": tables, "images": page.images(article, base),
        "supplement_links": [x for x in links if x["url"]], "repairs": [r for r in page.repairs if r["path"].startswith(article.path)],
    }


FOUND = f"problem string, units {UNIT}, tables {TABLE}, images {IMAGE}, supplement_links {LINK}, repairs {REPAIR}"


def articles(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """(id, problem, units, tables, images, supplement_links, repairs) of each page, units in order of their ids.

    problem says why a page is refused, and then the arrays are empty; null html is a page without an article, a null
    address resolves nothing. Repeated rows stay; an empty table gives an empty table. Text in an element is held once.
    """
    rows = pages.select(F.col(id_col).alias("__id"), F.col(id_col).cast("string").alias("__name"), F.col(html_col).alias("__html"), F.col(url_col).alias("__base"))
    kinds = pa.schema([("found", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {"units": [], "tables": [], "images": [], "supplement_links": [], "repairs": []}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, found = batch.slice(at, 64), []
                for name, html, base in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    try:
                        found.append({"problem": None, **parse_article(html or "", name or "", base or "")})
                    except Refused as e:
                        found.append({"problem": str(e), **empty})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([json.dumps(f, ensure_ascii=False) for f in found], kinds[0].type)], ["__id", "found"])

    parsed = rows.mapInArrow(run, T.StructType([rows.schema["__id"], T.StructField("found", T.StringType())]))
    return parsed.select(F.col("__id").alias(id_col), F.from_json("found", FOUND).alias("found")).select(id_col, "found.*")


def cells(found: DataFrame, id_col: str) -> DataFrame:
    """(id, table_id, section, section_id, row, column, header, text, image_count, unit_id) of every cell that articles()
    found, empty ones too; section_id is the name of the innermost section around the table that has one."""
    tables = found.select(id_col, F.explode("tables").alias("t")).select(id_col, "t.table_id", "t.section", "t.section_id", F.explode("t.cells").alias("c"))
    return tables.select(id_col, "table_id", "section", "section_id", "c.*")


def table_rows(found: DataFrame, id_col: str, *sources: str) -> DataFrame:
    """(id, the columns `sources`, table_id, row, cells, has_images) of every row of tables, with where it comes from; cells
    are the texts in order of columns. A page without tables is an error when the plan runs."""
    some = F.when(F.size("tables") > 0, F.col("tables")).otherwise(F.raise_error(F.concat(F.lit("no tables: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast(found.schema["tables"].dataType))
    tables = found.select(id_col, *sources, F.explode(some).alias("t"))
    rows = F.array_sort(F.array_distinct(F.transform("t.cells", lambda c: c.row)))
    rows = tables.select(id_col, *sources, "t.table_id", "t.cells", F.explode(rows).alias("row"))
    mine = F.array_sort(F.transform(F.filter("cells", lambda c: c.row == F.col("row")), lambda c: F.struct(c.column.alias("column"), c.text.alias("text"), c.image_count.alias("images"))))
    return rows.select(id_col, *sources, "table_id", "row", F.transform(mine, lambda c: c.text).alias("cells"), F.exists(mine, lambda c: c.images > 0).alias("has_images"))


def elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, number, parent, tag, path) of every element of pages, in order; parent is 0 for the outermost. Null html has none."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html"))
    names = ["__id", "number", "parent", "tag", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, html in enumerate(batch.column(1).to_pylist()):
                found = Outline(html or "").elements[1:]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(found), pa.int64())), pa.array([e.number for e in found], pa.int32()), pa.array([e.parent for e in found], pa.int32()), pa.array([e.tag for e in found], pa.string()), pa.array([e.path for e in found], pa.string())], names)

    schema = T.StructType([rows.schema["__id"], *T._parse_datatype_string("number int, parent int, tag string, path string").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def counts(found: DataFrame, id_col: str, *more: Column) -> DataFrame:
    """(id, problem, units, paragraphs, ..., repairs): how much of each kind articles() found in each page, and more."""
    of = lambda kind: F.size(F.filter("units", lambda u: u.kind == kind))
    kinds = {"paragraphs": "paragraph", "methods": "methods", "captions": "caption", "footnotes": "footnote", "table_cells": "table_cell"}
    total = lambda name: F.aggregate("tables", F.lit(0), lambda n, t: n + t[name])
    return found.select(
        id_col, "problem", F.size("units").alias("units"), *[of(kind).alias(name) for name, kind in kinds.items()], F.size(F.filter("units", lambda u: u.role == "heading")).alias("headings"),
        F.size("tables").alias("tables"), total("cell_count").alias("cells"), total("empty_cells").alias("empty_cells"), total("image_cells").alias("image_cells"),
        F.size("images").alias("images"), F.size("supplement_links").alias("supplement_links"), F.size("repairs").alias("repairs"), *more,
    )
