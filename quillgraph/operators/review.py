"""Queues of what people should look at: variants that a paper lists, with what another of its tables calls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RESIDUES, blank

#: A substitution in one-letter codes.
LABEL = r"^([A-Z])([0-9]+)([A-Z])$"
# Whether a classification can be read as text.
AVAILABLE, UNREADABLE = "available_as_text", "unavailable_as_text"


def long_form(label: Column) -> Column:
    """A substitution in three-letter codes (p.Arg12Lys), null unless both letters are residues."""
    codes = F.create_map(*[F.lit(x) for long, short in RESIDUES.items() for x in (short, long)])
    part = lambda i: F.regexp_extract(label, LABEL, i)
    return F.concat(F.lit("p."), codes[part(1)], part(2), codes[part(3)])


def labelled_rows(cells: DataFrame, id_col: str, sections: Column) -> DataFrame:
    """(id, table_id, row, label, call, has_image): rows of tables in some sections whose first cell is a substitution; call
    is the text of the last cell, null if it has none. cells: article.cells()."""
    rows = cells.where(sections).groupBy(id_col, "table_id", "row").agg(
        F.trim(F.min_by("text", "column")).alias("label"), F.trim(F.max_by("text", "column")).alias("call"), (F.max_by("image_count", "column") > 0).alias("has_image"),
    )
    return rows.where(F.col("label").rlike(LABEL)).withColumn("call", F.when(~blank("call"), F.col("call")))


def review_queue(cells: DataFrame, id_col: str, listing: str, calls: str, known: DataFrame | None = None) -> DataFrame:
    """(id, label, change, table_id, row, category, status, has_image, already_known) of the substitutions that tables in the
    section `listing` list below their first row, with what tables in the section `calls` call them.

    Of several calls of one label the last row's counts. What is drawn, empty or not there is unavailable as text, and
    nothing is guessed for it. known: (id, change) of what is curated already. Rows that list a label twice stay both.
    """
    listed = labelled_rows(cells, id_col, F.col("section_id") == listing).where("row > 1").select(id_col, "label", "table_id", "row")
    place = F.struct("table_id", "row")
    called = labelled_rows(cells, id_col, F.col("section_id") == calls).groupBy(id_col, "label").agg(F.max_by(F.struct("call", "has_image"), place).alias("found"))
    rows = listed.join(called, [id_col, "label"], "left").withColumn("change", long_form(F.col("label")))
    rows = rows.select(id_col, "label", "change", "table_id", "row", F.col("found.call").alias("category"), F.when(F.col("found.call").isNotNull(), AVAILABLE).otherwise(UNREADABLE).alias("status"), F.coalesce("found.has_image", F.lit(False)).alias("has_image"))
    if known is None:
        return rows.withColumn("already_known", F.lit(False))
    hit = known.select(id_col, "change").distinct().withColumn("already_known", F.lit(True))
    return rows.join(hit, [id_col, "change"], "left").select(*rows.columns, F.coalesce("already_known", F.lit(False)).alias("already_known"))


def expect(queue: DataFrame, id_col: str, n: int) -> DataFrame:
    """The queue, an error when the plan runs unless each document has `n` rows in it."""
    counts = queue.groupBy(id_col).agg(F.count("*").alias("__n"))
    checked = F.when(F.col("__n") == n, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} rows, found "), F.col("__n").cast("string"))).cast("boolean"))
    return queue.join(counts.where(checked).select(id_col), id_col)
