"""Walks over nested values of any depth, some depths a round; a round goes on with what the one before left unopened."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Depth beyond which a value counts as endless.
DEEPEST = 1000
#: Depths that one round goes through before its rows are written.
STEPS = 8
#: The fields of a span.
SPAN = ("unit_id", "start", "end", "quote")


def kind_of(value: Column) -> Column:
    """object, array, null, string, or the name of another scalar type."""
    # named once, as each mention in a condition would be worked out anew
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return F.replace(F.lower(name), F.lit("void"), F.lit("null"))


def has_fields(value: Column, *names: str) -> Column:
    """Whether a value is an object with all these fields, null ones too."""
    return reduce(lambda a, b: a & b, [F.try_variant_get(value, f"$.{n}", "variant").isNotNull() for n in names])


def walk(rows: DataFrame, id_col: str, json_col: str, whole: Column | None = None) -> DataFrame:
    """(id, path, shape, depth, kind, value) of every value in JSON texts, the outermost first ($).

    path names the place ($.a[0].b), shape the same with * for places in arrays; value is a variant. Values for which
    `whole` (a condition on `value`) holds are not gone into. Texts that are null or no JSON have one row of kind
    `problem`. More than DEEPEST depths are an error. Of fields with one name in an object the parser refuses the object.
    """

    def entered(fresh: Column) -> Column:
        once, twice = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
        return F.explode(F.when(fresh & ~(F.lit(False) if whole is None else F.coalesce(whole, F.lit(False))), twice).otherwise(once))

    return _found(rows, id_col, json_col, entered, kind=_kind(), value=F.col("value"))


def _found(rows: DataFrame, id_col: str, json_col: str, entered: Callable[[Column], Column], **columns: Column) -> DataFrame:
    """(id, path, shape, depth, *columns) of the values in JSON texts that are not `open`; `entered` gives that for fresh ones.

    A round replaces open values by those inside them, STEPS times, and hands on the others as they are. It writes these
    once, and what it left open for the next round, but no value on the way.
    """
    names = ["id", "path", "shape", "depth"]
    now, found = _outermost(rows, id_col, json_col, entered), []
    for _ in range(0, DEEPEST, STEPS):
        for _ in range(STEPS):
            now = _opened(now, entered)
        done = [F.when(~F.col("open"), c).alias(f"__{n}") for n, c in columns.items()]
        table = written(now.where(~F.col("open") | _has_inner()).select(*names, F.when(F.col("open"), F.col("value")).alias("value"), *done, "open"), "values")
        found.append(table.where("NOT open").select(*names, *[F.col(f"__{n}").alias(n) for n in columns]))
        now = table.where("open").select(*names, "value", "open")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, found)
    raise ValueError(f"values are nested more than {DEEPEST} deep")


def _outermost(rows: DataFrame, id_col: str, json_col: str, entered: Callable[[Column], Column]) -> DataFrame:
    first = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit("$").alias("shape"), F.lit(0).alias("depth"), F.try_parse_json(json_col).alias("value"))
    return first.withColumn("open", entered(F.lit(True)))


def _opened(now: DataFrame, entered: Callable[[Column], Column], ends: bool = False) -> DataFrame:
    """Open rows replaced by the values directly inside them, others as they are. Open rows with nothing inside are kept as
    they are if `ends`, else dropped."""
    rows = now.sparkSession.sql("SELECT t.*, e.pos AS __pos, e.key AS __key, e.value AS __inner FROM {now} AS t, LATERAL variant_explode_outer(CASE WHEN t.open THEN t.value END) AS e", now=now)
    if not ends:
        rows = rows.where("NOT open OR __pos IS NOT NULL")
    fresh = F.col("__pos").isNotNull()
    step = lambda place: F.when(F.col("__key").isNull(), place).otherwise(F.concat(F.lit("."), "__key"))
    either = lambda new, old: F.when(fresh, new).otherwise(F.col(old)).alias(old)
    path = F.concat("path", step(F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))))
    rows = rows.select("id", either(path, "path"), either(F.concat("shape", step(F.lit("[*]"))), "shape"), either(F.col("depth") + 1, "depth"), either(F.col("__inner"), "value"), fresh.alias("fresh"))
    return rows.withColumn("open", entered(F.col("fresh"))).drop("fresh")


def _kind() -> Column:
    return F.when(F.col("value").isNull(), "problem").otherwise(kind_of(F.col("value")))


def _has_inner() -> Column:
    return F.coalesce(kind_of(F.col("value")).isin("object", "array"), F.lit(False))


def leaves(walked: DataFrame) -> DataFrame:
    """(id, path, shape, kind, text) of the values that are neither objects nor arrays; null has a null text."""
    return walked.where(~F.col("kind").isin("object", "array", "problem")).select("id", "path", "shape", "kind", F.try_variant_get("value", "$", "string").alias("text"))


def leaf_shapes(rows: DataFrame, json_col: str) -> DataFrame:
    """(shape, kind, n, least): the leaves() of JSON texts by place, how many there are and the least text.

    A round counts what it found without writing it; only if something is left unopened, that is written and gone on with.
    """
    def entered(fresh: Column) -> Column:
        return fresh

    now, found = _outermost(rows.select(F.lit(0).alias("__id"), json_col), "__id", json_col, entered), []
    inner = F.col("kind").isin("object", "array")
    for _ in range(0, DEEPEST, STEPS):
        for _ in range(STEPS):
            now = _opened(now, entered, ends=True)
        judged = now.select("shape", "open", _kind().alias("kind"), F.try_variant_get("value", "$", "string").alias("text"))
        counts = written(judged.groupBy("shape", "kind", "open").agg(F.count("*").alias("n"), F.min("text").alias("least")), "shapes")
        found.append(counts.where(~inner & (F.col("kind") != "problem")))
        if counts.where(inner & F.col("open")).isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy("shape", "kind").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        now = written(now.where(F.col("open") & _has_inner()), "values")
    raise ValueError(f"values are nested more than {DEEPEST} deep")


def spans(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, unit_id, start, end, quote, shaped) of every span in JSON texts, at any depth; nothing inside one is
    looked at. shaped: strings and whole numbers where they should be, the start not negative and before the end."""
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    of = lambda name: kind_of(F.try_variant_get("value", f"$.{name}", "variant"))
    typed = (of("unit_id") == "string") & (of("quote") == "string") & (of("start") == "bigint") & (of("end") == "bigint")
    fields = {"unit_id": get("unit_id", "string"), "start": get("start", "long"), "end": get("end", "long"), "quote": get("quote", "string")}
    # only what is no span is opened, so what stays is spans
    found = _found(rows, id_col, json_col, lambda fresh: fresh & ~F.coalesce(has_fields(F.col("value"), *SPAN), F.lit(False)), typed=typed, **fields)
    shaped = F.col("typed") & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    return found.select("id", "path", *fields, F.coalesce(shaped, F.lit(False)).alias("shaped"))
