"""Exports of a graph: linked data, and elements of a drawing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EvidenceGraph


def percent_encoded(x: Column) -> Column:
    """Percent-encoding of everything but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def linked_data(graph: EvidenceGraph) -> DataFrame:
    """(kind, id, json): one JSON-LD object for each record; claims and evidence are records of their own.

    Nulls are left out. References to other records are {"@id": ...}.
    """
    iri = lambda c: F.struct(percent_encoded(F.col(c)).alias("@id"))
    links = {"subject", "object", "claim_id", "source_id", "entity_id"}

    def records(kind: str, rows: DataFrame) -> DataFrame:
        fields = [iri(c).alias(c) if c in links else F.col(c) for c in rows.columns if c not in ("id", "ord")]
        key = F.col("id") if "id" in rows.columns else F.concat_ws("|", *rows.columns)
        body = F.to_json(F.struct(percent_encoded(key).alias("@id"), F.lit(kind.capitalize()).alias("@type"), *fields))
        return rows.select(F.lit(kind).alias("kind"), key.alias("id"), body.alias("json"))

    tables = {"node": graph.nodes, "source": graph.sources, "claim": graph.claims}
    if "id" in graph.evidence.columns:
        tables["evidence"] = graph.evidence
    if graph.coverage is not None:
        tables["coverage"] = graph.coverage
    return reduce(DataFrame.union, [records(kind, rows) for kind, rows in tables.items()])


def elements(graph: EvidenceGraph) -> DataFrame:
    """(role, id, kind, source, target): an element for each record, two edges for each claim, evidence and coverage."""
    drawn = {"node": (graph.nodes, None), "source": (graph.sources, None), "claim": (graph.claims, ("subject", "object"))}
    if "id" in graph.evidence.columns:
        drawn["evidence"] = (graph.evidence, ("claim_id", "source_id"))
    if graph.coverage is not None:
        drawn["coverage"] = (graph.coverage, ("source_id", "entity_id"))
    none = F.lit(None).cast("string")
    rows = []
    for kind, (table, ends) in drawn.items():
        mine = percent_encoded(F.col("id"))
        rows.append(table.select(F.lit("node").alias("role"), F.concat(F.lit(kind + ":"), mine).alias("id"), F.lit(kind).alias("kind"), none.alias("source"), none.alias("target")))
        if ends:
            edge = lambda end, i: F.struct(F.concat_ws(":", F.lit(kind), mine, F.lit(i)).alias("id"), (percent_encoded(F.col(end)) if i == "to" else mine).alias("target"), (mine if i == "to" else percent_encoded(F.col(end))).alias("source"))  # noqa: B023, E731
            two = table.select(F.explode(F.array(edge(ends[0], "from").cast("struct<id:string,target:string,source:string>"), edge(ends[1], "to").cast("struct<id:string,target:string,source:string>"))).alias("e"))
            rows.append(two.select(F.lit("edge").alias("role"), "e.id", F.lit(kind).alias("kind"), "e.source", "e.target"))
    return reduce(DataFrame.union, rows)
