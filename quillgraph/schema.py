"""The data model: an evidence graph as five tables, with its enumerations and typing rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the data model.
NODE_TYPES = ("Asset", "Disease", "Funding", "Gene", "Mechanism", "Organization", "Person", "Phenotype", "Publication", "Study", "Variant")
ASSERTION_TYPES = ("inferred", "reported")
SOURCE_KINDS = ("database", "fixture", "organization", "paper", "registry")
STANCES = ("contradicts", "supports")
REVIEW_STATUSES = ("human_reviewed", "machine_checked", "unreviewed")
COVERAGE_STATUSES = ("failed", "not_searched", "searched")
EFFECTS = ("gain_of_function", "loss_of_function", "unknown")
#: Predicate: allowed types of subject and object; None stands for any type.
PREDICATES = {
    "AFFECTS": (("Variant",), ("Gene",)),
    "AFFILIATED_WITH": (("Person",), ("Organization",)),
    "AUTHORED": (("Person",), ("Publication",)),
    "CONTRAINDICATED_FOR": (("Asset",), ("Disease",)),
    "FUNDS": (("Funding",), ("Asset", "Study")),
    "HAS_EFFECT": (("Variant",), ("Mechanism",)),
    "HAS_PHENOTYPE": (("Disease",), ("Phenotype",)),
    "HAS_VARIANT": (("Disease",), ("Variant",)),
    "INVOLVES": (("Disease",), ("Mechanism",)),
    "IS_A": (("Phenotype",), ("Phenotype",)),
    "MAINTAINS": (("Organization",), ("Asset",)),
    "RELEVANT_TO": (("Asset",), ("Disease",)),
    "REPRESENTS": (("Organization",), ("Disease",)),
    "SAME_AS": (None, None),
    "STUDIES": (("Person", "Study"), ("Disease", "Mechanism")),
    "USED_IN": (("Asset",), ("Study",)),
}
#: Order of claim states: the first that holds is the claim's.
CLAIM_STATES = ("negated", "contradicted", "inferred_only", "unsupported", "supported", "review_required")

NODES = "ord long, id string, type string, label string, aliases array<string>, properties string"
SOURCES = "ord long, id string, title string, url string, kind string, published_at string, retrieved_at string, synthetic boolean, license string"
CLAIMS = "ord long, id string, subject string, predicate string, object string, assertion_type string, effect string, negated boolean, species string, tissue string, stage string, confidence double"
EVIDENCE = "ord long, id string, claim_id string, source_id string, locator string, excerpt string, stance string, review_status string"
COVERAGE = "ord long, id string, source_id string, entity_id string, scope string, status string, searched_at string, notes string"


@dataclass(frozen=True)
class EvidenceGraph:
    """Typed nodes joined by claims; each claim is backed or contradicted by evidence from sources."""

    nodes: DataFrame
    sources: DataFrame
    claims: DataFrame
    evidence: DataFrame
    coverage: DataFrame | None = None
    #: How many parts the claims and the evidence are dealt into where tasks sort or hash them; None: the session's.
    parts: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, nodes=(), sources=(), claims=(), evidence=(), coverage=()) -> EvidenceGraph:
        """A graph from rows, given as dicts; missing fields are null and ord is the position."""
        made = []
        for rows, schema in ((nodes, NODES), (sources, SOURCES), (claims, CLAIMS), (evidence, EVIDENCE), (coverage, COVERAGE)):
            names = [f.split()[0] for f in schema.split(", ")]
            made.append(spark.createDataFrame([tuple({"ord": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], schema))
        return cls(*made)


def predicate_rules(spark: SparkSession) -> DataFrame:
    """(predicate, subject_type, object_type) of every allowed combination: a fixed, small table."""
    rows = [(p, s, o) for p, (ss, os) in PREDICATES.items() for s in ss or NODE_TYPES for o in os or NODE_TYPES]
    return spark.createDataFrame(rows, "predicate string, subject_type string, object_type string")

#: Synthetic sources have addresses at this host or below it.
FIXTURE_HOST = "example.org"
