"""Routing of questions to lookups, by fixed rules in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gene_mentions, substitutions

# The words that each rule looks for, in the order of the rules.
RULES = (
    ("clinical", r"\b(treat|treatment|cure|dose|dosage|medication|diagnose|diagnosis|take a drug)\b"),
    ("conflict", r"\b(conflict|conflicting|contradict|contradiction|uncertain)\w*\b"),
    ("asset", r"\b(asset|assets|resource|resources|reuse|reusable|partner|partners)\b"),
    ("evidence", r"\b(evidence|source|sources|support|proof|paper|papers)\b"),
    ("connections", r"\b(connect|connected|connection|connections|related|why|similar)\b"),
    ("describe", r"\b(what|tell|describe|about|show|who)\b"),
    ("overview", r"\b(overview|graph|start|here|explore)\b"),
)


def intent(text: str) -> Column:
    """The first rule whose words the question has; 'missing' if none has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in RULES:
        out = F.when(low.rlike(words), name) if out is None else out.when(low.rlike(words), name)
    return out.otherwise("missing")


def filters(questions: DataFrame, text: str, gene: str, protein: str) -> DataFrame:
    """questions with `gene`, `protein` and `problem`: the filters that a search applies.

    What is given (columns gene and protein, null if not) comes before what the text mentions; a single mention becomes a
    filter. problem is null, 'gene' (given, but not of the family), 'protein' (given, but no single substitution) or
    'protein_without_gene', as a substitution alone is ambiguous.
    """
    named, changed, given = gene_mentions(text), substitutions(text), substitutions(protein)
    only = lambda found: F.when(F.size(found) == 1, found[0])
    which = F.when(F.col(gene).isNotNull(), F.upper(gene)).otherwise(only(named))
    what = F.when(F.col(protein).isNotNull(), only(given)).when(which.isNotNull(), only(changed))
    problem = F.when(F.col(gene).isNotNull() & (F.size(gene_mentions(gene)) != 1), "gene").when(F.col(protein).isNotNull() & (F.size(given) != 1), "protein").when(what.isNotNull() & which.isNull(), "protein_without_gene")
    rest = [c for c in questions.columns if c not in (gene, protein, "problem")]
    return questions.select(*rest, which.alias("gene"), what.alias("protein"), problem.alias("problem"))


def _words(text: str | Column) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.filter(F.split(low, r"(?U)\W+"), lambda w: w != "")


def mentions(questions: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, type, length) of all nodes whose label or an alias (over two characters) a question mentions as whole
    words, in any case; length is that of the longest term mentioned.

    A term is looked up by its longest word, so only questions with that word meet it.
    """
    terms = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in nodes.columns else F.array("label")
    rows = nodes.select(F.col("id").alias("node"), "type", F.explode(F.array_distinct(F.transform(terms, F.lower))).alias("term")).where(F.length("term") > 2)
    rows = rows.withColumn("word", F.array_min(F.transform(_words("term"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))).w).where("word IS NOT NULL")
    asked = questions.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"), F.explode(F.array_distinct(_words(text_col))).alias("word"))
    whole = F.rlike("low", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("term"), F.lit(r"\E(?!\w)")))
    return asked.join(rows, "word").where(F.contains("low", "term") & whole).groupBy("id", "node", "type").agg(F.max(F.length("term")).alias("length"))


def routed(questions: DataFrame, nodes: DataFrame, id_col: str, text_col: str, context: DataFrame | None = None) -> DataFrame:
    """(id, intent, about, other) of every question: which lookup answers it and about which node.

    about is the longest mention (then the least id), else the node of `context` (id, node), if that is given. Clinical questions are refused; two diseases are compared (about and
    other); then the rules of intent() hold, of which some need a node and the overview needs none.
    """
    found = mentions(questions, nodes, id_col, text_col)
    if context is not None:
        given = context.join(nodes.select(F.col("id").alias("node"), "type"), "node").join(found, ["id", "node"], "left_anti")
        found = found.unionByName(given.select("id", "node", "type", F.lit(0).alias("length")))
    order = F.struct((-F.col("length")).alias("n"), "node")
    best = found.groupBy("id").agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.when(F.col("type") == "Disease", order))).alias("diseases"))
    rows = questions.select(F.col(id_col).alias("id"), intent(text_col).alias("rule")).join(best, "id", "left")
    pair = F.coalesce(F.size("diseases") >= 2, F.lit(False))
    about = F.when(F.col("rule") == "clinical", None).when(pair, F.get("diseases", F.lit(0)).node).otherwise(F.col("first.node"))
    lost = (F.col("rule").isin("evidence", "connections", "describe") & about.isNull()) | ((F.col("rule") == "overview") & about.isNotNull())
    name = F.when(F.col("rule") == "clinical", "clinical").when(pair, "compare").when(lost, "missing").otherwise(F.col("rule"))
    return rows.select("id", name.alias("intent"), about.alias("about"), F.when(pair & (F.col("rule") != "clinical"), F.get("diseases", F.lit(1)).node).alias("other"))


def answer_claims(routes: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, claim_id): the claims that answer routed questions about a node.

    connections and describe: claims of the node; evidence: these and the effects of its variants; conflict: claims of the
    node or its variants that some evidence contradicts. Questions that name no node have no rows: what they all share,
    and comparisons and assets, are in answers.scope_claims.
    """
    ends = claims.select(F.col("id").alias("claim_id"), "predicate", "subject", F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"))
    variants = claims.where("predicate = 'HAS_VARIANT'").select(F.col("subject").alias("about"), F.col("object").alias("node")).distinct()
    against = evidence.where("stance = 'contradicts'").select("claim_id").distinct()
    asked = routes.where(F.col("intent").isin("connections", "describe", "evidence", "conflict"))
    named = asked.where("about IS NOT NULL").select("id", "intent", "about")
    own = named.withColumnRenamed("about", "node").join(ends, "node").select("id", "intent", "claim_id")
    near = named.where(F.col("intent").isin("evidence", "conflict")).join(variants, "about").join(ends, "node").where((F.col("intent") == "conflict") | ((F.col("predicate") == "HAS_EFFECT") & (F.col("subject") == F.col("node")))).select("id", "intent", "claim_id")
    both = own.union(near).distinct()
    plain, disputed = both.where("intent <> 'conflict'"), both.where("intent = 'conflict'").join(against, "claim_id", "left_semi")
    return plain.select("id", "claim_id").union(disputed.select("id", "claim_id"))


def route(question: str, nodes: DataFrame, selected: str | None = None, claim_context: tuple[str, ...] = ()) -> dict[str, object]:
    """One question by the rules of routed(); a question for evidence that names no node is about the claims at hand."""
    spark = nodes.sparkSession
    one = spark.createDataFrame([(0, question)], "id int, text string")
    context = spark.createDataFrame([(0, selected)], "id int, node string") if selected else None
    if claim_context and spark.range(1).select(intent(F.lit(question))).first()[0] == "evidence" and mentions(one, nodes, "id", "text").isEmpty():
        return {"intent": "claim_evidence", "about": None, "compare": []}
    found = routed(one, nodes, "id", "text", context).first()
    return {"intent": found.intent, "about": found.about, "compare": [found.about, found.other] if found.other else []}
