"""Scores of annotations against references. What is undefined is null, never 0."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..storage import written
from .ranks import elements, index_rank, numbered


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; null where a denominator is 0."""
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def counts(rows: DataFrame, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn) of booleans; a null prediction is none, a null truth is left out."""
    t, p = F.col(truth), F.coalesce(F.col(predicted), F.lit(False))
    rows = rows.where(t.isNotNull())
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def micro(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 over all rows, or for each group."""
    by = by or []
    return counts(rows, truth, predicted, by).select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(per_group: DataFrame) -> DataFrame:
    """Means of the defined precision, recall and F1 of groups, with how many groups define each."""
    names = ("precision", "recall", "f1")
    return per_group.agg(*[F.avg(n).alias(n) for n in names], *[F.count(n).alias(f"n_{n}") for n in names], F.count("*").alias("n_groups"))


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list[str], absent: str = "abstain") -> DataFrame:
    """(truth, predicted, n) for every label against every label and `absent`; no prediction counts as absent."""
    session = rows.sparkSession
    grid = session.createDataFrame([(t, p) for t in labels for p in [*labels, absent]], f"{truth} string, {predicted} string")
    found = rows.groupBy(F.col(truth), F.coalesce(predicted, F.lit(absent)).alias(predicted)).agg(F.count("*").alias("n"))
    return grid.join(found, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_label(matrix: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """One-against-rest precision, recall and F1 of each label from a confusion table."""
    grid = matrix.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = F.col("n")
    rows = grid.join(matrix, (F.col("label") == F.col(truth)) | (F.col("label") == F.col(predicted)))
    sums = rows.groupBy("label").agg(
        F.sum(F.when((F.col(truth) == F.col("label")) & (F.col(predicted) == F.col("label")), n).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col(truth) != F.col("label")) & (F.col(predicted) == F.col("label")), n).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col(truth) == F.col("label")) & (F.col(predicted) != F.col("label")), n).otherwise(0)).alias("fn"),
    )
    return sums.select("label", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def anchored_agreement(a: DataFrame, b: DataFrame, anchor: list[str], fields: list[str]) -> DataFrame:
    """(field, n_pairs, n_equal, share) on anchors that just one row of either side has; nulls agree with nulls."""
    one = lambda rows: rows.withColumn("__n", F.count("*").over(Window.partitionBy(*anchor))).where("__n = 1").select(*anchor, *fields)
    pairs = one(a).join(one(b).withColumnsRenamed({f: f"__b_{f}" for f in fields}), anchor)
    sums = pairs.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).eqNullSafe(F.col(f"__b_{f}"))).alias(f) for f in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n_pairs"), F.col(f).alias("n_equal")) for f in fields])).alias("x")).select("x.*", ratio(F.col("x.n_equal"), F.col("x.n_pairs")).alias("share"))


def compare_annotators(a: DataFrame, b: DataFrame, anchor: list[str], fields: list[str]) -> DataFrame:
    """(anchor, side, differing): full outer join of two annotators; side is both, a_only or b_only."""
    left = a.select(*anchor, *fields, F.lit(True).alias("__a"))
    right = b.select(*anchor, *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(True).alias("__b"))
    rows = left.join(right, anchor, "full")
    side = F.when(F.col("__b").isNull(), "a_only").when(F.col("__a").isNull(), "b_only").otherwise("both")
    differing = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__b_{f}")), f) for f in fields]), lambda x: x.isNotNull())
    return rows.select(*anchor, side.alias("side"), F.when(side == "both", differing).alias("differing"))


def covers(predicted: Column, reference_sets: Column) -> Column:
    """Whether the predicted spans cover all spans of at least one set: same unit, start no later, end no earlier."""
    span = lambda g: F.exists(predicted, lambda p: (p.unit_id == g.unit_id) & (p.start <= g.start) & (p.end >= g.end))
    return F.exists(reference_sets, lambda s: F.forall(s, span))


def greatest_matching(edges: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """A matching of greatest size between predictions and references, by augmenting paths in order of their ids."""
    near: dict[str, list[str]] = {}
    for p, g in sorted(set(edges)):
        near.setdefault(p, []).append(g)
    owner: dict[str, str] = {}
    for start in near:
        came: dict[str, str] = {}
        queue, at, free = [start], 0, None
        while at < len(queue) and free is None:
            p = queue[at]
            at += 1
            for g in near[p]:
                if g not in came:
                    came[g] = p
                    if g not in owner:
                        free = g
                        break
                    queue.append(owner[g])
        while free is not None:
            p = came[free]
            previous = next((g for g, q in owner.items() if q == p), None) if p != start else None
            owner[free] = p
            free = previous
    return sorted((p, g) for g, p in owner.items())


def match_documents(edges: DataFrame, document: str, prediction: str, reference: str) -> DataFrame:
    """(document, prediction, reference): a greatest matching within each document; edges are the acceptable pairs.

    A document's pairs are matched in one task; they come from one document, not from the corpus.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = greatest_matching(zip(pdf[prediction], pdf[reference], strict=True))
        return pd.DataFrame({document: [pdf[document].iloc[0]] * len(found), prediction: [p for p, _ in found], reference: [g for _, g in found]})

    rows = edges.select(document, F.col(prediction).cast("string").alias(prediction), F.col(reference).cast("string").alias(reference)).distinct()
    return rows.groupBy(document).applyInPandas(run, rows.schema)


def bootstrap(clusters: DataFrame, draws: int = 2000, seed: int = 20261004) -> DataFrame:
    """(metric, low, high, n_undefined): 95 % intervals of precision, recall and F1 by resampling clusters.

    clusters: (cluster, tp, fp, fn). Of k clusters in order of their names, draw d takes as its i-th the one at the first 15
    hexadecimal digits of md5(seed:d:i) modulo k, so any task can tell any draw's clusters; draws are summed where they are
    made, and only their three sums are gathered. Percentiles are elements, not interpolated. Draws for which a metric is
    undefined are counted. Fewer than two clusters give nulls and no undefined draws.
    """
    spark = clusters.sparkSession
    rows = written(numbered(clusters.select(F.col("cluster").cast("string"), "tp", "fp", "fn"), ["cluster", "tp", "fp", "fn"], no=F.lit(True)).withColumn("at", F.col("no") - 1), "clusters")
    k = rows.count()
    if k < 2:
        none = F.lit(None).cast("double")
        return spark.createDataFrame([("precision",), ("recall",), ("f1",)], "metric string").select("metric", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("n_undefined"))
    taken = spark.range(draws * k).select(F.floor(F.col("id") / k).alias("draw"), F.pmod("id", F.lit(k)).alias("i"))
    digits = F.left(F.md5(F.concat_ws(":", F.lit(seed), "draw", "i").cast("binary")), F.lit(15))
    taken = taken.select("draw", F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(k)).alias("at"))
    times = taken.groupBy("draw", "at").agg(F.count("*").alias("times"))
    total = lambda c: F.sum(F.col(c) * F.col("times")).alias(c)
    sums = times.join(rows.select("at", "tp", "fp", "fn"), "at").groupBy("draw").agg(*map(total, ("tp", "fp", "fn")))
    each = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in zip(("precision", "recall", "f1"), prf(F.col("tp"), F.col("fp"), F.col("fn")), strict=True)])
    values = written(sums.select(F.explode(each).alias("x")).select("x.*"), "draws")
    found = elements(values, "metric", "value", low=index_rank(0.025), high=index_rank(0.975))
    undefined = values.groupBy("metric").agg(F.count_if(F.col("value").isNull()).alias("n_undefined"))
    return undefined.join(found, "metric", "left").select("metric", "low", "high", "n_undefined")
