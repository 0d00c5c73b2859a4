"""Candidates that share something with a source and nothing better: made from classes, ranked without sorting pairs.

Diseases that hold the same are one class. What a class shares with others is put in order once; a disease of the class
takes this list without those that are candidates for a better reason, so each rank is a place in the list and a number of
places that are missing before it. A row for each pair is made only as the result is read: nothing of that size is
written, shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .ranks import numbered
from .spread import attached, joined_in_blocks

#: Places of a list that are one row, and rows of the result that one task makes.
BLOCK, ROWS = 2000, 5_000_000


def classes(held: DataFrame) -> DataFrame:
    """held (disease, class, ...) with `leader`, the least disease of those with an equal class; class is a sorted array."""
    held = written(held, "held")
    leaders = held.groupBy("class").agg(F.min("disease").alias("leader"), F.count("*").alias("__n"))
    return written(attached(held, leaders, "class", "__n", held.count(), F.col("disease")).drop("__n"), "classes")


def class_pairs(held: DataFrame, sources: DataFrame) -> DataFrame:
    """(mine, theirs, shared): the classes of the source diseases with all that they share something with, themselves too."""
    every = written(held.where("disease = leader").select(F.col("leader").alias("theirs"), F.explode("class").alias("shared")), "all_classes")
    asked = held.join(sources.select("disease").distinct(), "disease", "left_semi").select(F.col("leader").alias("theirs")).distinct()
    mine = written(every.join(asked, "theirs", "left_semi").withColumnRenamed("theirs", "mine"), "own_classes")
    return joined_in_blocks(mine, every, "shared", ("mine", "theirs")).groupBy("mine", "theirs").agg(F.array_sort(F.collect_set("shared")).alias("shared"))


def ranked(held: DataFrame, sources: DataFrame, judged: DataFrame, most: int, order: Sequence[str], **item: Column) -> tuple[DataFrame, DataFrame]:
    """(disease, other, rank) of the judged candidates, and (what sources holds, other, those of `item`, rank) of all others
    that share something with the disease.

    held: classes(), with the columns of `order`. sources: (disease, ...), unique. judged: (disease, other, at, tie, ...), a
    written table: `at` is the rank among the judged; all come before the others but for ties. Others are in the order of
    how much they share, at most `most`, then of `order` and of their id; a tie is a judged candidate that stands among
    those that share `most`. item: columns of the result from those of held (disease is `other`) and `shared`.
    """
    spark = held.sparkSession
    own = written(sources.join(held.select("disease", F.col("leader").alias("mine")), "disease"), "own")
    members = written(held.withColumnsRenamed({"disease": "other", "leader": "theirs"}), "members")
    pairs = joined_in_blocks(written(class_pairs(held, sources), "class_pairs"), members, "theirs", ("mine", "other"))
    place = ["mine", "__lower", *order, "other"]
    entries = pairs.select("mine", (-F.least(F.lit(most), F.size("shared"))).alias("__lower"), *order, "other", F.lit(True).alias("entry"), F.struct("other", *[c.alias(n) for n, c in item.items()]).alias("item"))
    probes = judged.where("tie").join(own.select("disease", "mine"), "disease").select("mine", F.lit(-most).alias("__lower"), *order, "other", F.lit(False).alias("entry")).distinct()
    placed = written(numbered(entries.unionByName(probes.withColumn("item", F.lit(None).cast(entries.schema["item"].dataType))), place, no=F.col("entry")), "numbered")
    one = F.col("entry").cast("long")
    lists = written(placed.groupBy("mine").agg(F.min(F.col("no") - one).alias("start"), F.sum(one).alias("length"), F.count("*").alias("__n")), "lists")
    placed = attached(placed, lists, "mine", "__n", placed.count(), F.col("other"))
    placed = written(placed.select("mine", "other", "entry", (F.col("no") - F.col("start") - one).alias("pos"), "item"), "placed")

    asked = judged.join(own.select("disease", "mine"), "disease").select("disease", "mine", "other", "tie")
    asked = asked.unionByName(own.select("disease", "mine", F.col("disease").alias("other"), F.lit(False).alias("tie")))
    events = written(asked.join(placed.drop("item"), ["mine", "other"]).where("entry OR tie").select("disease", "other", "entry", "pos"), "events")
    gone = F.array_sort(F.collect_list(F.when(F.col("entry"), F.col("pos")))).alias("gone")
    more = F.array_sort(F.collect_list(F.when(~F.col("entry"), F.col("pos")))).alias("more")
    moved = written(events.groupBy("disease").agg(gone, more), "moved")
    before = lambda c, at: F.size(F.filter(c, lambda x: x < at))

    ties = events.where(~F.col("entry") & (F.col("pos") > 0)).join(moved, "disease").select("disease", "other", (F.col("pos") - before("gone", F.col("pos"))).alias("later"))
    ranks = judged.join(ties, ["disease", "other"], "left").select("disease", "other", (F.col("at") + F.coalesce("later", F.lit(0))).cast("int").alias("rank"))

    first = judged.groupBy("disease").agg(F.count_if(~F.col("tie")).alias("first"))
    none = F.array().cast("array<bigint>")
    own = own.join(lists.select("mine", "length").where("length > 0"), "mine").join(moved, "disease", "left").join(first, "disease", "left")
    own = own.withColumns({"gone": F.coalesce("gone", none), "more": F.coalesce("more", none), "first": F.coalesce("first", F.lit(0))})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(own.agg(F.sum("length")).first()[0] or 0) // ROWS))
    cut = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK))))
    low, high = F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("length"))
    inside = lambda c: F.filter(c, lambda x: (x >= low) & (x < high))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(low, high), inside("gone"), inside("more"), inside(F.transform("gone", lambda x: x + 1)))))
    cut = cut.withColumn("cuts", cuts)
    shift = lambda at: F.col("first") + F.size(F.filter("more", lambda x: x <= at)) - before("gone", at) + 1
    runs = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda at, i: F.struct(at.alias("at"), F.get("cuts", i + 1).alias("to"), shift(at).alias("shift")))
    runs = F.filter(runs, lambda r: ~F.array_contains("gone", r.at))
    runs = cut.select(*sources.columns, "mine", "block", F.explode(runs).alias("run")).repartition(parts, "mine", "block")
    blocks = placed.where("entry").select("mine", F.floor(F.col("pos") / BLOCK).alias("block"), F.struct("pos", "item.*").alias("item"))
    blocks = blocks.groupBy("mine", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    blocks = written(blocks, "blocks").repartition(parts, "mine", "block")
    some = F.slice("items", (F.col("run.at") - low + 1).cast("int"), (F.col("run.to") - F.col("run.at")).cast("int"))
    rows = runs.join(blocks, ["mine", "block"]).select(*sources.columns, F.col("run.shift").alias("__shift"), F.inline(some))
    return ranks, rows.select(*rows.columns[: len(sources.columns)], "other", *item, (F.col("pos") + F.col("__shift")).cast("int").alias("rank"))
