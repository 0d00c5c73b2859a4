"""Chat formatting by quotation linking.

Quoted lines (> marks, nested to any level) are parsed, and the hash of each normalised quoted passage is joined to the
message that first said it. A message answers the latest message it quotes; answers form threads, and messages are put
in reply order without their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, any_names, attach, partitions, stage

#: A quoted line: its marks, then the passage.
QUOTED = r"^[ \t]*((?:>[ \t]?)+)(.*)$"


def _normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with lines, an array of (level, passage, hash), and body, the text without quoted lines.

    The level is the number of > marks, 0 for the message's own words. The hash is of the passage in lower case with
    white space squeezed (128 bits), null if nothing is left. Null text counts as empty; columns named lines or body are
    replaced; repeated rows stay; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, QUOTED, 1)
        passage = F.when(marks != "", F.regexp_extract(x, QUOTED, 2)).otherwise(x)
        norm = _normalised(passage)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), passage.alias("passage"), F.when(norm != "", F.md5(norm)).alias("hash"))

    rows = messages.withColumn("lines", F.transform(F.split(text, r"\r?\n"), line))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.passage), "\n")
    return rows.withColumn("body", F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def link_quotes(parsed: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, parent_turn, n_quoted, n_linked) of the messages that quote.

    The original of a passage is the first message of the conversation with the passage among its own words, if it
    comes before the quoting one; parent_turn is the latest original of the quotes of the lowest level that has any.
    Messages without a conversation or turn quote nothing and are not quoted; those that repeat one conversation and turn
    count as one. An empty table gives an empty table.
    """
    lines = parsed.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.explode("lines").alias("line")).select("conv", "turn", "line.level", "line.hash").where("hash IS NOT NULL AND conv IS NOT NULL AND turn IS NOT NULL")
    key = F.struct("conv", "hash")
    quotes = stage(lines.where("level > 0").withColumn("key", key), "quotes")
    wanted = quotes.groupBy("key").agg(F.count("*").alias("uses"))
    said = lines.where("level = 0").groupBy(key.alias("key")).agg(F.min("turn").alias("original"))
    originals = stage(said.join(wanted, "key"), "originals")
    linked = attach(quotes, originals, "key", "uses", quotes.count(), F.xxhash64("turn", "level", "hash"))
    earlier = F.when(F.col("original") < F.col("turn"), F.col("original"))
    found = linked.groupBy("conv", "turn").agg(F.max(F.when(earlier.isNotNull(), F.struct((-F.col("level")).alias("near"), earlier.alias("original")))).alias("best"), F.count("*").alias("n_quoted"), F.count(earlier).alias("n_linked"))
    return found.select("conv", "turn", F.col("best.original").alias("parent_turn"), "n_quoted", "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv, turn, root_turn) of the messages with a parent, by doubling pointers: steps grow with the log of the depth.

    links have one row for each conversation and turn, without nulls in these; no links give an empty table.
    """
    now = stage(links.where("parent_turn IS NOT NULL").select("conv", "turn", F.col("parent_turn").alias("up")), "pointers")
    while True:
        asked = now.withColumn("key", F.struct("conv", F.col("up").alias("turn")))
        known = now.select(F.struct("conv", "turn").alias("key"), F.col("up").alias("further"))
        wanted = asked.groupBy("key").agg(F.count("*").alias("uses")).join(known, "key")
        moved = attach(asked, stage(wanted, "steps"), "key", "uses", now.count(), F.xxhash64("turn"))
        moved = stage(moved.select("conv", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "pointers")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root_turn")


def number_in_order(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """rows with `out`, their number (from 0) within the key by `order`, with no task that gets a whole key.

    Rows are sorted by range over all tasks and counted within each sorted part; a key that goes on over parts gets
    the sums of the parts before, of which there are fewer than two for each part. Rows that tie are numbered in any
    order, null keys are one key, nulls come first; a column named as `out` is replaced; an empty table gives an empty table.
    """
    part, local, first = f"{P}part", f"{P}local", f"{P}first"
    n = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    dealt = stage(dealt.withColumns({part: F.spark_partition_id(), local: F.monotonically_increasing_id()}), "sorted")
    runs = dealt.groupBy(part, key).agg(F.min(local).alias(first), F.count("*").alias("n"))
    edges = runs.groupBy(part).agg(F.min(F.struct(first, F.col(key).alias("k"), "n")).alias("a"), F.max(F.struct(first, F.col(key).alias("k"), "n")).alias("b")).orderBy(part).collect()
    before, offsets, at = None, [], 0
    for edge in edges:  # one row for each part, that is, for each task
        at = at if before is not None and before == (edge.a.k,) else 0
        offsets.append((edge[part], edge.a.k, at))
        at = at + edge.a.n if edge.a.k == edge.b.k else edge.b.n
        before = (edge.b.k,)
    offsets = rows.sparkSession.createDataFrame(offsets, f"{part} int, {P}key {rows.schema[key].dataType.simpleString()}, {P}offset long")
    runs = runs.join(F.broadcast(offsets), (runs[part] == offsets[part]) & runs[key].eqNullSafe(offsets[f"{P}key"]), "left").select(runs[part].alias(f"{P}p"), runs[key].alias(f"{P}k"), first, F.coalesce(f"{P}offset", F.lit(0)).alias(f"{P}offset"), "n")
    runs = stage(runs.withColumn(f"{P}id", F.struct(F.col(f"{P}p").alias("part"), F.col(f"{P}k").alias("key"))).select(f"{P}id", first, f"{P}offset", F.col("n").alias(f"{P}n")), "runs")
    found = attach(dealt.withColumn(f"{P}id", F.struct(F.col(part).alias("part"), F.col(key).alias("key"))), runs, f"{P}id", f"{P}n", dealt.count(), F.col(local))
    return found.withColumn(out, F.col(local) - F.col(first) + F.col(f"{P}offset")).select(*[c for c in rows.columns if c != out], out)


@any_names
def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, parent_turn, root_turn, position, n_quoted, n_linked, body, formatted) of every message.

    Conversations are in reply order: threads by their root's turn, a thread's messages by turn (an answer always
    comes after what it answers), repeated turns by role and body; position counts from 0. body is the text without
    quotes, formatted the body after its role. A message without linked quotes is a root of its own. Nulls: text
    counts as empty, role as 'unknown'; rows without a turn come first and link to nothing, rows without a
    conversation are one conversation and link to nothing. An empty table gives an empty table.
    """
    parsed = parse_quotes(messages.select(conv_col, turn_col, role_col, text_col), text_col)
    links = stage(link_quotes(parsed, conv_col, turn_col), "links")
    rows = parsed.select(conv_col, turn_col, F.coalesce(role_col, F.lit("unknown")).alias(role_col), "body", F.struct(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn")).alias(f"{P}message"))
    if links.isEmpty():
        none = F.lit(None).cast(messages.schema[turn_col].dataType)
        rows = rows.withColumns({"parent_turn": none, "root_turn": F.col(turn_col), "n_quoted": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")})
    else:
        known = links.join(thread_roots(links), ["conv", "turn"], "left").select(F.struct("conv", "turn").alias(f"{P}message"), "parent_turn", "root_turn", "n_quoted", "n_linked")
        sizes = rows.groupBy(f"{P}message").agg(F.count("*").alias(f"{P}size"))
        rows = attach(rows, stage(known.join(sizes, f"{P}message"), "answers"), f"{P}message", f"{P}size", messages.count(), F.xxhash64("body"))
        rows = rows.withColumns({"root_turn": F.coalesce("root_turn", turn_col), "n_quoted": F.coalesce("n_quoted", F.lit(0).cast("long")), "n_linked": F.coalesce("n_linked", F.lit(0).cast("long"))}).drop(f"{P}size")
    rows = number_in_order(rows.drop(f"{P}message"), conv_col, ["root_turn", turn_col, role_col, "body"], "position")
    formatted = F.concat(F.lit("<|"), F.col(role_col), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return rows.select(conv_col, turn_col, role_col, "parent_turn", "root_turn", "position", "n_quoted", "n_linked", "body", formatted.alias("formatted"))
