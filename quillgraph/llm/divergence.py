"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Terms are counted where they are read; the counts are dealt by ranges of terms. Each range keeps its terms as sorted
arrays, whose places are the terms' ids, and turns counts into dense vectors over chunks of ids. As ids are in UTF-8
order, a stable order by value breaks ties as asked. All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, partitions, rebatch, stage, tidy
from .tokens import byte_classes, words

#: All of ASCII but letters parts terms.
LETTERS = byte_classes(bytes(b for b in range(128) if not chr(b).isalpha()))
#: Terms of a chunk, and sources of a block; a task compares two blocks on one chunk.
CHUNK, BLOCK = 2048, 32
#: Rows of partial counts that a task holds, and of summed counts that are cut into chunks at once.
HELD, AT_ONCE = 400_000, 100_000
#: Rows of headers that share one copy of a language's pairs of blocks.
SHARED = 64

COUNTS = "lang string, source string, term binary, n long, docs long"
VECTORS = "lang string, chunk long, source string, n long, counts binary, terms array<binary>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms and documents with them, for each language and source, summed as far as a task can hold."""
    groups: dict[tuple[str, str], int] = {}
    found: list[pa.Table] = []
    held = 0

    def summed() -> pa.Table:
        table = pa.concat_tables(found).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table({name: table[column] for name, column in (("group", "group"), ("term", "term"), ("n", "n_sum"), ("docs", "docs_sum"))})

    def named(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = list(groups)
        langs, sources = (pa.array([k[i] for k in keys], pa.string()).take(table["group"].combine_chunks()) for i in (0, 1))
        yield from pa.table({"lang": langs, "source": sources, "term": table["term"], "n": table["n"], "docs": table["docs"]}).to_batches(max_chunksize=50_000)

    for whole in batches:
        for batch in rebatch([whole], "text", 4_000_000):
            of_row = np.array([groups.setdefault(k, len(groups)) for k in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)], np.int64)
            w = words(batch["text"], LETTERS)
            if not len(w.codes):
                continue
            every = len(w.distinct)
            in_docs, times = np.unique(w.row * every + w.codes, return_counts=True)
            key = of_row[in_docs // every] * every + in_docs % every
            keys, at = np.unique(key, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, times)
            found.append(pa.table({"group": keys // every, "term": w.distinct.take(pa.array(keys % every)), "n": n, "docs": np.bincount(at, minlength=len(keys)).astype(np.int64)}))
            held += len(keys)
            if held > HELD:
                found, held = [summed()], 0
                held = found[0].num_rows
                if held > HELD // 2:
                    yield from named(found[0])
                    found, held = [], 0
                    groups.clear()
    if found:
        yield from named(summed())


def _vectors(chunk: int):
    """Rows in order of language and term become a dense vector for each source of a chunk, and one of their sums, whose
    source is null and which has the terms."""

    def cut(rows: pa.Table, name: str, number: Iterator[int]) -> Iterator[dict]:
        terms = rows["term"].to_numpy()
        new = np.append(True, terms[1:] != terms[:-1])
        for kept in np.array_split(terms[new], range(chunk, int(new.sum()), chunk)):
            since, until = np.searchsorted(terms, kept[0]), np.searchsorted(terms, kept[-1], side="right")
            part, at = rows.slice(since, until - since), next(number)
            ids, n = np.searchsorted(kept, terms[since:until]), part["n"].to_numpy()
            total = np.zeros(len(kept), np.int64)
            np.add.at(total, ids, n)
            yield {"lang": name, "chunk": at, "source": None, "n": int(total.sum()), "counts": total.tobytes(), "terms": kept.tolist()}
            source = part["source"].combine_chunks().dictionary_encode()
            order = np.argsort(source.indices.to_numpy(), kind="stable")
            for here, s in zip(np.split(order, np.cumsum(np.bincount(source.indices.to_numpy()))[:-1]), source.dictionary.to_pylist(), strict=True):
                dense = np.zeros(len(kept), np.int64)
                dense[ids[here]] = n[here]
                yield {"lang": name, "chunk": at, "source": s, "n": int(n[here].sum()), "counts": dense.tobytes(), "terms": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("counts", pa.binary()), ("terms", pa.list_(pa.binary()))])
        number = iter(range(TaskContext.get().partitionId() << 32, (TaskContext.get().partitionId() + 1) << 32))

        def chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            langs = rows["lang"].to_numpy()
            bounds = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), rows.num_rows]
            for since, until in zip(bounds, bounds[1:], strict=False):
                some = []
                for row in cut(rows.slice(since, until - since), langs[since], number):
                    some.append(row)
                    if len(some) == 2 * BLOCK:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.slice(n - 1).to_pylist()[0]
            same = (rows["lang"].to_numpy() == last["lang"]) & (rows["term"].to_numpy() == last["term"])
            if whole := int(np.argmax(same)):  # the last term may go on in the next batch
                yield from chunks(rows.slice(0, whole))
                held, n = rows.slice(whole).combine_chunks().to_batches(), n - whole
        if n:
            yield from chunks(pa.Table.from_batches(held))

    return run


def _shares(counts: np.ndarray, of: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / of), by long division three digits at a time: exact while `of` is under 9 * 10**15."""
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    """One chunk of two blocks of sources: sums for each pair and, where both are one block, the first terms of each source."""

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        found = rows.to_pylist()
        work = next(r for r in found if r["work"] is not None)
        lang, (a, b), info = work["lang"], (work["a"], work["b"]), work["work"]
        vectors = {r["source"]: np.frombuffer(r["counts"], np.int64) for r in found if r["work"] is None}
        size, kept = info["size"], info["kept"]
        zero = np.zeros(size, np.int64)
        raw = [{s["source"]: vectors.get(s["source"], zero) for s in info[side]} for side in ("left", "right")]
        shares = [{s["source"]: _shares(raw[i][s["source"]], s["n"] + 2 * kept) if size else zero for s in info[side]} for i, side in enumerate(("left", "right"))]
        names, matrix = list(shares[1]), np.array(list(shares[1].values()), np.int64).reshape(len(shares[1]), size)
        for name, p in shares[0].items():
            sums = _apart(p[None, :], matrix).sum(axis=1)
            for other, value in zip(names, sums.tolist(), strict=True):
                if other != name:
                    out.append((lang, name, "pair", other.encode(), value))
                    if a != b:
                        out.append((lang, other, "pair", name.encode(), value))
        if a == b and size:
            q = _shares(np.frombuffer(info["total"], np.int64), info["lang_n"] + 2 * kept)
            for name, p in shares[0].items():
                ids = np.flatnonzero((raw[0][name] > 0) & (p > q))
                value = _apart(p[ids], q[ids])
                for i in np.argsort(-value, kind="stable")[:top].tolist():  # ids are in UTF-8 order
                    out.append((lang, name, "term", info["terms"][ids[i]], int(value[i])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], schema[i].type) for i in range(5)], schema=schema)

    return run


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the others by divergence, and its own terms.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language keeps those that at least
    `least_docs` of its documents have, V terms. A term's share in a group of N kept occurrences is
    1 + floor(10**9 * (count + 2) / (N + 2 V)), two shares p and q are floor((p - q)**2 / (p + q)) apart. Part `pair` has
    each other source of the language with the sum over all kept terms; part `term` the first `top` terms that the source
    has and that have a greater share in it than in the language. Ranks run by value, then by item in UTF-8 order.

    Null text, lang and source count as empty. Groups without terms take part; a language without kept terms has sums of 0
    and no terms. Repeated rows are documents each, other columns play no part, an empty table gives an empty table.

    What is held: partial counts (HELD rows of a task), the sources of one term, one chunk of two blocks. As the result has
    a row for each pair of sources, the sources of one language are assumed to be so few that one task may rank them.
    """
    spark = docs.sparkSession
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    groups = stage(rows.groupBy("lang", "source").count().select("lang", "source"), "groups")
    partial = stage(rows.mapInArrow(tidy(_count), COUNTS), "partial")
    # dealt by ranges of terms once; the sums, the documents of each term and the order need no further shuffle
    dealt = partial.repartitionByRange(partitions(spark), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = dealt.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= least_docs)
    vectors = stage(kept.sortWithinPartitions("lang", "term").select("lang", "term", "source", "n").mapInArrow(tidy(_vectors(chunk)), VECTORS), "vectors")
    chunks, of_sources = vectors.where(F.col("source").isNull()), vectors.where(F.col("source").isNotNull())

    langs = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"), F.sum("n").alias("lang_n"), F.count("*").alias("chunks"))
    blocks = max(1, -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // block))
    in_block = F.pmod(F.xxhash64("source"), F.lit(blocks))
    sizes = groups.join(of_sources.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, "n")
    members = stage(sizes.groupBy("lang", in_block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).join(langs, "lang", "left"), "members")
    # the work: each pair of blocks on each chunk; a language without chunks has one of no terms
    left, right = (members.select("lang", F.col("block").alias(x), F.col("sources").alias(side), *more) for x, side, more in (("a", "left", ("kept", "lang_n", "chunks")), ("b", "right", ())))
    copies = F.ceil(F.coalesce("chunks", F.lit(1)) / SHARED).cast("int")
    pairs = left.join(right, "lang").where("a <= b").withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    headers = chunks.select("lang", "chunk", F.size("terms").alias("size"), F.col("counts").alias("total"), "terms").join(members.groupBy("lang").agg(F.first("chunks").alias("chunks")), "lang", "right")
    headers = headers.select("lang", F.coalesce("chunk", F.lit(-1).cast("long")).alias("chunk"), F.coalesce("size", F.lit(0)).alias("size"), "total", "terms", F.pmod(F.xxhash64("chunk"), copies).cast("int").alias("copy"))
    same = F.col("a") == F.col("b")
    info = F.struct("size", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "left", "right", F.when(same, F.col("lang_n")).alias("lang_n"), F.when(same, F.col("total")).alias("total"), F.when(same, F.col("terms")).alias("terms"))
    none = lambda kind: F.lit(None).cast(kind)
    work = headers.join(pairs, ["lang", "copy"]).select("lang", "chunk", "a", "b", none("string").alias("source"), none("binary").alias("counts"), info.alias("work"))
    mine = in_block.alias("mine")
    dealt_to = of_sources.select("lang", "chunk", "source", "counts", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt_to = dealt_to.select("lang", "chunk", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "source", "counts", F.lit(None).cast(work.schema["work"].dataType).alias("work"))
    # a block of sources that a language has no member of is no pair, so it has vectors but no work
    needed = work.unionByName(dealt_to.join(members.select("lang", F.col("block").alias("a")), ["lang", "a"], "left_semi").join(members.select("lang", F.col("block").alias("b")), ["lang", "b"], "left_semi"))
    found = stage(needed.groupBy("lang", "chunk", "a", "b").applyInArrow(_compare(top), "lang string, source string, part string, item binary, value long"), "found")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).unionByName(found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
