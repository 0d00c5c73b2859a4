"""A corpus pipeline over documents; each stage calls one operator of quillgraph.llm.

Each stage takes all that its predecessor kept, written as Parquet and read again. In all stages null texts count as
empty, null ids are kept like others unless said otherwise, and an empty table gives an empty table; the columns of
documents are given as they came, and further columns with them, whatever their names. Every stage makes the session's Arrow
batches small.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import stage as write_and_read
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.near import drop_near_copies as drop_near
from quillgraph.llm.packing import pack, tokenise_and_cut
from quillgraph.llm.pii import labelled_table, redact, train_field
from quillgraph.llm.toxicity import score, train

#: Documents that score this much or more are rejected.
TOXIC = 0.3
#: Near copies: a Jaccard similarity of 0.8 or more of 5-word shingles. Candidates come from fingerprints of 6 blocks of
#: 64 bits in 20 segments (see quillgraph.llm.near for what these find).
NEAR = {"shingle": 5, "similar": 0.8, "blocks": 6, "segments": 20}
CAPACITY, END_ID = 4096, 2
#: Bytes of texts that a worker tokenises at once: executors are fuller here than with packing alone.
TOGETHER = 2_000_000
#: Rows of an Arrow batch: whole texts are held several times over, in the executor and in its worker.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session from now on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with its columns named c0, c1 and so on, as no operator names its own, and the names of doc_id and text."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC; repeated rows score alike. Without labels of both kinds all stay."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, _, text = _numbered(docs)
    scored = score(rows, train(docs.select("doc_id", "text"), labels), text, out="score")
    return scored.where(F.col("score") < TOXIC).select(*rows.columns).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null ids are the smallest, and rows that repeat the largest stay
    together."""
    _small_batches(spark)
    rows, number, text = _numbered(docs)
    return exact_dedup(rows, number, text).where("kept").select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays; null ids are the largest, and rows that repeat
    the document stay together. Rows that only share its id are documents of their own."""
    _small_batches(spark)
    rows, number, text = _numbered(docs)
    return drop_near(rows, number, text, **NEAR).select(*rows.columns).toDF(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. Null texts stay null."""
    _small_batches(spark)
    rows, _, text = _numbered(docs)
    n_chars = f"c{docs.columns.index('n_chars')}"
    redacted = redact(rows, train_field(labelled_table(spark)), text)
    return redacted.withColumn(n_chars, F.length(text).cast(rows.schema[n_chars].dataType)).select(*rows.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones too, in sequences of at most CAPACITY ids; an empty text is its end id alone."""
    _small_batches(spark)
    return pack(tokenise_and_cut(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY, together=TOGETHER), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The toxicity model, the fingerprint graph, the tagger and the packer have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = write_and_read(function(spark, docs, sf_dir), name)
    return docs
