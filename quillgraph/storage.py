"""Shared folders: checkpoints, and versioned tables that are replaced in one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .operators.validate import require_valid
from .schema import EvidenceGraph

TABLES = ("nodes", "sources", "claims", "evidence", "coverage")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what the session was given as such.

    Only a local master may do without, as in tests: there a folder of this machine is set.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder of the session, which all executors share; cuts its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of the column `by`, if one is given.

    For what a plan would compute several times: readers take only the columns and folders that they ask for.
    """
    path = f"{shared_folder(df.sparkSession)}/quillgraph/{uuid.uuid4().hex}/{name}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _file(spark: SparkSession, path: str):
    """A path and its file system, through the session's Hadoop configuration, so that any store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that readers see, or None before the first: the one with the latest pointer file."""
    folder, files = _file(spark, f"{root}/current")
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    latest = max((n for n in names if not n.startswith((".", "_"))), default=None)
    return f"{root}/{latest.split('-', 1)[1]}" if latest else None


def save_graph(graph: EvidenceGraph, root: str, replace: bool = False) -> str:
    """Validate a graph, write all its tables to a new version and make that the current one; the version's folder.

    An invalid graph, or a failure before the last step, leaves the current version as it was. The last step creates an
    empty pointer file, current/<number>-<version>, which may not exist yet: readers see either the old version or the
    new one, and of two writers at once one fails.
    """
    spark = graph.nodes.sparkSession
    before = current_version(spark, root)
    if before and not replace:
        raise FileExistsError(f"{root} has a graph; pass replace=True to write a new version")
    require_valid(graph)
    version = uuid.uuid4().hex
    for name in TABLES:
        if (table := getattr(graph, name)) is not None:
            table.write.parquet(f"{root}/{version}/{name}")
    folder, files = _file(spark, f"{root}/current")
    files.mkdirs(folder)
    numbers = [int(f.getPath().getName().split("-", 1)[0]) for f in files.listStatus(folder) if f.getPath().getName()[:1].isdigit()]
    if current_version(spark, root) != before:
        raise FileExistsError(f"{root} was given another version meanwhile")
    pointer, _ = _file(spark, f"{root}/current/{max(numbers, default=0) + 1:012d}-{version}")
    files.create(pointer, False).close()
    return f"{root}/{version}"


def load_graph(spark: SparkSession, root: str) -> EvidenceGraph:
    """The tables of the current version, in the order in which they were given (ord)."""
    where = current_version(spark, root)
    if where is None:
        raise FileNotFoundError(f"{root} has no graph")
    tables = []
    for name in TABLES:
        path, files = _file(spark, f"{where}/{name}")
        tables.append(spark.read.parquet(f"{where}/{name}") if files.exists(path) else None)
    return EvidenceGraph(*tables)
