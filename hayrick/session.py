"""Session helpers shared by every operator: tables, shared scratch space, materialised cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_cuts: list[str] = []
#: A table with fewer bytes than this for each core is dealt out before work that is heavy per row.
SPREAD_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/hayrick", "zip", Path(__file__).parent.parent, "hayrick")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame (Spark opens the path, so any file system works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size: file sizes under a scan, the default (huge) where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores; a large one as it is.

    A Parquet file of one row group is read by one task, however many cores wait. Large tables have row groups
    enough and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_in_bytes(df) < cores * SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (tests) a fresh temporary folder takes its place; on a
    cluster its absence is an error, since executors would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted so that ``temporary_cuts`` can remove it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _cuts.append(path)
    return path


@contextmanager
def temporary_cuts(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every cut that was made inside it: use results within, or write them first."""
    before = len(_cuts)
    try:
        yield
    finally:
        gone, _cuts[before:] = _cuts[before:], []
        for path in gone:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark can open."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside it, what a query shuffles leaves the executors' disks when the query ends, not when the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Writes ``df`` as Parquet, in folders ``by`` these columns; nothing that it shuffled is left when it ends."""
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").mode(mode).parquet(path, partitionBy=by)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the file, never a recomputation of what is above it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Removes cuts that nothing reads any more: results of ``materialize`` itself, other tables are left alone."""
    for cut in cuts:
        path = getattr(cut, "_cut_path", None)
        if path in _cuts:
            _cuts.remove(path)
            _delete(cut.sparkSession, path)
