"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Used only where the session names no shared folder and its master is local, so that driver and executors are one.
FALLBACK_DIR = "file:///tmp/checkpoints/geostride"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the context's checkpoint folder. A
    local master may do without; on a cluster a folder of one machine would lose rows, so there its lack is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = FALLBACK_DIR
        context.setCheckpointDir(named)
    return named.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver process ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the gateway may be gone already when the interpreter ends
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing already
    written, and the optimizer knows the true size of what it may broadcast."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*written: DataFrame | None) -> None:
    """Delete tables of `materialize` whose readers have all been written themselves."""
    for df in written:
        path = None if df is None else df.__dict__.get("_written_to")
        if path:
            delete_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they need not have it installed.

    Texts are long, and batches of Spark's usual 10,000 rows would hold them several times over in both processes. Spark
    reads that setting when a query runs, not when it is built, so it is set for the session, where the session has none
    of its own."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "1000")
    context = spark.sparkContext
    if getattr(context, "_geostride_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="geostride-"))
    archive = folder / "geostride.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._geostride_shipped = True
