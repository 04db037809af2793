"""Where intermediate tables live: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.batches import BATCH_BYTES, small_batches  # noqa: F401
from docloom.operators.batches import BATCH_CONF as _BATCH_CONF  # noqa: F401

#: Folders that this process has written, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where none is named a local one is made in local mode (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def mark() -> int:
    """How many folders were written so far, for clear."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the folders written since a mark, but for the one that keep is read from.

    For when no DataFrame that reads them is needed any more: the operators' results do until they are written.
    """
    kept = getattr(keep, "_docloom_path", None)
    gone = [p for p in _written[since:] if p != kept]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[since:] = [kept] if kept in _written[since:] else []


def discard(*tables: DataFrame) -> None:
    """Remove tables made by materialize that nothing reads any more."""
    for df in tables:
        path = df._docloom_path
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
