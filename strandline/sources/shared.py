"""Written tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``written`` has made in this process, and nobody has removed.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where that is unset, a new temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strandline-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, which cuts its lineage: for loops, and for what is used more than once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, old: DataFrame, name: str) -> DataFrame:
    """``df`` written, and the table of ``old`` removed: the next state of a loop, when nothing else reads the last one."""
    out = written(df, name)
    forget(old)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        for path in [p for p in _MADE if any(p.rpartition("/")[2] in f for f in files)]:
            _remove(table.sparkSession, path)


def remove_written(spark: SparkSession) -> None:
    """Remove all tables that ``written`` has made in this process; results that read them must have been stored."""
    for path in list(_MADE):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.discard(path)
