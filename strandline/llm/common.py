"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in
    tests in local mode, a temporary folder is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Where ``shared_path`` notes the paths it makes; each thread has its own.
_NOTED: ContextVar[list[str] | None] = ContextVar("_NOTED", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """A list of the paths that are made in the shared folder while it is open.

    Operators leave written tables behind that their lazy results still read. Who has
    stored a result can ``remove`` the paths that were noted while it was defined.
    """
    before = _NOTED.get()
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)
        if before is not None:
            before.extend(paths)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    return path


def remove(spark: SparkSession, paths: list[str], needed: DataFrame) -> None:
    """Remove paths that ``needed`` doesn't read, and take them off the list."""
    files = needed.inputFiles()
    for path in list(paths):
        if not any(path.rpartition("/")[2] in f for f in files):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            paths.remove(path)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def key_of(column: Column) -> Column:
    """A non-null string key that keeps null apart from every string."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column))


def protect(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the needed ones renamed, and a function that brings rows back to its columns."""
    names = {c: c if c in needed else f"_x{i}" for i, c in enumerate(df.columns)}
    out = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return out, lambda rows: rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def join_hot(rows: DataFrame, other: DataFrame, on: list[str], n: str, share: int = 2000) -> DataFrame:
    """The inner join of ``rows`` with ``other``, whose column ``n`` tells how many rows have a key; ``n`` is dropped.

    A key of more than a ``share``th of all rows would load one task. There are fewer than
    ``share`` such keys, so their part of ``other``, a few rows a key, is broadcast; the other keys are joined as Spark likes.
    """
    total = other.select(*on, n).distinct().agg(F.sum(n)).first()[0] or 0
    hot = F.coalesce(F.col(n), F.lit(0)) * share > total
    busy = F.broadcast(other.where(hot).drop(n))
    rest = rows.join(F.broadcast(other.where(hot).select(*on).distinct()), on, "left_anti").join(other.where(~hot).drop(n), on)
    return rows.join(busy, on).unionByName(rest)


#: So many ids are broadcast at most, 8 bytes each.
MOST_IDS = 4_000_000


def with_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is among ``ids``, a written table. Up to MOST_IDS are broadcast, so that wide rows stay where they are; more of them are joined as Spark likes."""
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return rows.join(F.broadcast(ids.select(on)) if few else ids.select(on), on, "left_semi")
