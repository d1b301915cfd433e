"""Streaming reads: events become tape reads as they come (an extension; the batch form is ``from_events``)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITES = 6
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def keyed(events: DataFrame) -> DataFrame:
    """cell = user, tape = day modulo 8, sym = type, ts."""
    return events.select(F.col("user_id").alias("cell"), (F.dayofmonth("ts") % 8).alias("tape"), F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def from_events(events: DataFrame) -> DataFrame:
    """cell, tape, site, sym: the first six events of each cell and tape."""
    site = F.row_number().over(W.partitionBy("cell", "tape").orderBy("ts", "event_id"))
    return keyed(events).withColumn("site", site).where(F.col("site") <= SITES).select("cell", "tape", "site", "sym")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, sym, n by event time; events later than ``late`` are left out."""
    own = keyed(events).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width), "sym").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "sym", "n")


def streaming_reads(events: DataFrame) -> DataFrame:
    """cell, tape, read: the read so far of each cell and tape that got events, kept as state.

    Events of a batch are taken in time order; what is full takes no more.
    """

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        read = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        read = (read + rows["sym"].tolist())[:SITES]
        state.update((read,))
        yield pd.DataFrame({"cell": [key[0]], "tape": [key[1]], "read": [read]})

    return keyed(events).groupBy("cell", "tape").applyInPandasWithState(run, "cell long, tape int, read array<string>", "read array<string>", "update", "NoTimeout")
