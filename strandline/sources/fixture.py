"""Recorder-shaped views of the star-schema tables.

cell = customer, tape = supplier number modulo 20, symbol = part brand, clone = nation,
sample = market segment. The lines of a cell and tape in date order are its sites; the
first six count. Brands that start with 5 stand for symbols outside the alphabet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITES = 6
#: Symbols that count as designed ones.
DESIGN = r"^Brand#[1-4]\d$"

#: The same views for DuckDB, as common table expressions.
SQL = """
reads AS (
  SELECT cell, tape, site, sym, clone, sample FROM (
    SELECT o_custkey AS cell, CAST(l_suppkey % 20 AS INTEGER) AS tape, p_brand AS sym, c_nationkey AS clone, c_mktsegment AS sample,
           CAST(row_number() OVER (PARTITION BY o_custkey, l_suppkey % 20 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS site
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey) WHERE site <= 6),
tapes AS (
  SELECT cell, clone, sample, tape, read, len(read) AS depth,
         CASE WHEN len(read) = 6 THEN 3 WHEN len(read) = n THEN 1 ELSE 2 END AS term
  FROM (SELECT cell, clone, sample, tape, syms, len(syms) AS n,
               list_slice(syms, 1, coalesce(list_position(list_transform(syms, lambda x: NOT regexp_matches(x, '^Brand#[1-4][0-9]$')), true), len(syms) + 1) - 1) AS read
        FROM (SELECT cell, clone, sample, tape, list(sym ORDER BY site) AS syms FROM reads GROUP BY ALL))),
prefixes AS (
  SELECT cell, clone, tape, CAST(d AS INTEGER) AS d, array_to_string(list_slice(read, 1, d), '>') AS prefix, term, depth
  FROM tapes, LATERAL (SELECT unnest(range(1, depth + 1)) AS d)),
cells AS (SELECT c_custkey AS cell, c_nationkey AS clone, c_mktsegment AS sample FROM customer),
ktapes AS (SELECT DISTINCT tape FROM reads),
entries AS (
  SELECT c.cell, c.clone, c.sample, k.tape, CASE WHEN t.cell IS NULL THEN 1 ELSE 0 END AS missing
  FROM cells c CROSS JOIN ktapes k LEFT JOIN tapes t ON t.cell = c.cell AND t.tape = k.tape),
rc AS (SELECT cell, clone, sample, CAST(sum(1 - missing) AS BIGINT) AS r FROM entries GROUP BY ALL),
rt AS (SELECT tape, CAST(sum(1 - missing) AS BIGINT) AS r, avg(missing) AS p FROM entries GROUP BY ALL)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, tape, site (1 to 6), sym, clone, sample.

    Lines are sent to their cells once, without columns of cells: sites, tapes and the join with
    cells all rest on that. Lines of a tape that agree in date, order, line and part have the same
    symbol, so the later columns of the order can't change a read.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 20).cast("int").alias("tape"), "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sym"))
    own = lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    own = own.select("cell", "tape", "sym", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").repartition("cell")
    order = W.partitionBy("cell", "tape").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    own = own.withColumn("site", F.row_number().over(order)).where(F.col("site") <= SITES).select("cell", "tape", "site", "sym")
    return own.join(cells(spark, sf_dir), "cell").select("cell", "tape", "site", "sym", "clone", "sample")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, clone, sample: all cells, observed or not."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("clone"), F.col("c_mktsegment").alias("sample"))


def wide(reads: DataFrame, n_tapes: int = 20) -> DataFrame:
    """The edit table: a row for each cell and a column ``{tape}.Site{j}`` for each site."""
    name = F.concat(F.col("tape").cast("string"), F.lit(".Site"), F.col("site").cast("string"))
    columns = [f"{t}.Site{j}" for t in range(n_tapes) for j in range(1, SITES + 1)]
    return reads.withColumn("_c", name).groupBy("cell").pivot("_c", columns).agg(F.first("sym"))
