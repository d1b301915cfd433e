"""Tape reads: the leading symbols of a tape within the alphabet, and why a read ends.

A missing value has four meanings that stay apart: the tape is absent (no row, or term
0), the next site is not yet written (term 1), the next symbol is outside the alphabet
(term 2), or the tape is full (term 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ABSENT, UNEDITED, JUNK, COMPLETE = 0, 1, 2, 3


def value_class(value: Column, design: str) -> Column:
    """missing, good (of the designed form) or bad."""
    return F.when(value.isNull(), "missing").when(value.rlike(design), "good").otherwise("bad")


def frequent_symbols(reads: DataFrame, least: int, design: str) -> DataFrame:
    """sym, n, promoted: symbols seen ``least`` times; promoted ones lack the designed form."""
    return reads.where("sym IS NOT NULL").groupBy("sym").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("promoted", ~F.col("sym").rlike(design))


def in_alphabet(reads: DataFrame, alphabet: DataFrame) -> DataFrame:
    """Add ``good``: whether the symbol is in the alphabet."""
    return reads.join(alphabet.select("sym", F.lit(True).alias("good")), "sym", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def dense_codes(reads: DataFrame, alphabet: DataFrame) -> DataFrame:
    """The reads whose symbol is in the alphabet, with code, its place there from 0 on in the order of symbols. An alphabet is put in order by one task."""
    codes = alphabet.select("sym").distinct().withColumn("code", F.row_number().over(W.orderBy("sym")) - 1)
    return reads.join(codes, "sym")


def take_while(syms: Column, good) -> Column:
    """Symbols up to the first that ``good`` rejects."""
    bad = F.array_position(F.transform(syms, lambda x: ~good(x)), True)
    return F.slice(syms, F.lit(1), F.when(bad > 0, (bad - 1).cast("int")).otherwise(F.size(syms)))


def termination(depth: Column, n: Column, sites: int) -> Column:
    return F.when(n == 0, ABSENT).when(depth == sites, COMPLETE).when(depth == n, UNEDITED).otherwise(JUNK)


def tapes(reads: DataFrame, design: str, sites: int = 6) -> DataFrame:
    """cell, clone, sample, tape, read, depth, term of each observed tape.

    The read stops at the first symbol outside the alphabet or the first site without a
    symbol. A tape counts as observed if any of its sites has a symbol.
    """
    pairs = F.array_sort(F.collect_list(F.struct("site", "sym")))
    own = reads.where("sym IS NOT NULL").groupBy("cell", "clone", "sample", "tape").agg(pairs.alias("_s"))
    gapless = F.filter("_s", lambda x, i: x["site"] == i + 1)
    own = own.withColumn("_syms", F.transform(gapless, lambda x: x["sym"]))
    own = own.withColumn("read", take_while(F.col("_syms"), lambda x: x.rlike(design))).withColumn("depth", F.size("read"))
    return own.withColumn("term", termination(F.col("depth"), F.size("_s"), sites)).select("cell", "clone", "sample", "tape", "read", "depth", "term")


def determined(level: int, depth: Column, term: Column) -> Column:
    """Whether a tape tells its state at a level."""
    return (term != ABSENT) & ((depth >= level) | (term == UNEDITED) | (term == COMPLETE))


def reached(level: int, depth: Column, term: Column) -> tuple[Column, Column]:
    """Whether a tape reached a level, and its weight: 0 where the alphabet stops the read before."""
    return (depth >= level).cast("int"), F.when((depth < level) & (term == JUNK), 0).otherwise(1)


def pattern_class(reads: DataFrame) -> DataFrame:
    """cell, tape, pattern: prefix if the sites with a symbol are the first ones, else gap."""
    own = reads.where("sym IS NOT NULL").groupBy("cell", "tape").agg(F.max("site").alias("_last"), F.count("*").alias("_n"))
    return own.select("cell", "tape", F.when(F.col("_last") == F.col("_n"), "prefix").otherwise("gap").alias("pattern"))


def missing_classes(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """cell, tape, pattern of every entry: absent, prefix or gap (a site without a symbol before one that has it)."""
    seen = entries.select("cell", "tape").join(pattern_class(reads), ["cell", "tape"], "left")
    return seen.withColumn("pattern", F.coalesce("pattern", F.lit("absent")))


def entries(tapes: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, clone, sample, tape, missing (0 or 1): every cell with every tape that any cell has."""
    every = tapes.select("tape").distinct()
    seen = tapes.select("cell", "tape", F.lit(0).alias("missing"))
    return cells.join(F.broadcast(every)).join(seen, ["cell", "tape"], "left").select("cell", "clone", "sample", "tape", F.coalesce("missing", F.lit(1)).alias("missing"))


def qc_cells(entries: DataFrame, least: int) -> DataFrame:
    """Cells with at least ``least`` recovered tapes."""
    return entries.groupBy("cell", "clone", "sample").agg(F.sum(1 - F.col("missing")).alias("r")).where(F.col("r") >= least)


def size_stratum(m: Column) -> Column:
    return F.when(m < 6, 0).when(m < 10, 1).when(m < 20, 2).when(m < 50, 3).when(m < 200, 4).otherwise(5)


def band(value: Column, edges: list[int]) -> Column:
    """Index of the half-open band [edges[i], edges[i + 1]) that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return out


def explode_prefixes(tapes: DataFrame) -> DataFrame:
    """cell, clone, tape, d, prefix, term, depth: a row for each leading run of each read."""
    d = F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d")
    out = tapes.where("depth > 0").select("cell", "clone", "tape", d, "read", "term", "depth")
    return out.select("cell", "clone", "tape", "d", F.array_join(F.slice("read", F.lit(1), F.col("d")), ">").alias("prefix"), "term", "depth")


def equal_cells(tapes: DataFrame) -> DataFrame:
    """cell, same: the smallest cell of its clone that has equal reads of all tapes, for each cell with a read."""
    own = tapes.where("depth > 0").groupBy("clone", "cell").agg(F.array_sort(F.collect_list(F.struct("tape", "read"))).alias("_r"))
    return own.select("cell", F.min("cell").over(W.partitionBy("clone", "_r")).alias("same"))


def hash_order(seed: int, *ids: str) -> Column:
    """An order that looks random and depends on the seed and ids alone: the MD5 of both, which any SQL engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)).cast("binary"))


def uniform(seed: int, *ids: str) -> Column:
    """A number in [0, 1) from the seed and ids alone: the first 52 bits of ``hash_order``."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
