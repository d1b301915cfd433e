"""Composition of tables and alphabets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.reads import hash_order


def profile(reads: DataFrame, design: str, n_cells: int | None = None) -> DataFrame:
    """One row: cells, tapes, entries with a symbol, designed and other ones, distinct symbols, and the commonest symbol."""
    good = F.col("sym").rlike(design)
    per = reads.where("sym IS NOT NULL").groupBy("sym").agg(F.count("*").alias("n"))
    top = per.agg(F.max_by("sym", F.struct("n", "sym")).alias("top_symbol"), F.max("n").alias("top_n"))
    own = reads.agg(F.countDistinct("cell").alias("cells"), F.countDistinct("tape").alias("tapes"), F.count("sym").alias("entries"), F.count_if(good).alias("designed"), F.count_if(~good).alias("other"), F.countDistinct("sym").alias("symbols"))
    return own.join(F.broadcast(top)).withColumn("top_share", F.col("top_n") / F.col("entries"))


def shares(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sym, n, p: the share of each symbol in its group."""
    per = reads.where("sym IS NOT NULL").groupBy(*keys, "sym").agg(F.count("*").alias("n"))
    return per.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def collision_mass(shares: DataFrame, keys: list[str]) -> DataFrame:
    """q, the chance that two symbols agree, 1/q, the number of symbols and the floor of q."""
    return shares.groupBy(*keys).agg(F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("m_obs"), F.sum("n").alias("edits")).withColumns({"effective": 1 / F.col("q"), "floor": 1 / F.col("m_obs")})


def trimmed(shares: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Shares over the symbols seen at least ``least`` times."""
    kept = shares.where(F.col("n") >= least)
    return kept.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def rarefaction(reads: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """Distinct symbols among ``n`` entries drawn without replacement by hash order."""
    drawn = reads.where("sym IS NOT NULL").orderBy(hash_order(seed, *ids), *ids).limit(n)
    return drawn.agg(F.countDistinct("sym").alias("symbols"), F.count("*").alias("drawn"))


def cumulative_q(shares: DataFrame) -> DataFrame:
    """Share of q that the commonest symbols hold, by rank, beside that of equal shares."""
    order = W.orderBy(F.col("p").desc(), "sym")
    whole = W.partitionBy()
    sq = F.col("p") * F.col("p")
    return shares.select("sym", "p", F.row_number().over(order).alias("rank"), (F.sum(sq).over(order) / F.sum(sq).over(whole)).alias("q_share"), (F.row_number().over(order) / F.count("*").over(whole)).alias("uniform_share"))


def pooled_shares(shares: DataFrame, group: str) -> DataFrame:
    """Shares over groups, weighted by their counts."""
    return shares.groupBy("sym").agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))


def distance_to_rest(counts: DataFrame, unit: str, sym: str = "sym") -> DataFrame:
    """unit, tv, g2: a unit's composition against that of all other units.

    counts: unit, sym, n. tv is half the sum of differences; g2 is twice the sum of n ln(p / rest).
    """
    every = counts.select(unit).distinct().join(F.broadcast(counts.select(sym).distinct()))
    full = every.join(counts, [unit, sym], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumns({"_unit": F.sum("n").over(W.partitionBy(unit)), "_sym": F.sum("n").over(W.partitionBy(sym)), "_all": F.sum("n").over(W.partitionBy())})
    p, rest = F.col("n") / F.col("_unit"), (F.col("_sym") - F.col("n")) / (F.col("_all") - F.col("_unit"))
    term = F.when((F.col("n") > 0) & (rest > 0), 2 * F.col("n") * F.log(p / rest)).otherwise(0.0)
    return full.groupBy(unit).agg((F.sum(F.abs(p - rest)) / 2).alias("tv"), F.sum(term).alias("g2"))


def concentration(values: DataFrame, value: str, tie: str) -> DataFrame:
    """Cumulative share of the total, largest values first."""
    order = W.orderBy(F.col(value).desc(), tie)
    return values.select(tie, value, (F.row_number().over(order) / F.count("*").over(W.partitionBy())).alias("top_share"), (F.sum(value).over(order) / F.sum(value).over(W.partitionBy())).alias("value_share"))


def top_share(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Largest count of a group over its total."""
    return counts.groupBy(*keys).agg(F.sum(n).alias("total"), (F.max(n) / F.sum(n)).alias("top_share"))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def own_cell_distance(reads: DataFrame, least: int, seed: int) -> DataFrame:
    """tape, n_cells, n, g2, tv, floor, excess: a tape's composition against that of the other tapes of the cells that have it.

    floor is the distance between two halves, by hash, of the tape's own symbols.
    """
    from strandline.operators.reads import uniform

    have = reads.where("site = 1 AND sym IS NOT NULL").select("tape", "cell").distinct()
    n_cells = have.groupBy("tape").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)
    have = have.join(n_cells, "tape").select("tape", "cell")
    seen = reads.where("sym IS NOT NULL")
    half = F.when(uniform(seed, "cell", "tape", "site") < 0.5, 1).otherwise(0)
    own = seen.join(have, ["tape", "cell"]).groupBy("tape", "sym").agg(F.count("*").alias("n"), F.sum(half).alias("a"))
    in_cell = seen.groupBy("cell", "sym").agg(F.count("*").alias("c"))
    every = have.join(in_cell, "cell").groupBy("tape", "sym").agg(F.sum("c").alias("c"))
    t = W.partitionBy("tape")
    rows = every.join(own, ["tape", "sym"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "a": F.coalesce("a", F.lit(0))}).withColumn("o", F.col("c") - F.col("n"))
    rows = rows.withColumns({"b": F.col("n") - F.col("a"), "_n": F.sum("n").over(t), "_o": F.greatest(F.sum("o").over(t), F.lit(1)), "_a": F.greatest(F.sum("a").over(t), F.lit(1)), "_b": F.greatest(F.sum(F.col("n") - F.col("a")).over(t), F.lit(1))})
    p, ref = F.col("n") / F.col("_n"), F.col("o") / F.col("_o")
    g = F.when(F.col("n") > 0, 2 * F.col("n") * F.log(p / F.greatest(ref, F.lit(1e-12)))).otherwise(0.0)
    out = rows.groupBy("tape").agg(F.max("_n").alias("n"), F.sum(g).alias("g2"), (F.sum(F.abs(p - ref)) / 2).alias("tv"), (F.sum(F.abs(F.col("a") / F.col("_a") - F.col("b") / F.col("_b"))) / 2).alias("floor"))
    return out.join(n_cells, "tape").withColumn("excess", F.col("tv") - F.col("floor")).select("tape", "n_cells", "n", "g2", "tv", "floor", "excess")


def occupancy(shares: DataFrame, draws: list[int]) -> DataFrame:
    """m, mean, sd: of the number of distinct symbols in m draws, with the covariance of every two symbols.

    Pairs are of symbols of an alphabet, not of rows.
    """
    p = shares.select("sym", "p")
    m = F.explode(F.array(*(F.lit(float(x)) for x in draws))).alias("m")
    one = p.select("p", m).groupBy("m").agg(F.sum(1 - F.pow(1 - F.col("p"), F.col("m"))).alias("mean"), F.sum(F.pow(1 - F.col("p"), F.col("m")) * (1 - F.pow(1 - F.col("p"), F.col("m")))).alias("_v"))
    both = p.select(F.col("sym").alias("a"), F.col("p").alias("pa"), F.lit(1).alias("_k")).join(p.select(F.col("sym").alias("b"), F.col("p").alias("pb"), F.lit(1).alias("_k")), "_k").where("a < b").select("pa", "pb", m)
    none = F.pow(F.greatest(1 - F.col("pa") - F.col("pb"), F.lit(0.0)), F.col("m")) - F.pow((1 - F.col("pa")) * (1 - F.col("pb")), F.col("m"))
    pairs = both.groupBy("m").agg((2 * F.sum(none)).alias("_c"))
    return one.join(pairs, "m", "left").select("m", "mean", F.sqrt(F.greatest(F.col("_v") + F.coalesce("_c", F.lit(0.0)), F.lit(0.0))).alias("sd"))


def prefix_concordance(reads: DataFrame, tapes: DataFrame, design: str, least: int = 3) -> DataFrame:
    """tape, site, sym, good, n, top: for symbols at site 2 on whose sites before are readable, the share of their commonest preceding prefix."""
    rows = reads.where("sym IS NOT NULL AND site >= 2").select("cell", "tape", "site", "sym").join(tapes.select("cell", "tape", "read", "depth"), ["cell", "tape"]).where("depth >= site - 1")
    rows = rows.withColumn("prefix", F.array_join(F.slice("read", F.lit(1), F.col("site") - 1), ">"))
    per = rows.groupBy("tape", "site", "sym", "prefix").agg(F.count("*").alias("n"))
    return top_share(per, ["tape", "site", "sym"]).where(F.col("total") >= least).select("tape", "site", "sym", F.col("sym").rlike(design).alias("good"), F.col("total").alias("n"), F.col("top_share").alias("top"))


def null_top_shares(clones: DataFrame, sizes: list[int], reps: int, seed: int) -> DataFrame:
    """n, top: the median share of the commonest clone among n cells drawn at random with replacement.

    clones: clone, n. A draw is a place in the running total of the clones' sizes, which is a row for each clone.
    """
    from strandline.operators.reads import uniform

    spark = clones.sparkSession
    upto = F.sum("n").over(W.orderBy("clone"))
    ends = clones.select("clone", (upto - F.col("n")).alias("_from"), upto.alias("_to"), F.sum("n").over(W.partitionBy()).alias("_all"))
    each = spark.createDataFrame([(s,) for s in sizes], "size int").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("size"))))
    total = clones.agg(F.sum("n").alias("_total"))
    draws = each.join(F.broadcast(total)).withColumn("_at", F.floor(uniform(seed, "size", "rep", "draw") * F.col("_total")))
    # The interval join meets on tenths of a thousandth of the total.
    cell = lambda x, n: F.floor(x * 10_000 / n)
    edges = ends.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from"), F.col("_all")), cell(F.col("_to") - 1, F.col("_all")))))
    hit = draws.withColumn("_cell", cell(F.col("_at"), F.col("_total"))).join(edges, "_cell").where("_at >= _from AND _at < _to")
    top = hit.groupBy("size", "rep", "clone").agg(F.count("*").alias("_k")).groupBy("size", "rep").agg((F.max("_k") / F.max("size")).alias("_top"))
    return top.groupBy(F.col("size").alias("n")).agg(F.percentile("_top", 0.5).alias("top"))


def excess_top_share(items: DataFrame, null: DataFrame) -> DataFrame:
    """Add expected, the null's top share at the item's n by linear interpolation, and excess. The null has a row for each point."""
    points = null.select(F.col("n").alias("_x0"), F.col("top").alias("_y0"), F.lead("n").over(W.orderBy("n")).alias("_x1"), F.lead("top").over(W.orderBy("n")).alias("_y1"))
    met = items.join(F.broadcast(points), (F.col("n") >= F.col("_x0")) & (F.col("_x1").isNull() | (F.col("n") < F.col("_x1"))))
    expected = F.col("_y0") + F.coalesce((F.col("n") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")), F.lit(0.0))
    return met.withColumn("expected", expected).withColumn("excess", F.col("top") - F.col("expected")).drop("_x0", "_x1", "_y0", "_y1")


def prefix_log_probability(prefixes: DataFrame, shares: DataFrame) -> DataFrame:
    """clone, tape, d, prefix, log_p: the sum of the log shares of the symbols of each distinct prefix."""
    own = prefixes.select("clone", "tape", "d", "prefix").distinct()
    each = own.withColumn("sym", F.explode(F.split("prefix", ">"))).join(shares.select("sym", "p"), "sym")
    return each.groupBy("clone", "tape", "d", "prefix").agg(F.sum(F.log("p")).alias("log_p"))


def draws_for(shares: DataFrame, seen: list[int], most: int) -> DataFrame:
    """s, m: the fewest draws whose expected number of distinct symbols is s; null if even ``most`` don't reach it (saturation)."""
    spark = shares.sparkSession
    grid = spark.range(1, most + 1).select(F.col("id").alias("m"), F.lit(1).alias("_k"))
    mean = grid.join(shares.select("p", F.lit(1).alias("_k")), "_k").groupBy("m").agg(F.sum(1 - F.pow(1 - F.col("p"), F.col("m"))).alias("_e"))  # draws by symbols of an alphabet
    asked = spark.createDataFrame([(s,) for s in seen], "s int")
    hit = mean.withColumn("s", F.explode(F.array(*(F.lit(s) for s in seen)))).where("_e >= s - 1e-9").groupBy("s").agg(F.min("m").alias("m"))
    return asked.join(hit, "s", "left")
