"""Margins of missingness, correlation within groups, and how much they explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.ranks import numbered


def cell_margin(entries: DataFrame) -> DataFrame:
    return entries.groupBy("cell", "clone", "sample").agg(F.sum(1 - F.col("missing")).alias("r"))


def tape_margin(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tape").agg(F.sum(1 - F.col("missing")).alias("r"), F.avg("missing").alias("p"))


def overdispersion(entries: DataFrame) -> DataFrame:
    """One row: cells, tapes, p recovered, variance of the cells' counts over the binomial's, and the correlation of tapes it implies."""
    rc = cell_margin(entries).agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.var_samp("r").alias("var_r"))
    rt = tape_margin(entries).agg(F.count("*").alias("k"), F.sum((1 - F.col("p")) * F.col("p")).alias("v"), F.avg(1 - F.col("p")).alias("p"))
    out = rc.join(F.broadcast(rt)).withColumn("vif", F.col("var_r") / F.col("v"))
    return out.withColumn("rho", (F.col("vif") - 1) / (F.col("k") - 1)).select("n", "k", "p", "mean_r", "var_r", "vif", "rho")


def histogram(margin: DataFrame, value: str, top: int) -> DataFrame:
    """value and n for each value from 0 to ``top``, empty ones included."""
    spark = margin.sparkSession
    grid = spark.range(top + 1).withColumnRenamed("id", value)
    return grid.join(margin.groupBy(value).agg(F.count("*").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def cut_sweep(margin: DataFrame, cuts: list[int]) -> DataFrame:
    """cut, n, mean and variance of the counts of cells at or above each cut."""
    cut = F.explode(F.array(*(F.lit(c) for c in cuts))).alias("cut")
    return margin.select("r", cut).where("r >= cut").groupBy("cut").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.var_samp("r").alias("var_r"))


def correlation_matrix(entries: DataFrame, group: str) -> DataFrame:
    """a, b, corr: Pearson correlation over tapes of the missing rates of every two groups."""
    rate = entries.groupBy(group, "tape").agg(F.avg("missing").alias("p"))
    a, b = rate.select(F.col(group).alias("a"), "tape", F.col("p").alias("pa")), rate.select(F.col(group).alias("b"), "tape", F.col("p").alias("pb"))
    return a.join(b, "tape").where("a < b").groupBy("a", "b").agg(F.corr("pa", "pb").alias("corr"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ranks with ties averaged: rows are counted by value, and only distinct values are put in order."""
    per = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.orderBy(value))
    return df.join(per.select(value, (upto - (F.col("_n") - 1) / 2.0).alias(name)), value)


def spearman(df: DataFrame, x: str, y: str, tie: str | None = None) -> DataFrame:
    """rho and its 95 % interval by Fisher's z; ties averaged, or broken by ``tie`` if given."""
    if tie:
        ranks = numbered(numbered(df.select(x, y, tie), "rx", x, tie), "ry", y, tie)
    else:
        ranks = average_ranks(average_ranks(df.select(x, y), x, "rx"), y, "ry")
    out = ranks.agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return out.withColumns({"low": F.tanh(F.atanh("rho") - half), "high": F.tanh(F.atanh("rho") + half)})


def mean_depths(tapes: DataFrame, key: str, least: int = 5) -> DataFrame:
    return tapes.where("depth > 0").groupBy(key).agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth")).where(F.col("n") >= least)


def pair_moments(values: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Group size, sum, and the sum of products over ordered pairs of different members, without making pairs."""
    s, q = F.sum(x), F.sum(F.col(x) * F.col(x))
    return values.groupBy(*keys).agg(F.count("*").alias("m"), s.alias("sum_x"), (s * s - q).alias("pair_sum"))


def within_correlation(values: DataFrame, group: str, feature: str | None = None, x: str = "x") -> DataFrame:
    """rho of pairs within groups, and of pairs between them, values centred over all rows (of a feature, if given)."""
    keys = [feature] if feature else []
    per = values.groupBy(*keys, group).agg(F.count("*").cast("double").alias("m"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    m, s = F.col("m"), F.col("s")
    out = per.groupBy(*keys).agg(F.sum("m").cast("long").alias("n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), F.sum(s * s).alias("_ss"), F.sum(m * s).alias("_ms"), F.sum(m * m).alias("_mm"))
    # Sums around the mean follow from sums: the rows are read once, and no row is joined with its mean.
    n, mean = F.col("n"), F.col("_s") / F.col("n")
    pairs, every = F.col("_mm") - n, F.col("_q") - n * mean * mean
    own = F.col("_ss") - F.col("_q") - 2 * mean * (F.col("_ms") - F.col("_s")) + mean * mean * pairs
    return out.select(*keys, "n", (own / pairs / (every / n)).alias("rho_within"), ((-every - own) / (n * (n - 1) - pairs) / (every / n)).alias("rho_between"))


def permutation_null(values: DataFrame, group: str, block: str, id_column: str, b: int, seed: int, x: str = "x") -> DataFrame:
    """perm and rho_within for ``b`` shuffles of the values inside blocks."""
    from strandline.operators.reads import hash_order

    own = values.select(group, block, id_column, x)
    here = own.select(group, block, F.row_number().over(W.partitionBy(block).orderBy(id_column)).alias("_i"))
    mixed = own.select(block, id_column, x, F.explode(F.sequence(F.lit(1), F.lit(b))).alias("perm")).repartition("perm", block).withColumn("_h", hash_order(seed, "perm", id_column))
    there = mixed.select("perm", block, x, F.row_number().over(W.partitionBy("perm", block).orderBy("_h", id_column)).alias("_i"))
    # Explosions don't count in estimates of size, so this would be broadcast.
    return within_correlation(there.hint("merge").join(here, [block, "_i"]), group, "perm", x).select("perm", "rho_within")


def permutation_summary(null: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """Mean, spread, quantiles, z and one-sided p with (1 + n) / (B + 1) of the one row ``observed``; values that agree to nine digits count as equal."""
    both = null.select(F.round(value, 9).alias("_v")).join(F.broadcast(observed.select(F.round(value, 9).alias("_o"))))
    o = F.max("_o")
    out = both.agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.percentile("_v", 0.025).alias("q025"), F.percentile("_v", 0.975).alias("q975"), F.count_if(F.col("_v") >= F.col("_o")).alias("_ge"), F.count("*").alias("b"), o.alias("_o"))
    return out.withColumns({"z": (F.col("_o") - F.col("mean")) / F.col("sd"), "p": (1 + F.col("_ge")) / (1 + F.col("b")), "excess": F.col("_o") - F.col("mean")}).drop("_ge", "_o")


def noise_corrected_share(values: DataFrame, group: str, x: str = "x") -> DataFrame:
    """Share of the variance that lies between groups, less what noise puts there (analysis of variance)."""
    per = values.groupBy(group).agg(F.count("*").alias("m"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"))
    out = per.agg(F.sum("m").alias("n"), F.count("*").alias("g"), F.sum(F.col("m") * F.col("v")).alias("ssw"), F.sum(F.col("m") * F.col("mean")).alias("sx"), F.sum(F.col("m") * F.pow("mean", 2)).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    ssb = F.col("sm") - F.pow("sx", 2) / F.col("n")
    msb, msw = ssb / (F.col("g") - 1), F.col("ssw") / (F.col("n") - F.col("g"))
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("g") - 1)
    vb = (msb - msw) / m0
    return out.select("n", "g", msb.alias("ms_between"), msw.alias("ms_within"), (vb / (vb + msw)).alias("share"))


def replicate_fit(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, correlation and covariance of two replicates."""
    return pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.covar_samp(x, y).alias("covariance"))


def complete_loss(entries: DataFrame) -> DataFrame:
    """clone, tape, m, all_missing, all_present and their expectations if cells were independent, from tape rates."""
    p = entries.groupBy("tape").agg(F.avg("missing").alias("p"))
    out = entries.join(F.broadcast(p), "tape").groupBy("clone", "tape").agg(F.count("*").alias("m"), F.min("missing").alias("all_missing"), (1 - F.max("missing")).alias("all_present"), F.max("p").alias("p"))
    return out.withColumns({"e_missing": F.pow("p", F.col("m")), "e_present": F.pow(1 - F.col("p"), F.col("m"))})


def feasibility(entries: DataFrame, least: int = 3) -> DataFrame:
    """clone, m, n_tapes, informative: tapes that between ``least`` and m - ``least`` cells of the clone lack."""
    per = entries.groupBy("clone", "tape").agg(F.count("*").alias("m"), F.sum("missing").alias("k"))
    return per.groupBy("clone").agg(F.max("m").alias("m"), F.count("*").alias("n_tapes"), F.count_if((F.col("k") >= least) & (F.col("k") <= F.col("m") - least)).alias("informative"))


def feasibility_bands(entries: DataFrame, edges: list[int], least: int = 3) -> DataFrame:
    """band (of clones' sizes), clones, cells, informative, null_sd: what absences could tell of lineages, and the mean over clones of a tape's standard deviation there if cells were independent."""
    from strandline.operators.reads import band

    cells = entries.groupBy("clone", "cell").agg(F.avg("missing").alias("_p"))
    size = cells.groupBy("clone").agg(F.count("*").alias("m"), (F.sqrt(F.sum(F.col("_p") * (1 - F.col("_p")))) / F.count("*")).alias("_sd"))
    own = feasibility(entries, least).select("clone", "informative").join(size, "clone").withColumn("band", band(F.col("m"), edges)).where("band IS NOT NULL")
    return own.groupBy("band").agg(F.count("*").alias("clones"), F.sum("m").alias("cells"), F.sum("informative").alias("informative"), F.avg("_sd").alias("null_sd"))


def sample_purity(cells: DataFrame, least: int = 10) -> DataFrame:
    """clones, median: the median, over clones of ``least`` cells, of the share of a clone's cells that its commonest sample has."""
    per = cells.groupBy("clone", "sample").agg(F.count("*").alias("n")).groupBy("clone").agg(F.sum("n").alias("m"), (F.max("n") / F.sum("n")).alias("top"))
    return per.where(F.col("m") >= least).agg(F.count("*").alias("clones"), F.percentile("top", 0.5).alias("median"))


def lineage_excess(prefixes: DataFrame, entries: DataFrame) -> DataFrame:
    """d, pairs, observed, null, excess: mean product of two cells' missingness in the same clade, over all tapes but its own.

    entries has p; values are missing - p. The null is what shuffling cells within clones
    would give on average: each clade's pairs at the mean of all pairs of its clone.
    """
    x = entries.select("cell", "clone", "tape", (F.col("missing") - F.col("p")).alias("x"))
    whole = pair_moments(x, ["clone", "tape"]).where("m > 1").select("clone", "tape", (F.col("pair_sum") / (F.col("m") * (F.col("m") - 1))).alias("_mean"))
    clades = prefixes.select("clone", F.col("tape").alias("anchor"), "d", "prefix", "cell")
    joined = clades.join(x.drop("clone"), "cell").where("tape <> anchor")
    own = pair_moments(joined, ["clone", "anchor", "d", "prefix", "tape"]).where("m > 1").withColumn("_pairs", F.col("m") * (F.col("m") - 1))
    out = own.join(whole, ["clone", "tape"]).groupBy("d").agg(F.sum("_pairs").alias("pairs"), (F.sum("pair_sum") / F.sum("_pairs")).alias("observed"), (F.sum(F.col("_pairs") * F.col("_mean")) / F.sum("_pairs")).alias("null"))
    return out.withColumn("excess", F.col("observed") - F.col("null"))


def group_decomposition(values: DataFrame, group: str, x: str = "x") -> DataFrame:
    """pooled, without_largest, equal_weight, share_positive: the within-group correlation taken apart by group."""
    centred = values.join(F.broadcast(values.agg(F.avg(x).alias("_mean")))).withColumn("_x", F.col(x) - F.col("_mean"))
    var = centred.agg(F.avg(F.col("_x") * F.col("_x")).alias("_v"))
    own = pair_moments(centred, [group], "_x").where("m > 1").withColumn("_pairs", F.col("m") * (F.col("m") - 1))
    own = own.withColumn("_last", F.row_number().over(W.orderBy(F.desc("m"), group)) == 1)
    out = own.agg((F.sum("pair_sum") / F.sum("_pairs")).alias("a"), (F.sum(F.when(~F.col("_last"), F.col("pair_sum"))) / F.sum(F.when(~F.col("_last"), F.col("_pairs")))).alias("b"), F.avg(F.col("pair_sum") / F.col("_pairs")).alias("c"), F.avg((F.col("pair_sum") > 0).cast("double")).alias("share_positive"))
    return out.join(F.broadcast(var)).select((F.col("a") / F.col("_v")).alias("pooled"), (F.col("b") / F.col("_v")).alias("without_largest"), (F.col("c") / F.col("_v")).alias("equal_weight"), "share_positive")


def rate_histogram(margin: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return margin.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def band_profile(cells: DataFrame, value: str, flag: str, edges: list[int]) -> DataFrame:
    """band, n, share: of cells in each half-open band the share with a flag."""
    from strandline.operators.reads import band

    return cells.groupBy(band(F.col(value), edges).alias("band")).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("share"))


def reference_depths(tapes: DataFrame, entries: DataFrame, top: int, least: int) -> DataFrame:
    """cell, n, mean_depth over the ``top`` tapes that most cells have, of cells with ``least`` of them."""
    ref = tape_margin(entries).orderBy(F.desc("r"), "tape").limit(top).select("tape")
    own = tapes.where("depth > 0").join(F.broadcast(ref), "tape")  # at most ``top`` rows
    return own.groupBy("cell").agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth")).where(F.col("n") >= least)


def rho_three_ways(entries: DataFrame, unit: str) -> DataFrame:
    """One row: the correlation of two entries of a unit from the variance of its sums, from all ordered pairs, and from the analysis of variance, and what they say of P(missing | missing)."""
    y = 1 - F.col("missing")
    per = entries.groupBy(unit).agg(F.sum(y).cast("double").alias("r"), F.count("*").cast("double").alias("m"))
    all_ = per.agg(F.var_samp("r").alias("_vr"), F.var_samp(F.col("r") / F.col("m")).alias("_vm"), F.avg("m").alias("m"), (F.sum("r") / F.sum("m")).alias("p"), F.sum(F.col("r") * (F.col("r") - 1)).alias("_rr"), F.sum(F.col("m") * (F.col("m") - 1)).alias("_mm"), F.sum((F.col("m") - F.col("r")) * (F.col("m") - F.col("r") - 1)).alias("_qq"), F.sum((F.col("m") - F.col("r")) * (F.col("m") - 1)).alias("_qm"))
    total = F.col("p") * (1 - F.col("p"))
    vif = F.col("_vr") / (F.col("m") * total)
    rho = (vif - 1) / (F.col("m") - 1)
    return all_.select("m", "p", vif.alias("vif"), rho.alias("rho_variance"), ((F.col("_rr") / F.col("_mm") - F.col("p") * F.col("p")) / total).alias("rho_pairs"), (F.greatest(F.col("_vm") - total / F.col("m"), F.lit(0.0)) / total).alias("rho_anova"), (F.col("_qq") / F.col("_qm")).alias("p_missing_given_missing"), (1 - F.col("p") + rho * F.col("p")).alias("p_predicted"))


def threshold_split(points: DataFrame, x: str, y: str, cut: float) -> DataFrame:
    """n and mean of ``y`` below and from ``cut`` of ``x`` on, and the rank correlation above it."""
    sides = points.agg(F.count_if(F.col(x) < cut).alias("n_below"), F.avg(F.when(F.col(x) < cut, F.col(y))).alias("mean_below"), F.count_if(F.col(x) >= cut).alias("n_above"), F.avg(F.when(F.col(x) >= cut, F.col(y))).alias("mean_above"))
    return sides.join(F.broadcast(spearman(points.where(F.col(x) >= cut), x, y).select(F.col("rho").alias("rho_above"))))


def depth_family(tapes: DataFrame, level: int) -> DataFrame:
    """cell, clone, sample, tape, x, w: whether a tape reached a level, with weight 0 where junk hides it."""
    from strandline.operators.reads import reached

    x, w = reached(level, F.col("depth"), F.col("term"))
    return tapes.select("cell", "clone", "sample", "tape", x.cast("double").alias("x"), w.cast("double").alias("w"))


def with_tape_mean(values: DataFrame) -> DataFrame:
    """Add p, the weighted mean of x of the tape, kept off 0 and 1."""
    p = values.groupBy("tape").agg(F.greatest(F.least(F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0)), F.lit(1 - 1e-6)), F.lit(1e-6)).alias("p"))
    return values.join(p, "tape")


def with_grand_mean(values: DataFrame) -> DataFrame:
    """Add p, the weighted mean of all x, kept off 0 and 1."""
    p = values.agg(F.greatest(F.least(F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0)), F.lit(1 - 1e-6)), F.lit(1e-6)).alias("p"))
    return values.join(F.broadcast(p))


def with_two_way_mean(values: DataFrame, sweeps: int = 15) -> DataFrame:
    """Add p, the logistic fit of both margins, of cells and of tapes, to x with weights w: residuals sum to 0 over each cell and over each tape."""
    from strandline.operators.fit import within

    rows = values.withColumns({"_arm": F.lit(0), "missing": F.col("x")})
    return within(rows, ["_arm"], "w", sweeps).drop("_arm", "missing", "alpha", "beta")


def standardised_pairs(values: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """keys, _num, _den: sums over ordered pairs of a group of products of residuals x - p, and of their standard deviations."""
    r = F.when(F.col("w") > 0, F.col("x") - F.col("p")).otherwise(0.0)
    v = F.when(F.col("w") > 0, F.col("p") * (1 - F.col("p"))).otherwise(0.0)
    own = values.withColumns({"_r": r, "_v": v}).groupBy(*keys, group)
    per = own.agg((F.pow(F.sum("_r"), 2) - F.sum(F.col("_r") * F.col("_r"))).alias("_n"), (F.pow(F.sum(F.sqrt("_v")), 2) - F.sum("_v")).alias("_d"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("_num"), F.sum("_d").alias("_den"))


def rho_in_clones_and_samples(values: DataFrame) -> DataFrame:
    """tape, rho_within (pairs of a clone), rho_between (pairs of a sample and not of a clone) of x, w around p."""
    a = standardised_pairs(values, "clone", ["tape"]).select("tape", F.col("_num").alias("_nw"), F.col("_den").alias("_dw"))
    b = standardised_pairs(values, "sample", ["tape"])
    both = a.join(b, "tape").withColumns({"_nb": F.col("_num") - F.col("_nw"), "_db": F.col("_den") - F.col("_dw")})
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    return both.select("tape", ratio("_nw", "_dw").alias("rho_within"), ratio("_nb", "_db").alias("rho_between"))


def pooled_rho(values: DataFrame) -> DataFrame:
    """One row: rho_within and rho_between of ``rho_in_clones_and_samples`` over all tapes together."""
    a = standardised_pairs(values, "clone", ["tape"]).agg(F.sum("_num").alias("_nw"), F.sum("_den").alias("_dw"))
    b = standardised_pairs(values, "sample", ["tape"]).agg(F.sum("_num").alias("_ns"), F.sum("_den").alias("_ds"))
    return a.join(F.broadcast(b)).select((F.col("_nw") / F.col("_dw")).alias("rho_within"), ((F.col("_ns") - F.col("_nw")) / (F.col("_ds") - F.col("_dw"))).alias("rho_between"))


def tape_null(values: DataFrame, moves: DataFrame) -> DataFrame:
    """tape, observed, mean, sd, z, skew, p_up, p_down of rho_within against whole rows of cells moved by ``moves`` (perm, cell, source); values are compared to nine digits."""
    rho = lambda v, keys: standardised_pairs(v, "clone", keys).select(*keys, F.when(F.col("_den") > 0, F.round(F.col("_num") / F.col("_den"), 9)).alias("rho"))
    seen = rho(values, ["tape"]).withColumnRenamed("rho", "observed")
    # Explosions don't count in estimates of size, so moves would be broadcast.
    here = moves.hint("merge").join(values.select("cell", "clone").distinct(), "cell").select("perm", "clone", "source")
    moved = here.hint("merge").join(values.select(F.col("cell").alias("source"), "tape", "x", "w", "p"), "source")
    null = rho(moved, ["perm", "tape"]).join(seen, "tape")
    per = null.groupBy("tape").agg(F.max("observed").alias("observed"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), (F.avg(F.pow("rho", 3)) - 3 * F.avg("rho") * F.avg(F.col("rho") * F.col("rho")) + 2 * F.pow(F.avg("rho"), 3)).alias("_m3"), F.count_if(F.col("rho") >= F.col("observed")).alias("_up"), F.count_if(F.col("rho") <= F.col("observed")).alias("_down"), F.count("*").alias("_b"))
    return per.select("tape", "observed", "mean", "sd", ((F.col("observed") - F.col("mean")) / F.col("sd")).alias("z"), (F.col("_m3") / F.pow("sd", 3)).alias("skew"), ((1 + F.col("_up")) / (1 + F.col("_b"))).alias("p_up"), ((1 + F.col("_down")) / (1 + F.col("_b"))).alias("p_down"))
