"""Independent writes and shifts of composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.sources.shared import written


def independent_writes(tapes: DataFrame, keys: tuple[str, ...] = ("clone",)) -> DataFrame:
    """keys, tape, parent, child, site: distinct children of parents that have at least two."""
    step = F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("site")
    rows = tapes.where("depth > 0").select(*keys, "tape", "read", step)
    rows = rows.select(*keys, "tape", F.array_join(F.slice("read", F.lit(1), F.col("site") - 1), ">").alias("parent"), F.element_at("read", F.col("site")).alias("child"), "site").distinct()
    n = F.count("*").over(W.partitionBy(*keys, "tape", "parent"))
    return rows.withColumn("_n", n).where("_n >= 2").drop("_n")


def contingency(writes: DataFrame) -> DataFrame:
    return writes.groupBy("tape", "site", "child").agg(F.count("*").alias("n"))


def stratified_distance(writes: DataFrame, stratum: str, unit: str = "tape") -> DataFrame:
    """unit, tv: half the sum over symbols of the mean over strata of a unit's share less that of the other units there."""
    per = writes.groupBy(stratum, unit, "child").agg(F.count("*").alias("n"))
    full = per.select(stratum, unit).distinct().join(per.select(stratum, "child").distinct(), stratum).join(per, [stratum, unit, "child"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumns({"_u": F.sum("n").over(W.partitionBy(stratum, unit)), "_c": F.sum("n").over(W.partitionBy(stratum, "child")), "_s": F.sum("n").over(W.partitionBy(stratum))})
    diff = F.col("n") / F.col("_u") - (F.col("_c") - F.col("n")) / (F.col("_s") - F.col("_u"))
    by_symbol = full.where("_s > _u").groupBy(unit, "child").agg((F.sum(F.col("_u") * diff) / F.sum("_u")).alias("difference"))
    return by_symbol.groupBy(unit).agg((F.sum(F.abs("difference")) / 2).alias("tv"), F.max_by("child", F.struct(F.abs("difference").alias("x"), "child")).alias("top_symbol"))


def mantel_haenszel(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, log_or, variance: the common odds ratio of 2 x 2 tables a, b, c, d, and Robins, Breslow and Greenland's variance."""
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r, s = F.col("a") * F.col("d") / n, F.col("b") * F.col("c") / n
    p, q = (F.col("a") + F.col("d")) / n, (F.col("b") + F.col("c")) / n
    out = tables.where(n > 0).groupBy(*keys).agg(F.sum(r).alias("_r"), F.sum(s).alias("_s"), F.sum(p * r).alias("_pr"), F.sum(p * s + q * r).alias("_ps"), F.sum(q * s).alias("_qs"))
    out = out.where("_r > 0 AND _s > 0")
    var = F.col("_pr") / (2 * F.pow("_r", 2)) + F.col("_ps") / (2 * F.col("_r") * F.col("_s")) + F.col("_qs") / (2 * F.pow("_s", 2))
    return out.select(*keys, F.log(F.col("_r") / F.col("_s")).alias("log_or"), var.alias("variance"))


def symbol_tables(writes: DataFrame, unit: str, stratum: str) -> DataFrame:
    """unit, child, stratum, a, b, c, d: writes of a symbol or others, by the unit or the other units of the stratum."""
    per = writes.groupBy(stratum, unit, "child").agg(F.count("*").alias("n"))
    u, c, s = (F.sum("n").over(W.partitionBy(*k)) for k in ((stratum, unit), (stratum, "child"), (stratum,)))
    full = per.withColumns({"_u": u, "_c": c, "_s": s})
    return full.select(unit, "child", stratum, F.col("n").alias("a"), (F.col("_u") - F.col("n")).alias("b"), (F.col("_c") - F.col("n")).alias("c"), (F.col("_s") - F.col("_u") - F.col("_c") + F.col("n")).alias("d"))


def call_map(z: DataFrame, key: str, value: str = "z", least_gap: float = 1.0) -> DataFrame:
    """key, the item with the least value, the gap to the second, and whether that suffices."""
    order = W.partitionBy(key).orderBy(value, "item")
    two = z.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    out = two.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col("item"))).alias("item"), (F.max(F.when(F.col("_n") == 2, F.col(value))) - F.max(F.when(F.col("_n") == 1, F.col(value)))).alias("gap"))
    return out.withColumn("callable", F.coalesce(F.col("gap") >= least_gap, F.lit(False)))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys two maps share, and how many of them agree."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count("*").alias("shared"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))


def expected_occupied(n_items: int, n_symbols: int) -> float:
    """Distinct symbols if each item took one at random."""
    return n_symbols * (1 - (1 - 1 / n_symbols) ** n_items)


def bushiness(writes: DataFrame) -> DataFrame:
    """tape, writes, parents, bush: writes for each parent that has any."""
    per = writes.groupBy("tape").agg(F.count("*").alias("writes"), F.countDistinct("clone", "parent").alias("parents"))
    return per.withColumn("bush", F.col("writes") / F.col("parents"))


def clone_stratified(writes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, tape, child, n, p, reference, difference: a tape's symbols against those of other tapes of the same clones, clones weighted by the tape's writes there."""
    k = list(keys)
    per = writes.groupBy(*k, "clone", "tape", "child").agg(F.count("*").alias("n"))
    own = per.groupBy(*k, "clone", "tape").agg(F.sum("n").alias("_ct"))
    clone = per.groupBy(*k, "clone").agg(F.sum("n").alias("_c"))
    symbol = per.groupBy(*k, "clone", "child").agg(F.sum("n").alias("_cs"))
    tape = own.groupBy(*k, "tape").agg(F.sum("_ct").alias("_t"))
    every = own.join(clone, [*k, "clone"]).join(symbol, [*k, "clone"]).join(per, [*k, "clone", "tape", "child"], "left").join(tape, [*k, "tape"]).withColumn("n", F.coalesce("n", F.lit(0)))
    reference = F.col("_ct") / F.col("_t") * (F.col("_cs") - F.col("n")) / F.greatest(F.col("_c") - F.col("_ct"), F.lit(1))
    out = every.groupBy(*k, "tape", "child").agg(F.sum("n").alias("n"), (F.sum("n") / F.max("_t")).alias("p"), F.sum(reference).alias("reference"))
    return out.withColumn("difference", F.col("p") - F.col("reference"))


def clone_stratified_distance(stratified: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, tape, n, tv, top (the symbol most in excess), bottom."""
    order = F.struct("difference", "child")
    return stratified.groupBy(*keys, "tape").agg(F.sum("n").alias("n"), (F.sum(F.abs("difference")) / 2).alias("tv"), F.max_by("child", order).alias("top"), F.min_by("child", order).alias("bottom"))


def relabelled(writes: DataFrame, b: int, seed: int) -> DataFrame:
    """perm and writes whose tapes change places within a clone and site."""
    from strandline.operators.reads import hash_order

    ids = ["clone", "site", "tape", "parent", "child"]
    each = writes.select(*ids).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(b))))
    block = ["perm", "clone", "site"]
    here = each.withColumn("_i", F.row_number().over(W.partitionBy(*block).orderBy("tape", "parent", "child"))).drop("tape")
    there = each.select(*block, "tape", F.row_number().over(W.partitionBy(*block).orderBy(hash_order(seed, "perm", *ids), "tape", "parent", "child")).alias("_i"))
    return here.join(there, [*block, "_i"]).drop("_i")


def standardised_map(observed: DataFrame, null: DataFrame, b: int) -> DataFrame:
    """tape, child, z: a difference less its mean over ``b`` relabellings, over their spread; 0 without any. A symbol that a relabelling lacks counts as no difference."""
    spread = null.groupBy("tape", "child").agg((F.sum("difference") / b).alias("_m"), (F.sum(F.col("difference") * F.col("difference")) / b).alias("_q"))
    both = observed.select("tape", "child", "difference").join(spread, ["tape", "child"], "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("difference", "_m", "_q")})
    sd = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    return both.select("tape", "child", F.when(sd > 1e-9, (F.col("difference") - F.col("_m")) / sd).otherwise(0.0).alias("z"))


def concentration_of_map(z: DataFrame, n_symbols: int) -> DataFrame:
    """tape, top, top_z, concentration: the largest z over the root mean square of the others."""
    per = z.groupBy("tape").agg(F.max_by("child", F.struct("z", "child")).alias("top"), F.max("z").alias("top_z"), F.sum(F.col("z") * F.col("z")).alias("_ss"))
    rms = F.sqrt(F.greatest(F.col("_ss") - F.col("top_z") * F.col("top_z"), F.lit(0.0)) / max(n_symbols - 1, 1))
    return per.select("tape", "top", "top_z", F.when(rms > 1e-9, F.col("top_z") / rms).otherwise(0.0).alias("concentration"))


def common_log_odds(tables: DataFrame, keys: list[str], half_width: float = 8.0, points: int = 321) -> DataFrame:
    """keys, theta, gain: the common log odds ratio of 2 x 2 tables (a, b, c, d) on an even grid, each table's baseline profiled out.

    a of a + b are cases inside, c of c + d outside. gain is the log likelihood over that
    of no effect. The grid goes to the tables; each baseline is a root of a quadratic, so
    the profile is an expression and the likelihood a grouped sum.
    """
    step = 2 * half_width / (points - 1)
    # The groups' point 0 comes first, then all others: a tables-by-points table of sums.
    grid = tables.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_t", F.exp(F.col("_i") * step - half_width))
    inside, outside, cases = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c")
    # inside x t / (1 + x t) + outside x / (1 + x) = cases, for the odds x outside.
    t = F.col("_t")
    qa, qb, qc = t * (inside + outside - cases), inside * t + outside - cases * (1 + t), -cases
    x = F.when(cases <= 0, 0.0).when(qa <= 0, F.lit(float("inf"))).otherwise((-qb + F.sqrt(qb * qb - 4 * qa * qc)) / (2 * qa))
    grid = grid.withColumn("_x", x)
    log = lambda n, p: F.when(n == 0, 0.0).otherwise(n * F.log(F.greatest(p, F.lit(1e-15))))
    p1 = F.when(F.col("_x") == float("inf"), 1.0).otherwise(F.col("_x") * t / (1 + F.col("_x") * t))
    p0 = F.when(F.col("_x") == float("inf"), 1.0).otherwise(F.col("_x") / (1 + F.col("_x")))
    ll = log(F.col("a"), p1) + log(F.col("b"), 1 - p1) + log(F.col("c"), p0) + log(F.col("d"), 1 - p0)
    per = grid.groupBy(*keys, "_i").agg(F.sum(ll).alias("_ll"))
    best = per.groupBy(*keys).agg(F.max(F.struct(F.round("_ll", 9).alias("l"), (-F.abs(F.col("_i") - (points - 1) // 2)).alias("c"), "_i")).alias("_b"), F.max(F.when(F.col("_i") == (points - 1) // 2, F.col("_ll"))).alias("_l0"))
    return best.select(*keys, (F.col("_b._i") * step - half_width).alias("theta"), (F.col("_b.l") - F.col("_l0")).alias("gain"))


def permuted_agreement(a: DataFrame, b: DataFrame, key: str, value: str, perms: int, seed: int) -> DataFrame:
    """One row: shared keys, agree, the mean and largest agreement over shuffles of the second map's keys, enrichment and p. Maps have a row for each key."""
    from strandline.operators.reads import hash_order

    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    each = both.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    here = each.select("perm", "_a", F.row_number().over(W.partitionBy("perm").orderBy(key)).alias("_i"))
    there = each.select("perm", "_b", F.row_number().over(W.partitionBy("perm").orderBy(hash_order(seed, "perm", key), key)).alias("_i"))
    null = here.join(there, ["perm", "_i"]).groupBy("perm").agg(F.count_if(F.col("_a") == F.col("_b")).alias("n"))
    seen = both.agg(F.count("*").alias("shared"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))
    out = null.join(F.broadcast(seen)).groupBy("shared", "agree").agg(F.avg("n").alias("null_mean"), F.max("n").alias("null_max"), F.count_if(F.col("n") >= F.col("agree")).alias("_ge"))
    return out.select("shared", "agree", "null_mean", "null_max", (F.col("agree") / F.greatest("null_mean", F.lit(1e-9))).alias("enrichment"), ((1 + F.col("_ge")) / (1 + perms)).alias("p"))


def injectivity(map_: DataFrame, value: str, n_symbols: int) -> DataFrame:
    """called, distinct, expected distinct symbols if each item took one at random, and their ratio."""
    out = map_.agg(F.count("*").alias("called"), F.countDistinct(value).alias("distinct"))
    expected = n_symbols * (1 - F.pow(F.lit(1 - 1 / n_symbols), F.col("called")))
    return out.withColumn("expected", expected).withColumn("ratio", F.col("distinct") / F.col("expected"))


def depletion(tapes: DataFrame, cells: DataFrame, events: DataFrame, members: DataFrame, perms: int, seed: int, least: int = 50) -> DataFrame:
    """COMBO, cells_in, writes_in, writes_out, top, theta, gain, n_used, null_mean, null_max, p: the symbol that an event's clade writes least, against the rest of its clone.

    events: COMBO; members: clone, anchor, d, prefix, cell. Independent writes are taken
    inside and outside by themselves, on the tapes other than the event's and its anchor;
    each symbol's common log odds over sites (``common_log_odds``) have a gain that counts
    against the symbol where they are above 0. In the null, cells of the clone change places
    by hash. Permutations are a key beside the event, 0 being what is observed, so all are
    one job, cells with equal reads write as one, and only each one's largest gain is kept: p counts those that reach the observed
    one (to nine digits). Where inside or outside has under ``least`` writes, a permutation is not used,
    and an event gets no row.
    """
    from strandline.operators.reads import equal_cells, hash_order
    from strandline.operators.scan import COMBO

    clade = ["clone", "anchor", "d", "prefix"]
    own = events.select(*COMBO).distinct()
    size = members.join(own.select(*clade).distinct(), clade, "left_semi").groupBy(*clade).agg(F.count("*").alias("cells_in"))
    own = written(own.join(size, clade), "events")
    # One order of a clone's cells for each permutation serves all of its events.
    ranked = cells.select("clone", "cell").join(own.select("clone").distinct(), "clone", "left_semi").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    ranked = ranked.withColumn("_k", F.row_number().over(W.partitionBy("clone", "perm").orderBy(hash_order(seed, "perm", "cell"), "cell")))
    moved = own.join(ranked, "clone").select(*COMBO, "perm", "cell", (F.col("_k") <= F.col("cells_in")).alias("_in"))
    inside = members.select(*clade, "cell", F.lit(True).alias("_in"))
    seen = own.join(cells.select("clone", "cell"), "clone").join(inside, [*clade, "cell"], "left").select(*COMBO, F.lit(0).alias("perm"), "cell", F.coalesce("_in", F.lit(False)).alias("_in"))
    step = F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("site")
    steps = tapes.where("depth > 0").select("cell", F.col("tape").alias("_t"), "read", step)
    steps = steps.select("cell", "_t", F.array_join(F.slice("read", F.lit(1), F.col("site") - 1), ">").alias("_parent"), F.element_at("read", F.col("site")).alias("child"), "site")
    case = [*COMBO, "perm"]
    # Only distinct writes count, so of cells with equal reads one is enough on each side.
    sides = seen.unionByName(moved).join(equal_cells(tapes), "cell").select(*case, "_in", F.col("same").alias("cell")).distinct()
    wrote = sides.join(steps, "cell").where("_t <> anchor AND _t <> tape").select(*case, "_in", "_t", "_parent", "child", "site").distinct()
    wrote = wrote.withColumn("_n", F.count("*").over(W.partitionBy(*case, "_in", "_t", "_parent"))).where("_n >= 2")
    per = wrote.groupBy(*case, "site", "child").agg(F.count_if("_in").alias("a"), F.count_if(~F.col("_in")).alias("c"))
    here = W.partitionBy(*case, "site")
    tables = per.withColumns({"b": F.sum("a").over(here) - F.col("a"), "d_": F.sum("c").over(here) - F.col("c")})
    total = per.groupBy(*case).agg(F.sum("a").alias("writes_in"), F.sum("c").alias("writes_out")).where((F.col("writes_in") >= least) & (F.col("writes_out") >= least))
    # COMBO has a d, and so have the tables of common_log_odds.
    keyed = tables.join(total, case).select(F.struct(*case, "writes_in", "writes_out").alias("_case"), "child", "a", "b", "c", F.col("d_").alias("d"))
    odds = written(common_log_odds(keyed, ["_case", "child"]), "odds")
    signed = F.round(F.when(F.col("theta") < 0, F.col("gain")).otherwise(-F.col("gain")), 9)
    best = odds.groupBy("_case").agg(F.min(F.struct((-signed).alias("g"), "child", "theta")).alias("_b")).select("_case.*", (-F.col("_b.g")).alias("gain"), F.col("_b.child").alias("top"), F.col("_b.theta").alias("theta"))
    null = best.where("perm > 0").select(*COMBO, F.col("gain").alias("_null"))
    out = best.where("perm = 0").drop("perm").join(null, COMBO, "left").groupBy(*COMBO, "writes_in", "writes_out", "top", "theta", "gain").agg(F.count("_null").alias("n_used"), F.avg("_null").alias("null_mean"), F.max("_null").alias("null_max"), F.count_if(F.col("_null") >= F.col("gain")).alias("_ge"))
    return out.join(own, COMBO).select(*COMBO, "cells_in", "writes_in", "writes_out", "top", "theta", "gain", "n_used", "null_mean", "null_max", ((1 + F.col("_ge")) / (1 + F.col("n_used"))).alias("p"))
