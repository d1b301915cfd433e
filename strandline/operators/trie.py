"""Prefix tries: nodes with what is written next, independent writes, and characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import special


def nodes(tapes: DataFrame) -> DataFrame:
    """clone, tape, level (symbols before), prefix, carriers, n_next, s (distinct next symbols)."""
    step = F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("d")
    rows = tapes.where("depth > 0").select("cell", "clone", "tape", "read", step)
    rows = rows.select("clone", "tape", (F.col("d") - 1).alias("level"), F.array_join(F.slice("read", F.lit(1), F.col("d") - 1), ">").alias("prefix"), F.element_at("read", F.col("d")).alias("next"))
    return rows.groupBy("clone", "tape", "level", "prefix").agg(F.count("*").alias("n_next"), F.countDistinct("next").alias("s"), F.array_sort(F.collect_set("next")).alias("symbols"))


def expected_distinct(shares: dict[str, float], top: int) -> list[float]:
    """Expected number of distinct symbols in m draws, for m from 0 to ``top``."""
    return [sum(1 - (1 - p) ** m for p in shares.values()) for m in range(top + 1)]


def moment_estimates(nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """Add m_hat, the number of independent writes whose expected distinct symbols are s, between s and n_next, and recurrences.

    ``shares`` is an alphabet (a row for each symbol), so its table of expectations goes to all tasks.
    """
    p = {r["sym"]: r["p"] for r in shares.select("sym", "p").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, float] = {}
        for b in batches:
            for s in b["s"].unique():
                known.setdefault(int(s), special.invert(lambda m: sum(1 - (1 - q) ** m for q in p.values()), float(s), 0.0, 1e7))
            m = b["s"].map(known).clip(lower=b["s"], upper=b["n_next"])
            yield b.assign(m_hat=m.astype(float), recurrences=(m - b["s"]).astype(float))

    return nodes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", m_hat double, recurrences double")


def likelihood_estimates(nodes: DataFrame, shares: DataFrame, cap: float = 1e7) -> DataFrame:
    """Add m_mle: the Poissonised maximum-likelihood number of writes given which symbols were seen.

    A symbol is seen with chance 1 - exp(-m p); the score is solved by bisection, and a
    node that has every symbol gets ``cap``.
    """
    p = {r["sym"]: r["p"] for r in shares.select("sym", "p").collect()}

    def solve(seen: tuple[str, ...]) -> float:
        own = [p[x] for x in seen if x in p]
        rest = 1.0 - sum(own)
        if not own:
            return 0.0
        if rest <= 1e-12:
            return cap
        return special.invert(lambda m: -sum(q / special.expm1(m * q) for q in own), -rest, 1e-9, cap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, ...], float] = {}
        for b in batches:
            keys = b["symbols"].map(tuple)
            for k in keys.unique():
                known.setdefault(k, solve(k))
            m = pd.Series([known[k] for k in keys], index=b.index, dtype=float)
            yield b.assign(m_mle=m.clip(lower=b["s"], upper=b["n_next"]))

    return nodes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", m_mle double")


def alphabets(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sym, n, upto, total, p: the counts of symbols by key, running in the order of symbols. A row for each symbol of an alphabet."""
    per = reads.groupBy(*keys, "sym").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    return per.withColumns({"upto": F.sum("n").over(w.orderBy("sym")), "total": F.sum("n").over(w)}).withColumn("p", F.col("n") / F.col("total"))


def drawn_sets(alphabets: DataFrame, keys: list[str], sizes: list[int], reps: int, seed: int, buckets: int = 64) -> DataFrame:
    """keys, size, rep, probs (sorted), s, mass: the distinct symbols of ``size`` draws from each alphabet, ``reps`` times.

    A draw is a place in the running counts, from a hash; it meets its symbol by an equi-join on buckets of places.
    """
    from strandline.operators.reads import uniform

    width = F.greatest(F.ceil(F.col("total") / buckets), F.lit(1)).cast("long")
    bucket = lambda x: F.floor(x / width).cast("long")
    asked = alphabets.select(*keys, "total").distinct().withColumn("size", F.explode(F.array(*(F.lit(m) for m in sizes))))
    asked = asked.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("size"))))
    asked = asked.withColumn("_at", F.floor(uniform(seed, *keys, "size", "rep", "draw") * F.col("total")).cast("long"))
    asked = asked.select(*keys, "size", "rep", "_at", bucket(F.col("_at")).alias("_b"))
    low = F.col("upto") - F.col("n")
    spans = alphabets.select(*keys, "sym", "p", low.alias("_low"), "upto", F.explode(F.sequence(bucket(low), bucket(F.col("upto") - 1))).alias("_b"))
    met = asked.join(spans, [*keys, "_b"]).where("_at >= _low AND _at < upto").select(*keys, "size", "rep", "sym", "p").distinct()
    return met.groupBy(*keys, "size", "rep").agg(F.array_sort(F.collect_list("p")).alias("probs"), F.count("*").alias("s"), F.sum("p").alias("mass"))


def bisected(above: Callable[[Column], Column], cap: float, steps: int = 60) -> Column:
    """The place in [0, cap] below which ``above`` holds, by bisection within a row."""
    half = lambda b: (b["low"] + b["high"]) / 2
    start = F.struct(F.lit(0.0).alias("low"), F.lit(float(cap)).alias("high"))
    move = lambda b, _: F.transform(F.array(half(b)), lambda m: F.when(above(m), F.struct(m.alias("low"), b["high"].alias("high"))).otherwise(F.struct(b["low"].alias("low"), m.alias("high"))))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, move, half)


def likelihood_draws(probs: Column, mass: Column, cap: float = 1e6) -> Column:
    """The number of draws at which the symbols with these shares, and no others, are most likely seen; ``cap`` if there are no others."""
    score = lambda m: F.aggregate(probs, F.lit(0.0), lambda a, p: a + p / (F.exp(F.least(m * p, F.lit(700.0))) - 1))
    return F.when(1 - mass <= 1e-12, float(cap)).otherwise(bisected(lambda m: score(m) > 1 - mass, cap))


def moment_draws(probs: Column, s: Column, cap: float = 1e6) -> Column:
    """The number of draws from an alphabet that shows s distinct symbols on average; no number shows all of them, so that is ``cap``."""
    seen = lambda m: F.aggregate(probs, F.lit(0.0), lambda a, p: a + 1 - F.pow(1 - p, m))
    return bisected(lambda m: (s >= F.size(probs)) | (seen(m) < s), cap)


def moment_table(alphabets: DataFrame, keys: list[str], asked: DataFrame, cap: float = 1e6) -> DataFrame:
    """keys, s, moment for the distinct (keys, s) of ``asked``."""
    whole = alphabets.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("_all"))
    return asked.select(*keys, "s").distinct().join(whole, keys).select(*keys, "s", moment_draws(F.col("_all"), F.col("s"), cap).alias("moment"))


def draws_per_node(nodes: DataFrame, alphabets: DataFrame, cap: float = 1e6) -> DataFrame:
    """clone, tape, level, prefix, n_next, s, mass, m_moment, m_mle, rec_moment, rec_mle: both estimates of the independent writes below each node, by the alphabet of its site, within s and n_next.

    alphabets: ``alphabets`` by site; a node of a level writes the next site. Symbols outside the alphabet don't count.
    """
    key = ["clone", "tape", "level", "prefix"]
    at = nodes.select(*key, "n_next", (F.col("level") + 1).alias("site"), F.explode("symbols").alias("sym"))
    own = at.join(alphabets.select("site", "sym", "p"), ["site", "sym"]).groupBy(*key, "site", "n_next").agg(F.array_sort(F.collect_list("p")).alias("_p"), F.count("*").alias("s"), F.sum("p").alias("mass"))
    own = own.join(moment_table(alphabets, ["site"], own, cap), ["site", "s"])
    inside = lambda m: F.least(F.greatest(m, F.col("s").cast("double")), F.col("n_next").cast("double"))
    own = own.withColumns({"m_moment": inside(F.col("moment")), "m_mle": inside(likelihood_draws(F.col("_p"), F.col("mass"), cap))})
    return own.select(*key, "n_next", "s", "mass", "m_moment", "m_mle", (F.col("m_moment") - F.col("s")).alias("rec_moment"), (F.col("m_mle") - F.col("s")).alias("rec_mle"))


def recurrence_levels(per_node: DataFrame, alphabets: DataFrame) -> DataFrame:
    """level, nodes, median_next, median_s, median_m, mean_recurrences, with_recurrence, above_birthday of ``draws_per_node``.

    A node is above the birthday number if it has as many writes as make it likely that two
    agree: the root of two over the chance that two writes of the first site do.
    """
    q = alphabets.where("site = 1").agg(F.sqrt(2 / F.sum(F.col("p") * F.col("p"))).alias("_most"))
    half = lambda c: F.percentile(c, 0.5)
    share = lambda c: F.avg(c.cast("double"))
    own = per_node.join(F.broadcast(q)).groupBy("level")
    return own.agg(F.count("*").alias("nodes"), half("n_next").alias("median_next"), half("s").alias("median_s"), half("m_moment").alias("median_m"), F.avg("rec_moment").alias("mean_recurrences"), share(F.col("rec_moment") >= 1).alias("with_recurrence"), share(F.col("m_moment") >= F.col("_most")).alias("above_birthday"))


def estimator_check(sets: DataFrame, alphabets: DataFrame, keys: list[str], cap: float = 1e6) -> DataFrame:
    """keys, size, mean_s, and median, bias and interquartile range, in per cent of the size, of both estimates over ``drawn_sets``."""
    own = sets.join(moment_table(alphabets, keys, sets, cap), [*keys, "s"]).withColumn("mle", likelihood_draws(F.col("probs"), F.col("mass"), cap))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = own.groupBy(*keys, "size").agg(F.avg("s").alias("mean_s"), q("mle").alias("_l"), q("moment").alias("_m"))
    three = lambda c, name: {f"{name}_median": F.col(c)[1], f"{name}_bias": 100 * (F.col(c)[1] - F.col("size")) / F.col("size"), f"{name}_iqr": 100 * (F.col(c)[2] - F.col(c)[0]) / F.col("size")}
    return out.withColumns(three("_l", "mle") | three("_m", "moment")).drop("_l", "_m")


def mass_null(nodes: DataFrame, sets: DataFrame, edges: list[int], least: int) -> DataFrame:
    """band, n, mass, n_null, low, middle, high, inside: the median mass of the symbols that nodes show, by bands of how many they show, against that of drawn sets that show as many.

    low, middle and high are the 5th, 50th and 95th percentile of the null, null below ``least`` sets.
    """
    from strandline.operators.reads import band

    at = band(F.col("s"), edges).alias("band")
    seen = nodes.groupBy(at).agg(F.count("*").alias("n"), F.percentile("mass", 0.5).alias("mass")).where("band IS NOT NULL")
    null = sets.groupBy(at).agg(F.count("*").alias("n_null"), F.percentile("mass", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"))
    out = seen.join(null, "band", "left").withColumn("n_null", F.coalesce("n_null", F.lit(0)))
    q = {c: F.when(F.col("n_null") >= least, F.col("_q")[i]) for i, c in enumerate(("low", "middle", "high"))}
    return out.withColumns(q).drop("_q").withColumn("inside", (F.col("mass") >= F.col("low")) & (F.col("mass") <= F.col("high")))


def level_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.percentile("s", 0.5).alias("median_s"), F.avg("n_next").alias("mean_next"), F.max("s").alias("max_s"), F.avg((F.col("s") >= 2).cast("double")).alias("branching"))


def prefix_codes(prefixes: DataFrame) -> DataFrame:
    """cell, tape, d, code: prefixes numbered from 0 in each tape and depth."""
    distinct = prefixes.select("tape", "d", "prefix").distinct()
    code = distinct.withColumn("code", F.row_number().over(W.partitionBy("tape", "d").orderBy("prefix")) - 1)
    return prefixes.join(code, ["tape", "d", "prefix"]).select("cell", "tape", "d", "code")


def characters(prefixes: DataFrame, least: int = 2) -> DataFrame:
    """clone, tape, level, prefix, m, cells: prefixes that at least ``least`` cells of a clone share."""
    own = prefixes.groupBy("clone", "tape", F.col("d").alias("level"), "prefix").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    return own.withColumn("m", F.size("cells")).where(F.col("m") >= least)


def character_ids(characters: DataFrame) -> DataFrame:
    """Add ``id``, a number in each clone."""
    return characters.withColumn("id", F.row_number().over(W.partitionBy("clone").orderBy("tape", "level", "prefix")))


def labels(tapes: DataFrame, characters: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, clone, tape, level, label, for each tape and level at which the cell's clone has a character.

    The label is the character's id, ABSENT if the tape tells its state at the level, or else UNDET.
    """
    from strandline.operators.reads import COMPLETE, UNEDITED

    own = characters.select("clone", "tape", "level", "id", F.explode("cells").alias("cell"))
    asked = characters.select("clone", "tape", "level").distinct()
    every = cells.select("cell", "clone").join(asked, "clone")
    seen = tapes.select("cell", "tape", "term", "depth")
    out = every.join(seen, ["cell", "tape"], "left").join(own, ["clone", "cell", "tape", "level"], "left")
    tells = F.coalesce((F.col("depth") >= F.col("level")) | F.col("term").isin(UNEDITED, COMPLETE), F.lit(False))
    return out.select("cell", "clone", "tape", "level", F.when(F.col("id").isNotNull(), F.col("id").cast("string")).when(tells, "ABSENT").otherwise("UNDET").alias("label"))


def consensus(prefixes: DataFrame, one_in: int = 2) -> DataFrame:
    """clone, tape, d, prefix: the commonest prefix at each depth that extends the one before and that at least one in ``one_in`` of the cells there has; ties to the smallest."""
    per = prefixes.groupBy("clone", "tape", "d", "prefix").agg(F.count("*").alias("n"))
    per = per.withColumn("_all", F.sum("n").over(W.partitionBy("clone", "tape", "d")))
    best = per.groupBy("clone", "tape", "d").agg(F.max("n").alias("n"), F.max("_all").alias("n_all"))
    least = per.join(best.select("clone", "tape", "d", F.col("n").alias("_n")), ["clone", "tape", "d"]).where("n = _n").groupBy("clone", "tape", "d").agg(F.min("prefix").alias("prefix"))
    won = best.join(least, ["clone", "tape", "d"]).where(one_in * F.col("n") >= F.col("n_all")).select("clone", "tape", "d", "prefix", "n")
    # A prefix stays if all its own starts won, too.
    parts = F.split("prefix", ">")
    starts = won.select("clone", "tape", "d", "prefix", "n", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("_d")).withColumn("_start", F.array_join(F.slice(parts, F.lit(1), F.col("_d")), ">"))
    met = starts.join(won.select("clone", "tape", F.col("d").alias("_d"), F.col("prefix").alias("_start")), ["clone", "tape", "_d", "_start"])
    return met.groupBy("clone", "tape", "d", "prefix", "n").agg(F.count("*").alias("_k")).where("_k = d").drop("_k")
