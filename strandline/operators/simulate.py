"""Laws of tree sizes, and edits, dropout and silencing on given trees.

Edits are a kernel for a tree, the rest expressions over rows. Random numbers depend on
seed and ids alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.reads import uniform

def survival(birth: float, death: float, rho: float, t: Column) -> Column:
    """Chance that a lineage has a sampled descendant after time t."""
    r = birth - death
    if abs(r) < 1e-12:
        return rho / (1 + rho * birth * t)
    return rho * r / (rho * birth + (r - rho * birth) * F.exp(-r * t))


def expected_size(birth: float, death: float, t: Column) -> Column:
    return F.exp((birth - death) * t)


def size_law(birth: float, death: float, rho: float, t: float, top: int) -> list[float]:
    """Chance of n = 1 to ``top`` sampled descendants, given one at least: a geometric law."""
    r = birth - death
    grown = np.exp(r * t)
    stop = 1 / (1 + rho * birth * (t if abs(r) < 1e-12 else (grown - 1) / r))
    return [stop * (1 - stop) ** (n - 1) for n in range(1, top + 1)]


def decorate(trees: DataFrame, n_tapes: int, rate: float, shares: list[float], sites: int = 6, seed: int = 2, stem: float = 0.0) -> DataFrame:
    """tree, node, tape, read: symbols at each node, root to tip, capped at ``sites``.

    Along each branch edits come at ``rate``; each takes a symbol by its share. Nodes
    begin with what their parent has; the root has had a branch of length ``stem``.
    """
    cut = np.cumsum(shares) / np.sum(shares)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        order = rows.sort_values("t", kind="stable")
        time = dict(zip(rows["node"], rows["t"], strict=True))
        have: dict[tuple[int, int], list[int]] = {}
        out = []
        for node, parent in zip(order["node"], order["parent"], strict=True):
            for tape in range(n_tapes):
                rng = np.random.default_rng([seed, tree, int(node), tape])
                start = have[int(parent), tape] if not pd.isna(parent) else []
                span = time[node] - time[int(parent)] if not pd.isna(parent) else stem
                n = min(sites - len(start), int(rng.poisson(rate * span)))
                have[int(node), tape] = start + np.searchsorted(cut, rng.random(n), side="right").tolist()
                out.append((tree, int(node), tape, have[int(node), tape]))
        return pd.DataFrame(out, columns=["tree", "node", "tape", "read"])

    return trees.groupBy("tree").applyInPandas(run, "tree long, node long, tape int, read array<int>")


def dropout(tips: DataFrame, rate: float, seed: int = 3) -> DataFrame:
    """Add masked: a tape is not observed, each with the same chance."""
    return tips.withColumn("masked", uniform(seed, "tree", "node", "tape") < rate)


def losses(trees: DataFrame, n_tapes: int, hazard: float, seed: int = 4) -> DataFrame:
    """tree, node, key (the tape): branches on which a tape falls silent for good."""
    up = trees.join(trees.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"])
    each = up.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(n_tapes - 1))))
    first = -F.log(1 - uniform(seed, "tree", "node", "key"))
    return each.where(first < hazard * (F.col("t") - F.col("t0"))).select("tree", "node", "key")


def observed(decorated: DataFrame, trees: DataFrame, silent: DataFrame, rate: float, seed: int = 3) -> DataFrame:
    """Tips and tapes with read and seen: not masked, not silent, and with an edit."""
    tips = decorated.join(trees.where("tip").select("tree", "node"), ["tree", "node"])
    own = dropout(tips, rate, seed).join(silent.withColumnRenamed("key", "tape"), ["tree", "node", "tape"], "left")
    return own.withColumn("seen", ~F.col("masked") & ~F.coalesce("lost", F.lit(False)) & (F.size("read") >= 1))
