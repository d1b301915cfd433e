"""Plain reference computations that the tests hold distributed operators against."""

from __future__ import annotations

import math

import numpy as np

from strandline.functions.special import poisson_pmf, poisson_sf


def advance(n: int, sites: int, mean: float) -> float:
    """Chance of n more edits with ``sites`` left, which the last one fills."""
    if n > sites:
        return 0.0
    return poisson_sf(n, mean) if n == sites else poisson_pmf(n, mean)


def tape_log_likelihood(parent: dict[int, int], time: dict[int, float], reads: dict[int, tuple[int, ...] | None], rate: float, shares: list[float], sites: int, silence: float, missed: float, stem: float = 0.0) -> float:
    """Log likelihood of a tape: ``reads`` has a tip's symbols, or None if it isn't seen. A branch of length ``stem`` leads from an empty founder to the root."""
    children: dict[int, list[int]] = {}
    root = None
    for node, up in parent.items():
        if up is None:
            root = node
        else:
            children.setdefault(up, []).append(node)
    order = sorted(parent, key=lambda n: (-time[n], n in children))
    common: dict[int, tuple[int, ...] | None] = {}
    value: dict[int, tuple[np.ndarray, float]] = {}
    scale = 0.0
    for node in order:
        if node not in children:
            read = reads.get(node)
            common[node] = read
            # With nothing seen the length doesn't matter: one value stands for all.
            own = np.array([missed]) if read is None else np.array([0.0] * len(read) + [1 - missed])
            value[node] = (own, 1.0 if read is None else 0.0)
            continue
        seen = [common[c] for c in children[node] if common[c] is not None]
        prefix: tuple[int, ...] | None = None
        for r in seen:
            if prefix is None:
                prefix = r
            else:
                same = next((i for i, (x, y) in enumerate(zip(prefix, r, strict=False)) if x != y), min(len(prefix), len(r)))
                prefix = prefix[:same]
        n = 1 if prefix is None else len(prefix) + 1
        live, silent = np.ones(n), 1.0
        for c in children[node]:
            span = time[c] - time[node]
            keep = math.exp(-silence * span)
            below, gone = value[c]
            if common[c] is None:
                live = live * (keep * below[0] + (1 - keep) * gone)
            else:
                moved = np.zeros(n)
                for k in range(n):
                    p = 1.0
                    for j in range(k, len(below)):
                        if j > k:
                            p *= shares[common[c][j - 1]]
                        moved[k] += advance(j - k, sites - k, rate * span) * p * below[j]
                live = live * (keep * moved + (1 - keep) * gone)
            silent *= gone
        top = max(live.max(), silent)
        if top > 0:
            live, silent, scale = live / top, silent / top, scale + math.log(top)
        common[node], value[node] = prefix, (live, silent)
    live, gone = value[root]
    first = live[0]
    if stem > 0:
        keep, p, reached = math.exp(-silence * stem), 1.0, first if common[root] is None else 0.0
        for k in range(len(live) if common[root] is not None else 0):
            p *= shares[common[root][k - 1]] if k else 1.0
            reached += advance(k, sites, rate * stem) * p * live[k]
        first = keep * reached + (1 - keep) * gone
    return math.log(first) + scale if first > 0 else -math.inf


def joined_trees(spark, n_trees: int, tips: int, seed: int):
    """tree, node, parent, t, tip: two random lineages join at a time, until one is left."""
    rng, rows = np.random.default_rng(seed), []
    for tree in range(n_trees):
        up, time, alive = {}, dict.fromkeys(range(tips), 1.0), list(range(tips))
        times = sorted(rng.random(tips - 1) * 0.99, reverse=True)
        times[-1] = 0.0
        for k, at in enumerate(times):
            for _ in range(2):
                up[alive.pop(int(rng.integers(len(alive))))] = tips + k
            time[tips + k] = float(at)
            alive.append(tips + k)
        rows += [(tree, n, up.get(n), t, n < tips) for n, t in time.items()]
    return spark.createDataFrame(rows, "tree long, node long, parent long, t double, tip boolean")
