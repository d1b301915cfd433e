"""Fits, trees, scores and sources against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import special
import kernels
from strandline.operators import compat, fit, likelihood, reads, relate, splits, tree, trie, writes
from strandline.sources import tables
from strandline.streaming import ingest


def chain_and_tree(spark):
    chain = [(0, i, i - 1 if i else None, float(i), i == 699) for i in range(700)]
    rng = random.Random(4)
    parents = {0: None} | {i: rng.randrange(max(0, i - 40), i) for i in range(1, 400)}
    inner = set(parents.values())
    rows = chain + [(1, i, p, float(i), i not in inner) for i, p in parents.items()]
    return rows, spark.createDataFrame(rows, "tree long, node long, parent long, t double, tip boolean").cache()


def test_tree_operators_on_deep_trees(spark):
    rows, df = chain_and_tree(spark)
    parent = {(r[0], r[1]): r[2] for r in rows}
    path = {}
    for t, n, p, _, _ in rows:
        path[t, n] = [n] if p is None else [n, *path[t, p]]
    level = {(r.tree, r.node): r.level for r in tree.depths(df).collect()}
    assert level == {k: len(v) - 1 for k, v in path.items()}
    tips = {(r[0], r[1]) for r in rows if r[4]}
    sizes = {}
    for t, n in tips:
        for a in path[t, n]:
            sizes[t, a] = sizes.get((t, a), 0) + 1
    assert {(r.tree, r.node): r.n_tips for r in tree.clade_sizes(df).collect()} == sizes
    rng = random.Random(5)
    pairs = [(t, rng.randrange(n), rng.randrange(n)) for t, n in ((0, 700), (1, 400)) for _ in range(60)]
    got = {(r.tree, r.i, r.j): r.lca for r in tree.last_common_ancestor(df, spark.createDataFrame(pairs, "tree long, i long, j long")).collect()}
    for t, i, j in pairs:
        above = set(path[t, i])
        assert got[t, i, j] == next(a for a in path[t, j] if a in above)
    span = {(r.tree, r.node): (r.first, r.last) for r in tree.preorder(df).collect()}
    for (t, n), up in path.items():
        assert all(span[t, a][0] <= span[t, n][0] <= span[t, a][1] for a in up)
    assert sorted(x for (t, _), (x, _) in span.items() if t == 1) == list(range(1, 401)) and parent
    lost = spark.createDataFrame([(0, 350, 7), (1, 3, 7), (1, 10, 8)], "tree long, node long, key int")
    gone = {(r.tree, r.node, r.key) for r in tree.propagate(df, lost).where("lost").collect()}
    assert gone == {(t, n, k) for (t, n), up in path.items() for lt, ln, k in ((0, 350, 7), (1, 3, 7), (1, 10, 8)) if t == lt and ln in up}
    circle = spark.createDataFrame([(0, 1, 2, 0.0, False), (0, 2, 1, 0.0, False)], df.schema)
    with pytest.raises(ValueError):
        tree.jumps(circle)


def numpy_within(x, w, sweeps=400):
    a, b = np.zeros(x.shape[0]), np.zeros(x.shape[1])
    for _ in range(sweeps):
        for axis in (1, 0):
            p = 1 / (1 + np.exp(-(a[:, None] + b[None])))
            step = np.clip((w * (x - p)).sum(axis=axis) / np.maximum((w * p * (1 - p)).sum(axis=axis), 1e-9), -2, 2)
            if axis == 1:
                a = np.clip(a + step, -12, 12)
            else:
                b = np.clip(b + step, -12, 12)
    return np.clip(1 / (1 + np.exp(-(a[:, None] + b[None]))), 1e-6, 1 - 1e-6)


def entries_of(rng, cells=40, tapes=8, clones=2):
    alpha, beta = rng.normal(0, 1, cells), rng.normal(0, 1, tapes)
    return [(c, c % clones, t, int(rng.random() < 1 / (1 + math.exp(-alpha[c] - beta[t])))) for c in range(cells) for t in range(tapes)]


ENTRIES = "cell long, clone int, tape int, missing int"


def test_fit_within_groups_meets_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(*r, float(rng.random() < 0.7)) for r in entries_of(rng)]
    got = {(r.cell, r.tape): r.p for r in fit.within(spark.createDataFrame(rows, ENTRIES + ", w double"), ["clone"], "w", sweeps=40).collect()}
    for clone in (0, 1):
        own = [c for c in range(40) if c % 2 == clone]
        x, w = np.zeros((len(own), 8)), np.zeros((len(own), 8))
        for c, g, t, m, k in rows:
            if g == clone:
                x[own.index(c), t], w[own.index(c), t] = m, k
        want = numpy_within(x, w)
        fitted = np.array([[got[c, t] for t in range(8)] for c in own])
        assert np.abs(fitted - want)[w.sum(axis=1) > 0].max() < 0.02


def test_held_out_ladder_meets_numpy(spark):
    rng = np.random.default_rng(2)
    rows = entries_of(rng, 24, 6, 1)
    mates = [(0, i, (i + k) % 24, 1) for i in range(24) for k in (1, 2, 3)]
    e = spark.createDataFrame([(0, *r) for r in rows], "split int, " + ENTRIES)
    out = {r.model: r for r in fit.held_out_ladder(e, {"ring": spark.createDataFrame(mates, "split int, i long, j long, times int")}, 0.6, 3).collect()}
    mask = {(r.cell, r.tape): r.t for r in e.withColumn("mask", F.lit(0)).select("cell", "tape", splits.trains(3, 0.6, "split", "mask", "cell", "tape").alias("t")).collect()}
    x, w = np.zeros((24, 6)), np.zeros((24, 6))
    for c, _, t, m in rows:
        x[c, t], w[c, t] = m, mask[c, t]
    held = w == 0
    score = lambda p: np.log(np.where(x == 1, p, 1 - p))[held].mean()
    clip = lambda p: np.clip(p, 1e-6, 1 - 1e-6)
    assert out["M0"].nats == pytest.approx(score(np.full_like(x, clip((w * x).sum() / w.sum()))), abs=1e-6)
    assert out["M2"].nats == pytest.approx(score(np.repeat(clip((w * x).sum(1) / np.maximum(w.sum(1), 1))[:, None], 6, axis=1)), abs=1e-6)
    p = numpy_within(x, w)
    assert out["M3"].nats == pytest.approx(score(p), abs=0.02)
    r = (x - p) / np.maximum(np.sqrt(p * (1 - p)), math.sqrt(0.05 * 0.95))
    u = np.zeros_like(x)
    for i in range(24):
        near = [(i + k) % 24 for k in (1, 2, 3)]
        n = w[near].sum(axis=0)
        u[i] = np.where(n > 0, (w[near] * r[near]).sum(axis=0) / np.maximum(n, 1), 0)
    eta, slope = np.log(p / (1 - p)), 0.0
    for _ in range(80):
        q = 1 / (1 + np.exp(-(eta + slope * u)))
        slope += np.clip((w * u * (x - q)).sum() / (w * u * u * q * (1 - q)).sum(), -2, 2)
    assert out["M4 ring"].w == pytest.approx(slope, abs=0.05)
    assert out["M4 ring"].nats == pytest.approx(score(clip(1 / (1 + np.exp(-(eta + slope * u))))), abs=0.03)


def test_ridge_meets_numpy(spark):
    rng = np.random.default_rng(3)
    x, y, w = (rng.random((12, 4)) < 0.4).astype(float), rng.normal(size=(12, 2)), rng.random((12, 2)) + 0.1
    rows = spark.createDataFrame([(u, s, float(y[u, s]), float(w[u, s])) for u in range(12) for s in range(2)], "unit int, item int, y double, weight double")
    design = spark.createDataFrame([(u, t, 1.0) for u in range(12) for t in range(4) if x[u, t]], "unit int, term int, x double")
    for r in fit.ridge(rows, design, 0.5).collect():
        m = x.T @ (w[:, r.item, None] * x) + 0.5 * np.eye(4)
        inverse = np.linalg.inv(m)
        assert r.coefficient == pytest.approx((inverse @ (x.T @ (w[:, r.item] * y[:, r.item])))[r.term])
        assert r.se == pytest.approx(math.sqrt(inverse[r.term, r.term]))
        plain = x.T @ x + 0.5 * np.eye(4)
        assert r.inflation == pytest.approx((np.linalg.inv(plain) * plain)[r.term, r.term]) or r.inflation == pytest.approx(np.linalg.inv(plain)[r.term, r.term] * plain[r.term, r.term])


def test_common_log_odds_profiles_each_table(spark):
    tables_ = [(1, 10, 5, 3, 12), (1, 2, 2, 7, 1), (2, 0, 6, 4, 4), (3, 5, 0, 2, 0)]
    got = {r.u: (r.theta, r.gain) for r in writes.common_log_odds(spark.createDataFrame(tables_, "u int, a long, b long, c long, d long"), ["u"]).collect()}

    def profile(theta, rows):
        total = 0.0
        for _, a, b, c, d in rows:
            best = -math.inf
            for mu in np.linspace(-12, 12, 4001):
                p1, p0 = 1 / (1 + math.exp(-mu - theta)), 1 / (1 + math.exp(-mu))
                part = lambda n, p: n * math.log(p) if n else 0.0
                best = max(best, part(a, p1) + part(b, 1 - p1) + part(c, p0) + part(d, 1 - p0))
            total += best
        return total

    one = [r for r in tables_ if r[0] == 1]
    theta, gain = got[1]
    assert gain == pytest.approx(profile(theta, one) - profile(0.0, one), abs=1e-3)
    assert all(profile(theta, one) >= profile(theta + s, one) - 1e-3 for s in (-0.1, 0.1))
    assert got[2][0] == -8.0 and got[3] == (0.0, pytest.approx(0.0, abs=1e-6))


def test_hypergeometric_tails_of_arrays():
    rng = np.random.default_rng(6)
    n = rng.integers(1, 60, 300)
    marked, drawn = rng.integers(0, n + 1), rng.integers(0, n + 1)
    k = rng.integers(0, drawn + 2)
    want = [special.hypergeometric_sf(*map(int, x)) for x in zip(k, n, marked, drawn, strict=True)]
    assert special.hypergeometric_tails(k, n, marked, drawn) == pytest.approx(want, abs=1e-12)


def test_tree_prior_integrates_to_one(spark):
    n = 20_000
    for birth, death, rho, height in ((1.0, 0.3, 0.5, 1.0), (2.0, 0.5, 0.1, 3.0), (1.5, 0.75, 0.5, 2.0)):
        grid = spark.range(n).select(F.col("id").alias("tree"), F.lit(0).alias("node"), (height * (F.col("id") + 0.5) / n).alias("t"), F.lit(False).alias("tip"))
        total = likelihood.tree_prior(grid, birth, death, rho, height).agg(F.sum(F.exp("log_prior")) * height / n).first()[0]
        assert total == pytest.approx(1, abs=1e-4)


def test_likelihood_with_a_stem_sums_to_one():
    import itertools

    parent, time = {0: 2, 1: 2, 2: None}, {0: 1.0, 1: 1.0, 2: 0.4}
    states = [None, (), (0,), (1,), *itertools.product((0, 1), repeat=2)]
    for silence, missed in ((0.0, 0.0), (0.7, 0.2)):
        total = sum(math.exp(x) for tips in itertools.product(states, repeat=2) if (x := kernels.tape_log_likelihood(parent, time, dict(enumerate(tips)), 1.3, [0.6, 0.4], 2, silence, missed, stem=0.4)) > -math.inf)
        assert total == pytest.approx(1)


def test_skeleton_children_count_every_cell_once(spark):
    rng = random.Random(2)
    rows = [(c, c % 2, t, [rng.choice("ab") for _ in range(rng.randint(1, 3))]) for c in range(40) for t in range(6)]
    tapes = spark.createDataFrame([(c, g, "s", t, r, len(r), 1) for c, g, t, r in rows], "cell long, clone int, sample string, tape int, read array<string>, depth int, term int")
    cells = spark.createDataFrame([(c, c % 2) for c in range(40)], "cell long, clone int")
    clades = compat.proper_clades(compat.clades(trie.character_ids(trie.characters(reads.explode_prefixes(tapes)))), cells)
    nodes = compat.laminar_skeleton(clades)
    below = compat.children(nodes, cells).groupBy("clone").agg(F.sum("cells").alias("n"), F.sum("clades").alias("k")).collect()
    assert {(r.clone, r.n) for r in below} == {(0, 20), (1, 20)} and sum(r.k for r in below) == nodes.count()
    assert nodes.where("size >= 20").count() == 0


def test_independent_mates_leave_out_the_cell(spark):
    cells = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(100, 9)], "cell long, clone int")
    rows = relate.independent_mates(cells, 40, 1).collect()
    assert len(rows) == 90 * 40 and all(r.i != r.j and r.i % 3 == r.j % 3 for r in rows)
    seen = {(r.i, r.j) for r in rows}
    assert len(seen) > 0.6 * 90 * 29


def test_sources_and_sinks(spark, tmp_path):
    with open(tmp_path / "clones.csv", "w") as f:
        f.write("CellID,ClonalBC,Sample\na,7,x\nb,None,x\nc,  ,y\n")
    assert sorted(map(tuple, tables.read_clones(spark, str(tmp_path / "clones.csv")).collect())) == [("a", "7", "x"), ("b", None, "x"), ("c", None, "y")]
    df = spark.createDataFrame([(1, "a b", 0.5), (2, None, 1.5)], "k int, s string, v double")
    tables.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(str, tables.read_tsv(spark, str(tmp_path / "t"), "k int, s string, v double").collect())) == sorted(map(str, df.collect()))
    tables.write_documents(df.coalesce(1), str(tmp_path / "j"))
    for arm in ("x", "y"):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / f"map_{arm}.json").write_text('{"arm": "%s", "n": 3}' % arm)
    docs = tables.read_documents(spark, str(tmp_path / "docs")).collect()
    assert {(d.arm, d.file) for d in docs} == {("x", "map_x.json"), ("y", "map_y.json")}
    tables.write_parts(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 2").first().v == 1.5
    grid = tables.library_grid(spark, n=[2, 3], rate=[0.1, 0.2, 0.3]).collect()
    assert len({(g.n, g.rate) for g in grid}) == 6 and sorted(g.job for g in grid) == list(range(6))
    assert writes.expected_occupied(10, 5) == pytest.approx(5 * (1 - 0.8**10))


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(500)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_counts(ingest.read_events(spark, str(tmp_path / "in")), "1 day", "10 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 500


def test_exclusion_wants_known_cells(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    assert [r.cell for r in splits.exclude(cells, spark.createDataFrame([(2,), (2,)], "cell long")).collect()] == [1]
    with pytest.raises(ValueError):
        splits.exclude(cells, spark.createDataFrame([(3,)], "cell long"))


def test_shape_of_values(spark):
    x = np.random.default_rng(1).gamma(2.0, 1.0, 4000)
    got = fit.shape(spark.createDataFrame(pd.DataFrame({"x": x})), "x", -12.0, 12.0).first()
    assert got["skew"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3) and got["over_2"] == pytest.approx((x > 2).mean())


def test_scalar_functions(spark):
    from strandline.functions import piecewise
    from strandline.operators import simulate

    assert trie.expected_distinct({"a": 0.5, "b": 0.5}, 2) == pytest.approx([0.0, 1.0, 1.5])
    mean = fit.solve_mean(0.3, 1.5)
    assert special.gauss_hermite(lambda x: 1 / (1 + np.exp(-x)), mean, 1.5) == pytest.approx(0.3)
    assert sum(special.binomial_pmf(k, 7, 0.3) for k in range(8)) == pytest.approx(1) and special.binomial_pmf(0, 5, 0.0) == 1.0
    grid = (np.arange(2000) + 0.5) / 2000
    assert sum(special.beta_pdf(x, 2.5, 4.0) for x in grid) / 2000 == pytest.approx(1, abs=1e-4)
    row = spark.range(1).select(
        special.kl_bernoulli(F.lit(0.2), F.lit(0.5)).alias("kl"),
        special.fisher_z(F.lit(0.5)).alias("z"),
        special.common_prefix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd"))).alias("n"),
        tables.arm_of(F.lit("Mouse_3_left")).alias("arm"),
        F.array(*(piecewise.interpolate(F.lit(x), [0.0, 1.0, 3.0], [5.0, 7.0, 3.0]) for x in (-1.0, 0.5, 2.0, 9.0))).alias("y"),
        F.array(*(piecewise.interval_of(F.lit(x), [0.0, 1.0]) for x in (-1.0, 0.0, 5.0))).alias("i"),
    ).first()
    assert row.kl == pytest.approx(0.2 * math.log(0.4) + 0.8 * math.log(1.6)) and row.z == pytest.approx(math.atanh(0.5)) and row.n == 2
    assert row.arm == "Mouse" and list(row.y) == pytest.approx([5.0, 6.0, 5.0, 3.0]) and list(row.i) == [-1, 0, 1]
    trees = kernels.joined_trees(spark, 2, 4, 3)
    tips = simulate.decorate(trees, 2, 1.0, [0.5, 0.5]).join(trees.where("tip").select("tree", "node"), ["tree", "node"]).withColumn("seen", F.lit(True))
    profile = {r.rate: r.loglik for r in likelihood.rate_profile(trees, tips, [0.01, 1.0], [0.5, 0.5]).collect()}
    assert profile[1.0] > profile[0.01]
