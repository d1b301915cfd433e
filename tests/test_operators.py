"""Operators against brute force and invariants."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import special
from strandline.operators import compat, fit, likelihood, margins, reads, relate, scan, simulate, tree, trie, writes
import kernels
from strandline.sources import tables
from strandline.streaming import ingest

DESIGN = r"^[ACGT]{4}GGA$"
READS = "cell long, clone int, sample string, tape int, site int, sym string"


def test_reads_stop_for_three_reasons(spark):
    rows = [(1, 1, "s", t, j + 1, s) for t, syms in enumerate([["AAAAGGA"] * 6, ["AAAAGGA", "CCCCGGA"], ["AAAAGGA", "junk", "CCCCGGA"], ["junk"], ["AAAAGGA", None, "CCCCGGA"], [None, None]]) for j, s in enumerate(syms)]
    got = {r.tape: (len(r.read), r.term) for r in reads.tapes(spark.createDataFrame(rows, READS), DESIGN).collect()}
    assert got == {0: (6, reads.COMPLETE), 1: (2, reads.UNEDITED), 2: (1, reads.JUNK), 3: (0, reads.JUNK), 4: (1, reads.JUNK)}


def test_wide_tables(spark, tmp_path):
    path = str(tmp_path / "edits.csv")
    with open(path, "w") as f:
        f.write("CellID,T.1.Site1,T.1.Site2,T2.Site1\nx-1_s,AAAAGGA,None,None\ny,CCCCGGA,GGGGGGA,junk\n")
    long = tables.unpivot_sites(tables.read_wide_csv(spark, path))
    got = {(r.cell, r.tape, r.site): r.sym for r in long.collect()}
    assert got["x-1_s", "T.1", 1] == "AAAAGGA" and got["x-1_s", "T.1", 2] is None and got["y", "T2", 1] == "junk" and len(got) == 6
    assert [r[0] for r in long.select("cell").distinct().orderBy("cell").select(tables.sample_of(F.col("cell"))).collect()] == ["s", "?"]


def test_upsert_and_parts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    parts = spark.createDataFrame([(1,), (3,), (3,)], "perm int")
    found = {tuple(r) for r in tables.check_parts(parts, "perm", spark.createDataFrame([(1,), (2,), (3,)], "perm int")).collect()}
    assert found == {("missing", 2), ("duplicate", 3)}
    built = []
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), lambda s: built.append(1) or old).count() == 2
    assert built == [1]


def random_tapes(rng, n_cells=30, n_tapes=4):
    out = []
    for c in range(n_cells):
        for t in range(n_tapes):
            if rng.random() < 0.8:
                read = [rng.choice("ab") for _ in range(rng.randint(0, 3))]
                out.append((c, c % 2, "s", t, read, len(read), rng.choice([1, 2, 3])))
    return out


TAPES = "cell long, clone int, sample string, tape int, read array<string>, depth int, term int"


def test_conflicts_match_a_theta_join(spark):
    tapes = random_tapes(random.Random(1))
    df = spark.createDataFrame(tapes, TAPES)
    chars = trie.character_ids(trie.characters(reads.explode_prefixes(df))).cache()
    state = {(t[0], t[3]): t for t in tapes}
    carriers = {(r.clone, r.id): (set(r.cells), r.tape, r.level) for r in chars.collect()}
    tells = lambda cell, tape, level: (cell, tape) in state and (state[cell, tape][5] >= level or state[cell, tape][6] in (1, 3))
    want_absent, want_excluded = set(), set()
    for (c1, a), (c2, b) in itertools.combinations(sorted(carriers), 2):
        (x, ta, la), (y, tb, lb) = carriers[c1, a], carriers[c2, b]
        if c1 == c2 and ta != tb and x & y:
            if x - y and y - x:
                want_absent.add((c1, a, b))
            if any(tells(c, tb, lb) for c in x - y) and any(tells(c, ta, la) for c in y - x):
                want_excluded.add((c1, a, b))
    pairs = compat.co_occurring(chars)
    got = lambda df: {(r.clone, r.a, r.b) for r in df.where("conflict").collect()}
    assert got(compat.as_absent(pairs)) == want_absent and got(compat.excluding(pairs, chars, df)) == want_excluded and want_absent
    chosen = {(r.clone, r.id) for r in compat.independent_set(compat.as_absent(pairs).where("conflict"), chars).collect()}
    assert len(chosen) > 2 and not any((c, a) in chosen and (c, b) in chosen for c, a, b in want_absent)


def test_skeleton_is_laminar(spark):
    tapes = random_tapes(random.Random(2), 40, 6)
    clades = compat.clades(trie.character_ids(trie.characters(reads.explode_prefixes(spark.createDataFrame(tapes, TAPES)))))
    for restarts in (0, 3):
        nodes = compat.laminar_skeleton(clades, restarts).collect()
        assert len(nodes) > 3
        by = {(r.clone, r.node): r for r in nodes}
        assert all(r.parent is None or by[r.clone, r.parent].size >= r.size for r in nodes)


def test_exact_tail_and_normal_tail(spark):
    for n, marked, drawn in ((10, 4, 5), (30, 7, 12)):
        for k in range(drawn + 2):
            want = sum(math.comb(marked, i) * math.comb(n - marked, drawn - i) for i in range(k, min(marked, drawn) + 1)) / math.comb(n, drawn)
            assert special.hypergeometric_sf(k, n, marked, drawn) == pytest.approx(want, abs=1e-12)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025)
    for k, mean in ((3, 0.5), (3, 3.0), (10, 25.0)):
        assert special.poisson_sf(k, mean) == pytest.approx(1 - sum(special.poisson_pmf(i, mean) for i in range(k)))
    assert special.gauss_hermite(lambda x: x**2, 1.0, 2.0) == pytest.approx(5.0)
    assert special.invert(lambda x: x**3, 8.0, 0.0, 10.0) == pytest.approx(2.0)


def test_rho_from_sums_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=60), rng.integers(0, 6, 60)
    got = margins.within_correlation(spark.createDataFrame(pd.DataFrame({"x": x, "g": g})), "g").first()
    c = x - x.mean()
    pairs = [(i, j) for i in range(60) for j in range(60) if i != j]
    mean = lambda same: np.mean([c[i] * c[j] for i, j in pairs if (g[i] == g[j]) == same]) / c.var()
    assert got.rho_within == pytest.approx(mean(True)) and got.rho_between == pytest.approx(mean(False))


def test_permutations_keep_blocks(spark):
    e = spark.createDataFrame([(i, i % 3, t, (i * t) % 2, 0.5) for i in range(12) for t in range(4)], "cell long, clone int, tape int, missing int, p double")
    p = scan.permuted(e, 3, 7).cache()
    sums = lambda df, *k: sorted(map(tuple, df.groupBy(*k).agg(F.sum("missing")).collect()))
    for b in (1, 2, 3):
        assert sums(p.where(F.col("perm") == b), "clone", "tape") == sums(e, "clone", "tape")
    assert sorted(map(str, p.collect())) == sorted(map(str, scan.permuted(e.repartition(5), 3, 7).collect()))


def test_null_counts_take_all_depths_and_permutations(spark):
    from types import SimpleNamespace

    from strandline.plans import catalogue

    e = spark.createDataFrame([(i, 1, t, (i * t) % 2) for i in range(12) for t in range(4)], "cell long, clone int, tape int, missing int")
    p = spark.createDataFrame([(i, 1, 0, d, "A" * d) for i in range(12) for d in (1, 2, 3) if i >= 2 * d], "cell long, clone int, tape int, d int, prefix string")
    seen, null = catalogue._null_counts(SimpleNamespace(prefixes=p, entries=e), 5)
    total = lambda df, c: sum(r[c] for r in df.where("t_idx = 0").collect())
    assert total(seen, "n_above") == 9 and total(null, "expected") == 9
    assert catalogue.PERMUTATIONS >= 100


def test_two_way_fit_meets_margins(spark):
    rng = np.random.default_rng(3)
    rows = [(c, c % 4, t, int(rng.random() < 1 / (1 + np.exp(-(c - 20) / 10 - (t - 4) / 4)))) for c in range(40) for t in range(8)]
    e = spark.createDataFrame(rows, "cell long, clone int, tape int, missing int")
    f = fit.two_way(e).cache()
    off = f.groupBy("tape").agg(F.abs(F.sum("missing") - F.sum("p")).alias("d")).agg(F.max("d")).first()[0]
    assert off < 0.01
    third = fit.third_margin(f)
    assert third.groupBy("clone", "tape").agg(F.sum("missing").alias("k"), F.sum("p").alias("e"), F.count("*").alias("n")).where("k > 0 and k < n and abs(k - e) > 0.05").count() == 0
    both = third.groupBy("clone", "tape").agg(F.max("gamma").alias("g")).join(fit.clone_margins(f), ["clone", "tape"]).where("abs(g) < 10 and abs(g - gamma) > 0.05")
    assert both.count() == 0


def test_mantel_haenszel_of_one_table(spark):
    t = spark.createDataFrame([(1, 10, 5, 3, 12)], "u int, a long, b long, c long, d long")
    assert writes.mantel_haenszel(t, ["u"]).first().log_or == pytest.approx(math.log(10 * 12 / 15))


def test_mates(spark):
    cells = spark.createDataFrame([(i, i % 3, i % 7) for i in range(60)] + [(100, 9, 1)], "cell long, clone int, r int")
    for mates in (relate.random_mates(cells, 5, 1), relate.caliper_mates(cells, "r", 4, 1)):
        rows = mates.collect()
        assert len({(r.i, r.j) for r in rows}) == len(rows) and all(r.i != r.j and r.i % 3 == r.j % 3 for r in rows)
    assert len(relate.random_mates(cells, 5, 1).collect()) == 300


def test_m_estimates(spark):
    shares = spark.createDataFrame([(s, p) for s, p in zip("abcd", (0.4, 0.3, 0.2, 0.1), strict=True)], "sym string, p double")
    nodes = trie.nodes(spark.createDataFrame(random_tapes(random.Random(5)), TAPES))
    for r in trie.likelihood_estimates(trie.moment_estimates(nodes, shares), shares).collect():
        assert r.s <= r.m_hat <= r.n_next and r.s <= r.m_mle <= r.n_next and r.recurrences >= 0


def test_trees_with_edits_have_no_faults(spark):
    t = kernels.joined_trees(spark, 6, 9, 3)
    assert {r.fault: r.n for r in tree.faults(t).collect()} == {"roots": 0, "orphan": 0, "order": 0, "tip": 0}
    s = tree.statistics(t).collect()
    assert len(s) == 6 and all(r.n_tips == 9 and r.n_nodes == 17 for r in s)
    assert {r.n for r in tree.clade_sizes(t).groupBy("tree").agg(F.max("n_tips").alias("n")).collect()} == {9}
    d = simulate.decorate(t, 3, 4.0, [0.5, 0.5]).collect()
    reads_, parent = {(r.tree, r.node, r.tape): r.read for r in d}, {(r.tree, r.node): r.parent for r in t.collect()}
    for (tr, node, tape), read in reads_.items():
        assert len(read) <= 6
        if parent[tr, node] is not None:
            above = reads_[tr, parent[tr, node], tape]
            assert read[: len(above)] == above
    lost = tree.propagate(t, simulate.losses(t, 3, 1.0)).collect()
    gone = {(r.tree, r.node, r.key) for r in lost if r.lost}
    assert gone and all((tr, n, k) in gone for (tr, n), p in parent.items() for k in range(3) if p is not None and (tr, p, k) in gone)


def test_sampled_locations_lie_on_their_branches(spark):
    t = kernels.joined_trees(spark, 2, 6, 1)
    at = tree.sample_locations(t, 20).join(t, ["tree", "node"]).join(t.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"]).collect()
    assert len(at) == 40 and all(r.t0 - 1e-9 <= r["at"] <= r.t + 1e-9 for r in at)


def test_likelihood_sums_to_one():
    parent, time = {0: 3, 1: 3, 2: 4, 3: 4, 4: None}, {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.4, 4: 0.0}
    shares, sites = [0.6, 0.4], 2
    states = [None, (), (0,), (1,), *itertools.product((0, 1), repeat=2)]
    for silence, missed in ((0.0, 0.0), (0.7, 0.2)):
        total = 0.0
        for tips in itertools.product(states, repeat=3):
            ll = kernels.tape_log_likelihood(parent, time, dict(enumerate(tips)), 1.3, shares, sites, silence, missed)
            total += math.exp(ll) if ll > -math.inf else 0.0
        assert total == pytest.approx(1)


def test_survival_and_sizes(spark):
    p = spark.range(1).select(simulate.survival(1.0, 0.3, 0.5, F.lit(0.0)).alias("a"), simulate.survival(1.0, 1.0, 0.5, F.lit(2.0)).alias("b")).first()
    assert p.a == pytest.approx(0.5) and p.b == pytest.approx(0.25)
    assert sum(simulate.size_law(1.0, 0.3, 0.5, 1.0, 400)) == pytest.approx(1)


def test_streaming_reads_equal_batch_reads(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.streaming_reads(ingest.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("reads").outputMode("update").start()
    stream.processAllAvailable()
    stream.stop()
    got = {(r.cell, r.tape): list(r.read) for r in spark.table("reads").collect()}
    batch = ingest.from_events(events).groupBy("cell", "tape").agg(F.array_sort(F.collect_list(F.struct("site", "sym"))).alias("s")).collect()
    assert got == {(r.cell, r.tape): [x.sym for x in r.s] for r in batch}
