"""Operators that run in rounds, levels or blocks against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import compat, fit, likelihood, margins, ranks, reads, relate, scan, tree, trie, validate, writes
from strandline.sources import bit_library, shared, tables
import kernels


def test_collapse_keeps_what_a_greedy_pass_keeps(spark):
    rng = random.Random(4)
    hits, members = [], []
    for clone in range(3):
        for anchor in range(12):
            cells = rng.sample(range(clone * 100, clone * 100 + 30), rng.randint(1, 9))
            members += [(clone, anchor, 1, "p", c) for c in cells]
            hits += [(clone, anchor, 1, "p", tape, float(rng.randint(0, 4)), set(cells)) for tape in (50, 51) if rng.random() < 0.9]
    want, used = set(), {}
    for h in sorted(hits, key=lambda h: (-h[5], h[1], h[2], h[3])):
        taken = used.setdefault((h[0], h[4]), set())
        if not taken & h[6]:
            taken |= h[6]
            want.add(h[:5])
    got = scan.collapse(spark.createDataFrame([h[:6] for h in hits], "clone int, anchor int, d int, prefix string, tape int, score double"), spark.createDataFrame(members, "clone int, anchor int, d int, prefix string, cell long"), "score")
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want) and len(want) < len(hits)
    assert scan.collapse(got.limit(0), spark.createDataFrame(members, "clone int, anchor int, d int, prefix string, cell long"), "score").count() == 0


def greedy_skeleton(clades):
    out, owner = [], {}
    for cells, size, support in sorted(clades, key=lambda c: (-c[1], -c[2], c[0])):
        owners = {owner.get(c, -1) for c in cells}
        if len(owners) == 1:
            owner.update(dict.fromkeys(cells, len(out)))
            top = owners.pop()
            out.append((len(out), None if top < 0 else top, size, support))
    return out


def test_skeleton_is_the_one_of_a_greedy_pass(spark):
    rng = random.Random(5)
    clades = {k: {tuple(sorted(rng.sample(range(n), rng.randint(2, n - 1)))) for _ in range(60)} | {tuple(range(i, i + w)) for w in (2, 4, 8) for i in range(0, n - w, w)} for k, n in ((1, 12), (2, 25), (3, 9))}
    rows = [(k, list(c), len(c), rng.randint(1, 3)) for k, cs in clades.items() for c in sorted(cs)]
    df = spark.createDataFrame(rows, "clone int, cells array<long>, size int, support long")
    got = sorted(map(tuple, compat.laminar_skeleton(df).collect()), key=lambda r: r[:2])
    want = [(k, *n) for k in clades for n in greedy_skeleton([(tuple(c), s, p) for kk, c, s, p in rows if kk == k])]
    assert got == want and any(n[2] is not None for n in want)
    more = compat.laminar_skeleton(df, 4)
    count = lambda rows: {k: sum(r[0] == k for r in rows) for k in clades}
    again = count(list(map(tuple, more.collect())))
    assert all(again[k] >= count(want)[k] for k in clades)
    assert compat.laminar_skeleton(df.limit(0)).count() == 0


def test_independent_set_in_rounds(spark):
    rng = random.Random(6)
    nodes = [(c, i) for c in (1, 2) for i in range(40)]
    edges = [(c, a, b) for c in (1, 2) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.08 * c]
    near = {v: set() for v in nodes}
    for c, a, b in edges:
        near[c, a].add((c, b))
        near[c, b].add((c, a))
    left, want = set(nodes), set()
    while left:
        key = {v: (len(near[v] & left), v[1]) for v in left}
        taken = {v for v in left if all(key[v] < key[u] for u in near[v] & left)}
        want |= taken
        left -= taken | {u for v in taken for u in near[v]}
    got = {tuple(r) for r in compat.independent_set(spark.createDataFrame(edges, "clone int, a long, b long"), spark.createDataFrame(nodes, "clone int, id long")).collect()}
    assert got == want and not any((c, a) in got and (c, b) in got for c, a, b in edges)
    one, alive = set(), set(nodes)
    while alive:
        v = min(alive, key=lambda v: (len(near[v] & alive), v[1]))
        one.add(v)
        alive -= near[v] | {v}
    assert len(got) >= 0.9 * len(one)


def test_clone_margins_meet_the_counts(spark):
    rng = np.random.default_rng(7)
    rows = [(c, c % 4, t, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.4)) for c in range(60) for t in range(6)]
    rows += [(100 + c, 9, t, 0.3, -0.2, int(t == 0)) for c in range(5) for t in range(2)]
    df = spark.createDataFrame(rows, "cell long, clone int, tape int, alpha double, beta double, missing int")
    gamma = {(r.clone, r.tape): r.gamma for r in fit.clone_margins(df).collect()}
    assert gamma[9, 0] == 15.0 and gamma[9, 1] == -15.0
    for (clone, tape), g in gamma.items():
        own = [(a + b, m) for _, k, t, a, b, m in rows if (k, t) == (clone, tape)]
        if abs(g) < 15:
            assert sum(1 / (1 + math.exp(-e - g)) for e, _ in own) == pytest.approx(sum(m for _, m in own), abs=1e-6)
    p = fit.third_margin(df).where("clone <> 9").groupBy("clone", "tape").agg(F.sum("p").alias("p"), F.sum("missing").alias("k"))
    assert p.where("abs(p - k) > 1e-4 AND k > 0 AND p < 14.99").count() == 0


@pytest.mark.parametrize("silence, missed, stem", [(0.0, 0.0, 0.0), (0.3, 0.2, 0.7), (0.5, 0.1, 0.0), (0.0, 0.25, 0.4)])
def test_likelihoods_by_level_equal_the_kernel(spark, silence, missed, stem):
    rng = random.Random(8)
    trees, tips, want = [], [], {}
    for tree in range(4):
        parent, time = {0: None}, {0: 0.0}
        for node in range(1, 5 + 6 * tree):
            parent[node] = rng.randrange(max(0, node - 4), node)
            time[node] = time[parent[node]] + rng.choice([0.02, 0.1, 0.5, 1.5])
        inner = set(parent.values())
        trees += [(tree, n, p, time[n], n not in inner) for n, p in parent.items()]
        for tape in range(4):
            seen = {}
            founder = [rng.randrange(3) for _ in range(rng.randint(0, 2))]
            for n in parent:
                if n not in inner:
                    read = (founder + [rng.randrange(3) for _ in range(rng.randint(0, 3))])[:4]
                    seen[n] = tuple(read) if rng.random() < (0.7 if missed else 1.1) else None
                    if seen[n] is not None or rng.random() < 0.5:
                        tips.append((tree, n, tape, read, seen[n] is not None))
            if tape == 3:
                seen = dict.fromkeys(seen)
                tips = [t for t in tips if t[:1] != (tree,) or t[2] != 3] + [(tree, n, 3, [], False) for n in list(seen)[:1]]
            want[tree, tape] = kernels.tape_log_likelihood(parent, time, seen, 0.9, [0.5, 0.3, 0.2], 4, silence, missed, stem)
    t = spark.createDataFrame(trees, "tree long, node long, parent long, t double, tip boolean")
    r = spark.createDataFrame(tips, "tree long, node long, tape int, read array<int>, seen boolean")
    got = {(x.tree, x.tape): x.loglik for x in likelihood.log_likelihoods(t, r, 0.9, [0.5, 0.3, 0.2], 4, silence, missed, stem).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_poisson_tail_keeps_its_digits(spark):
    for n in (0, 1, 4, 6):
        for mean in (0.0, 1e-6, 0.3, 3.0, 40.0):
            got = spark.range(1).select(likelihood.poisson_tail(n, F.lit(mean)).alias("x")).first()[0]
            want = 1.0 if n == 0 else math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(n, n + 300)) if mean else 0.0
            assert got == pytest.approx(want, rel=1e-10)


def relatives(spark, seed=9, n=40):
    rng = random.Random(seed)
    tapes = [(c, c % 2, "s", t, [rng.choice("ab") for _ in range(rng.randint(0, 3))]) for c in range(n) for t in range(5) if rng.random() < 0.7]
    tapes = [(*t, len(t[4]), 1) for t in tapes]
    df = spark.createDataFrame(tapes, "cell long, clone int, sample string, tape int, read array<string>, depth int, term int")
    by = {(t[0], t[3]): t[4] for t in tapes if t[4]}
    own = {}
    for i, j in itertools.combinations(range(n), 2):
        if i % 2 == j % 2:
            both = [t for t in range(5) if (i, t) in by and (j, t) in by]
            same = sum(sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(by[i, t], by[j, t]))) for t in both)
            if both:
                own[i, j] = (same, len(both))
    return df, reads.explode_prefixes(df), own


@pytest.mark.parametrize("block, width", [(1024, 4096), (7, 3)])
def test_pairs_in_blocks(spark, monkeypatch, block, width):
    monkeypatch.setattr(relate.in_blocks, "__defaults__", (block,))
    monkeypatch.setattr(relate, "WIDTH", width)
    tapes, prefixes, own = relatives(spark)
    got = {(r.i, r.j): (r.shared, r.joint) for r in relate.pairs(prefixes, tapes).collect()}
    assert got == own
    near = {}
    for r in relate.nearest_mates(prefixes, tapes, 3).collect():
        near.setdefault(r.i, {})[r["rank"]] = r.j
    for i in range(40):
        rel = {j if a == i else a: s / t for (a, j), (s, t) in own.items() if i in (a, j)}
        assert near.get(i, {}) == {k + 1: j for k, j in enumerate(sorted(rel, key=lambda j: (-rel[j], j))[:3])}
    rng = np.random.default_rng(1)
    r = {(c, t): float(rng.normal()) for c in range(40) for t in range(4) if rng.random() < 0.8}
    sums = relate.products_by_relatedness(prefixes, tapes, spark.createDataFrame([(c, t, v) for (c, t), v in r.items()], "cell long, tape int, r double"))
    want = {}
    for (i, j), (s, t) in own.items():
        met = [r[i, k] * r[j, k] for k in range(4) if (i, k) in r and (j, k) in r]
        w = want.setdefault((i % 2, s, t), [0, 0, 0, 0.0, 0.0])
        for n, v in enumerate((1, bool(met), len(met), sum(met), sum(met) / max(len(met), 1))):
            w[n] += v
    assert {(x.clone, x.shared, x.joint): pytest.approx([x.pairs, x.with_tapes, x.tapes, x.product, x["mean"]]) for x in sums.collect()} == want
    bins = relate.variogram(sums, 3).orderBy("bin").collect()
    rel = sorted(s / t for s, t in own.values())
    edges = sorted(set(np.quantile(rel, [0, 1 / 3, 2 / 3])))
    for b, row in enumerate(bins):
        high = edges[b + 1] if b + 1 < len(edges) else math.inf
        inside = [w for (_, s, t), w in want.items() if edges[b] <= s / t < high]
        assert row.n_pairs == sum(w[1] for w in inside) and row["product"] == pytest.approx(sum(w[3] for w in inside) / sum(w[2] for w in inside))


def test_draws_and_estimates(spark):
    rows = [(1, s) for s, n in (("a", 50), ("b", 30), ("c", 15), ("d", 5)) for _ in range(n)]
    known = trie.alphabets(spark.createDataFrame(rows, "site int, sym string"), ["site"])
    p = {r.sym: r.p for r in known.collect()}
    assert p == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05})
    for buckets in (1, 3, 64, 1000):
        sets = trie.drawn_sets(known, ["site"], [1, 4, 60], 200, 5, buckets)
        first = sorted((r["size"], r.rep, r.s, round(r.mass, 9)) for r in sets.collect())
        assert len(first) == 600 and (buckets == 1 or first == last)
        last = first
    mean = {m: sum(r[2] for r in first if r[0] == m) / 200 for m in (1, 4, 60)}
    assert all(mean[m] == pytest.approx(sum(1 - (1 - q) ** m for q in p.values()), abs=0.15) for m in mean)
    check = {r["size"]: r for r in trie.estimator_check(sets, known, ["site"], 1000.0).collect()}
    assert check[1].mle_median == pytest.approx(1.25, abs=0.5) and check[1].moment_median == pytest.approx(1.0, abs=1e-6) and check[60].mle_median == 1000.0
    nodes = spark.createDataFrame([(1, 1, 0, "", 5, 2, ["a", "d"]), (1, 1, 0, "x", 3, 1, ["zz"]), (1, 2, 0, "", 9, 4, ["a", "b", "c", "d"])], "clone int, tape int, level int, prefix string, n_next long, s long, symbols array<string>")
    old = {(r.tape, r.prefix): r.m_mle for r in trie.likelihood_estimates(nodes, known).collect()}
    new = {(r.tape, r.prefix): r for r in trie.draws_per_node(nodes, known).collect()}
    assert new.keys() == {(1, ""), (2, "")} and all(r.m_mle == pytest.approx(old[k], abs=1e-6) for k, r in new.items()) and new[2, ""].m_mle == 9
    null = trie.mass_null(trie.draws_per_node(nodes, known), sets, [1, 2, 3, 5], 30).collect()
    assert {r.band: r.n for r in null} == {1: 1, 2: 1} and all(r.low <= r.middle <= r.high for r in null)


def test_depletion_finds_a_planted_symbol(spark):
    """The clade never writes Z; the null rarely does worse, and every count is that of plain Python."""
    rng = random.Random(10)
    inside = set(range(40))
    rows = []
    for c in range(120):
        for t in range(8):
            read = [rng.choice("ABCDEF" if c in inside else "ABCDEFZZZ") for _ in range(2)]
            rows.append((c, 1, "s", t, read, 2, 1))
    tapes = spark.createDataFrame(rows, "cell long, clone int, sample string, tape int, read array<string>, depth int, term int")
    cells = spark.createDataFrame([(c, 1) for c in range(120)] + [(500, 2)], "cell long, clone int")
    events = spark.createDataFrame([(1, 0, 1, "q", 1)], "clone int, anchor int, d int, prefix string, tape int")
    members = spark.createDataFrame([(1, 0, 1, "q", c) for c in inside], "clone int, anchor int, d int, prefix string, cell long")
    out = writes.depletion(tapes, cells, events, members, 30, 3, 10).collect()
    (r,) = out

    def wrote(own):
        kids = {}
        for c, _, _, t, read, *_ in rows:
            if c in own and t not in (0, 1):
                for d in range(2):
                    kids.setdefault((t, tuple(read[:d])), set()).add(read[d])
        return sum(len(k) for k in kids.values() if len(k) >= 2)

    assert (r.cells_in, r.writes_in, r.writes_out) == (40, wrote(inside), wrote(set(range(40, 120))))
    assert r.top == "Z" and r.theta < 0 and r.n_used == 30 and r.p <= 2 / 31 and r.null_max >= r.null_mean
    assert writes.depletion(tapes, cells, events, members, 2, 3, 10_000).count() == 0


def test_states_of_loops_are_removed(spark):
    one = shared.written(spark.range(3), "state")
    two = shared.rewritten(one.selectExpr("id + 1 AS id"), one, "state")
    assert sorted(r.id for r in two.collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        one.count()
    shared.forget(two)
    with pytest.raises(Exception):
        two.count()


def test_bit_library(spark, tmp_path):
    """Rows of several widths come back; parts are pruned; stray, missing and damaged files and parts are errors."""
    rng = random.Random(11)
    rows = [(p, i, [rng.random() < 0.5 for _ in range(n)]) for p, n in (("a", 13), ("b", 8), ("c", 1), ("c", 0)) for i in range(50)]
    df = spark.createDataFrame(rows, bit_library.SCHEMA)
    path = str(tmp_path / "lib")
    bit_library.write_bits(df.where("part <> 'c'"), path, rows=16)
    bit_library.write_bits(df.where("part = 'c'"), path)
    key = lambda r: (r[0], r[1], list(r[2]))
    assert sorted(map(key, bit_library.read_bits(spark, path, expected=["a", "b", "c"]).collect())) == sorted(rows)
    only = bit_library.read_bits(spark, path, ["b"])
    assert sorted(map(key, only.collect())) == sorted(r for r in rows if r[0] == "b")
    files = sorted((tmp_path / "lib").glob("job-*/bits-*"))
    assert len(files) >= 4 and only.rdd.getNumPartitions() < len(files)
    for bad in ({"expected": ["a", "b"]}, {"expected": ["a", "b", "c", "d"]}, {"parts": ["x"]}):
        with pytest.raises(Exception, match="parts"):
            bit_library.read_bits(spark, path, **bad).count()
    stray = files[0].with_name("bits-stray")
    stray.write_bytes(b"x")
    with pytest.raises(Exception, match="stray files"):
        bit_library.read_bits(spark, path).count()
    stray.unlink()
    data = files[0].read_bytes()
    files[0].write_bytes(data[:-1] + bytes([data[-1] ^ 255]))
    with pytest.raises(Exception, match="damaged file"):
        bit_library.read_bits(spark, path).collect()
    files[0].unlink()
    with pytest.raises(Exception, match="missing files"):
        bit_library.read_bits(spark, path).count()
    bit_library.write_bits(df.where("part = 'b'"), str(tmp_path / "other"), mode="overwrite")
    bit_library.write_bits(df.where("part = 'a'"), str(tmp_path / "other"), mode="overwrite")
    assert {r.part for r in bit_library.read_bits(spark, str(tmp_path / "other")).collect()} == {"a"}
    with pytest.raises(Exception, match="no nulls"):
        bit_library.write_bits(spark.createDataFrame([("a", None, [True])], bit_library.SCHEMA), str(tmp_path / "third"))


def test_merging_arms(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "x")], "k int, a string").write.parquet(f"{folder}/arm=A")
    spark.createDataFrame([(1 << 40, 0.5)], "k long, b double").write.parquet(f"{folder}/arm=B")
    got = tables.merge_arms(spark, f"{folder}/arm=*", ["A", "B"])
    assert sorted(map(tuple, got.select("arm", "k", "a", "b").collect())) == [("A", 1, "x", None), ("B", 1 << 40, None, 0.5)]
    for arms, said in ((["A", "B", "C"], "missing: C"), (["A"], "unexpected: B")):
        with pytest.raises(ValueError, match=said):
            tables.merge_arms(spark, f"{folder}/arm=*", arms)
    spark.createDataFrame([(2, "y")], "k int, a string").write.parquet(f"{folder}/A.parquet")
    with pytest.raises(ValueError, match="doubled: A"):
        tables.merge_arms(spark, f"{folder}/*", ["A", "B"])
    with pytest.raises(ValueError, match="missing"):
        tables.merge_arms(spark, f"{folder}/none/*", ["A"])


def test_histories(spark):
    """Two trees that differ in ids and the order of children only have one key; another order of joins, or of tips, has another."""
    tips = [(n, True) for n in range(4)]
    make = lambda tree, parent, time: [(tree, n, parent.get(n), time.get(n, 3.0), n < 4) for n in sorted({*parent, *parent.values()})]
    rows = make(1, {0: 10, 1: 10, 2: 11, 3: 11, 10: 12, 11: 12}, {10: 2.0, 11: 1.0, 12: 0.0})
    rows += make(2, {3: 70, 2: 70, 1: 90, 0: 90, 70: 50, 90: 50}, {90: 2.5, 70: 0.4, 50: 0.0})
    rows += make(3, {0: 10, 1: 10, 2: 11, 3: 11, 10: 12, 11: 12}, {10: 1.0, 11: 2.0, 12: 0.0})
    rows += make(4, {0: 10, 2: 10, 1: 11, 3: 11, 10: 12, 11: 12}, {10: 2.0, 11: 1.0, 12: 0.0})
    keys = {r.tree: (r.n_nodes, r.key) for r in tree.history_keys(spark.createDataFrame(rows, "tree long, node long, parent long, t double, tip boolean")).collect()}
    assert len(tips) == 4 and keys[1] == keys[2] and len(set(keys.values())) == 3 and keys[1][0] == 3


def test_two_way_centring(spark):
    """Residuals sum to nothing over cells and tapes, and rho is that of NumPy."""
    rng = np.random.default_rng(12)
    n, k = 60, 8
    a, b = rng.normal(size=n), rng.normal(size=k)
    m = (rng.random((n, k)) < 1 / (1 + np.exp(-a[:, None] - b))).astype(float)
    rows = [(i, i % 5, f"s{i % 2}", t, float(m[i, t]), 1.0) for i in range(n) for t in range(k)]
    out = margins.with_two_way_mean(spark.createDataFrame(rows, "cell long, clone int, sample string, tape int, x double, w double"), 40).toPandas()
    p = out.pivot(index="cell", columns="tape", values="p").to_numpy()
    mixed = (m.sum(axis=1) > 0) & (m.sum(axis=1) < k)
    assert np.abs((m - p).sum(axis=0)).max() < 1e-3 and np.abs((m - p).sum(axis=1)[mixed]).max() < 1e-3
    r, s = m - p, np.sqrt(p * (1 - p))
    pair = lambda x, g: sum(x[g == c].sum(axis=0) ** 2 - (x[g == c] ** 2).sum(axis=0) for c in set(g))
    clone, sample = np.arange(n) % 5, np.arange(n) % 2
    got = margins.pooled_rho(spark.createDataFrame(out)).first()
    assert got.rho_within == pytest.approx(pair(r, clone).sum() / pair(s, clone).sum())
    assert got.rho_between == pytest.approx((pair(r, sample) - pair(r, clone)).sum() / (pair(s, sample) - pair(s, clone)).sum())


def test_tests_and_their_summaries(spark):
    """Cuts, counts and histograms over tests, by hand."""
    rows = [("c1", 1, 6, 3, 10, 5, 3.0, 0.6, 0.004, 0), ("c1", 2, 10, 5, 10, 5, 5.0, 0.0, 0.5, 2), ("c2", 1, 5, 5, 20, 5, 1.25, 0.7, 0.03, 0), ("c2", 3, 3, 1, 20, 5, 0.75, 0.4, 0.2, 0), ("c2", 4, 8, 2, 20, 0, 0.0, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "clone string, tape int, m int, k int, n_pop int, k_pop int, e double, v_pop double, p_used double, stratum int")
    own = scan.testable(df)
    assert [r.testable for r in own.orderBy("clone", "tape").collect()] == [True, False, True, False, False]
    passed = scan.bonferroni(own, "p_used", 0.04)
    assert {(r.clone, r.tape) for r in passed.where("passes").collect()} == {("c1", 1)}
    s = scan.event_summary(df).first()
    assert (s.n_events, s.n_tapes, s.n_clones, s.missing, s.expected, s.median_m) == (5, 4, 2, 16, 10.0, 6.0)
    excess = {r.t: (r.observed, r.expected) for r in scan.survival_excess(df, "p_used", [1, 2]).collect()}
    assert excess == {1: (2, pytest.approx(0.5)), 2: (1, pytest.approx(0.05))}
    plane = scan.detection_plane(df.selectExpr("stratum", "k / m AS x", "CAST(tape AS double) AS y"), "x", "y", 4, 3, 3.0)
    assert sorted(map(tuple, plane.collect())) == [(0, 1, 2, 1), (0, 2, 1, 1), (0, 3, 1, 1), (1, 1, 2, 1), (2, 2, 2, 1)]
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "i int, k string"), spark.createDataFrame([(2, "y"), (3, "z")], "i int, k string")
    assert tuple(validate.same_events(a, b, ["i", "k"]).first()) == (1, 1, 1)


def test_numbers_in_ranges(spark):
    rng = random.Random(13)
    rows = [(rng.randint(0, 9), i) for i in rng.sample(range(1000), 300)]
    got = {r.i: r.k for r in ranks.numbered(spark.createDataFrame(rows, "x int, i int").repartition(7), "k", "x", "i").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted(rows), 1)}
    assert ranks.numbered(spark.createDataFrame([], "x int, i int"), "k", "x").count() == 0


def test_equal_tips_send_one_message(spark, monkeypatch):
    """Tips of one node that show the same are one row, however many they are; and tapes that no tip shows can be asked for (F33, F40)."""
    tree_ = spark.createDataFrame([(0, 0, None, 0.0, False), *((0, n, 0, 1.0, True) for n in range(1, 201))], "tree long, node long, parent long, t double, tip boolean")
    read = {n: [n % 2] * (n % 3) for n in range(1, 151)}
    tips = spark.createDataFrame([(0, n, 5, r, True) for n, r in read.items()], "tree long, node long, tape int, read array<int>, seen boolean")
    asked = spark.createDataFrame([(0, 5), (0, 6)], "tree long, tape int")
    sizes = []
    own = likelihood.Pruning.along
    monkeypatch.setattr(likelihood.Pruning, "along", lambda self, rows, span: sizes.append(rows.count()) or own(self, rows, span))
    got = {x.tape: x.loglik for x in likelihood.log_likelihoods(tree_, tips, 0.9, [0.6, 0.4], 4, 0.3, 0.2, 0.5, asked).collect()}
    parent, time = {0: None} | dict.fromkeys(range(1, 201), 0), {0: 0.0} | dict.fromkeys(range(1, 201), 1.0)
    want = {tape: kernels.tape_log_likelihood(parent, time, {n: tuple(read[n]) if tape == 5 and n in read else None for n in range(1, 201)}, 0.9, [0.6, 0.4], 4, 0.3, 0.2, 0.5) for tape in (5, 6)}
    assert got == pytest.approx(want, rel=1e-9)
    assert max(sizes) <= 7  # five reads and the unseen ones of tape 5, and those of tape 6


def test_collapse_by_examples_of_equal_cells(spark):
    """Sums from bits equal those of joined entries, with more tapes than a number has bits; equal cells meet hits once, and the same hits stay (F34, F35, F36, F39)."""
    rnd = random.Random(12)
    kinds = [{t: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) for t in range(90) if rnd.random() < 0.15} for _ in range(12)]
    rows = [(c, c % 2, "s", t, list(r), len(r), 1) for c in range(96) for t, r in kinds[c % 12].items()]
    tapes = spark.createDataFrame(rows, "cell long, clone long, sample string, tape int, read array<string>, depth int, term int")
    cells = spark.createDataFrame([(c, c % 2, "s") for c in range(100)], "cell long, clone long, sample string")
    e = scan.with_rates(reads.entries(tapes, cells)).cache()
    prefixes = reads.explode_prefixes(tapes)
    got = lambda df: {(r.clone, r.anchor, r.d, r.prefix, r.tape): (r.m, r.k, *(round(r[c], 8) for c in ("e", "v", "hard", "u"))) for r in df.collect()}
    assert got(scan.tape_combos(tapes, e)) == got(scan.combos(prefixes, e)) and e.select("tape").distinct().count() > 62
    hits = scan.statistics(scan.tape_combos(tapes, e)).where("z > 0.5").withColumn("soft", F.round("soft", 9)).cache()
    some, every = scan.clade_examples(tapes), scan.clade_members(prefixes)
    assert some.select("cell").distinct().count() <= 12 < every.select("cell").distinct().count()
    key = lambda df: sorted(tuple(r) for r in df.select(*scan.COMBO).collect())
    assert key(scan.collapse(hits, some, "soft")) == key(scan.collapse(hits, every, "soft"))
    assert {r.cell: r.same for r in reads.equal_cells(tapes).collect()} == {c: c % 12 for c in range(96) if any(kinds[c % 12].values())}


def test_clade_counts_equal_the_permuted_join(spark):
    """Counts from ordered runs, over batches shorter than a clade, equal those of permuted entries joined with clades."""
    rnd = random.Random(8)
    reads_ = {(c, t): "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) for c in range(60) for t in range(9) if rnd.random() < 0.7}
    tapes = spark.createDataFrame([(c, c % 2, "s", t, list(r), len(r), 1) for (c, t), r in reads_.items()], "cell long, clone long, sample string, tape int, read array<string>, depth int, term int")
    cells = spark.createDataFrame([(c, c % 2, "s") for c in range(60)], "cell long, clone long, sample string")
    e = scan.with_rates(reads.entries(tapes, cells)).cache()
    prefixes = reads.explode_prefixes(tapes)
    got = lambda df: {(r.perm, r.clone, r.anchor, r.d, r.prefix, r.tape): (r.m, r.k, *(round(r[c], 9) for c in ("e", "v", "hard", "u"))) for r in df.collect()}
    want = got(scan.combos(prefixes, e.withColumn("perm", F.lit(0)), by=["perm"]).unionByName(scan.combos(prefixes, scan.permuted(e, 3, 7), by=["perm"])))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(scan.counted_combos(scan.clade_counts(prefixes, e, 3, 7))) == want and len({k[0] for k in want}) == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_moved_rows_are_never_broadcast(spark):
    """Rows of all permutations, which estimates of size take for those of one, are shuffled and not sent to the driver."""
    from strandline.operators import splits

    cells = spark.range(200).selectExpr("id AS cell", "CAST(id % 5 AS int) AS clone", "CAST(id % 2 AS string) AS sample", "CAST(id % 7 AS double) AS x")
    values = cells.withColumn("tape", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", F.lit(1.0))
    plans = [margins.permutation_null(cells, "clone", "sample", "cell", 50, 7), splits.permuted_cells(cells, 50, 7, "sample"), margins.tape_null(margins.with_tape_mean(values), splits.permuted_cells(cells, 50, 7, "sample"))]
    for df in plans[:2]:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert "perm" not in " ".join(line for line in plans[2]._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line and "source" in line)
    # The sums-only form equals the plain definition.
    x = np.array([r.x for r in cells.orderBy("cell").collect()])
    c, g = x - x.mean(), np.arange(200) % 5
    own = sum((c[g == k].sum() ** 2 - (c[g == k] ** 2).sum()) for k in range(5))
    assert math.isclose(margins.within_correlation(cells, "clone").first().rho_within, own / (5 * 40 * 39) / c.var(), rel_tol=1e-9)


def test_copies_of_cells_are_one_row_of_a_block(spark, monkeypatch):
    """Equal cells meet as one class, and mates, sums and the audit are those of all pairs."""
    tapes, _, _ = relatives(spark, n=24)
    for step in (24, 48):
        tapes = tapes.unionByName(tapes.where("cell < 24").withColumn("cell", F.col("cell") + step))
    tapes = tapes.cache()
    prefixes = reads.explode_prefixes(tapes)
    sent, whole = [], relate.in_blocks

    def counting(features, *args):
        sent.append(features.count())
        return whole(features, *args)

    pairs = relate.pairs(prefixes, tapes).toPandas()
    monkeypatch.setattr(relate, "in_blocks", counting)
    near = {(r.i, r["rank"]): r.j for r in relate.nearest_mates(prefixes, tapes, 4).collect()}
    both = [(r.i, r.j, r.rel) for r in pairs.itertuples()] + [(r.j, r.i, r.rel) for r in pairs.itertuples()]
    want = {}
    for i in {b[0] for b in both}:
        for k, (_, j) in enumerate(sorted((-rel, j) for x, j, rel in both if x == i)[:4]):
            want[i, k + 1] = j
    assert near == want
    rng = np.random.default_rng(2)
    r = {c: rng.normal(size=4) for c in range(72)}
    res = spark.createDataFrame([(c, t, float(v)) for c, x in r.items() for t, v in enumerate(x)], "cell long, tape int, r double")
    sums = {(x.clone, x.shared, x.joint): (x.pairs, x.tapes, round(x.product, 6)) for x in relate.products_by_relatedness(prefixes, tapes, res).collect()}
    brute = {}
    for p in pairs.itertuples():
        n, t, v = brute.get((p.clone, p.shared, p.joint), (0, 0, 0.0))
        brute[p.clone, p.shared, p.joint] = (n + 1, t + 4, v + float(r[p.i] @ r[p.j]))
    assert sums == {k: (n, t, round(v, 6)) for k, (n, t, v) in brute.items()}
    audit = relate.audit(relate.products_by_relatedness(prefixes, tapes, None)).collect()
    assert sum(x.n for x in audit) == len(pairs) and audit[0]["corr"] == pytest.approx(pairs["rel"].corr(pairs["joint"]))
    assert max(sent) <= 24


def test_caliper_mates_make_no_rows_of_pairs(spark):
    """Mates are chosen where buckets meet; only they are rows, and they are those of all pairs within the caliper."""
    import hashlib

    cells = spark.createDataFrame([(c, c % 2, c * 7 % 11) for c in range(90)], "cell long, clone int, r int")
    df = relate.caliper_mates(cells, "r", 4, 9)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = set()
    for clone in (0, 1):
        own = sorted((c * 7 % 11, c) for c in range(90) if c % 2 == clone)
        for x, (_, i) in enumerate(own):
            near = [j for y, (_, j) in enumerate(own) if j != i and abs(x - y) <= 3]
            want |= {(clone, i, j, n + 1) for n, j in enumerate(sorted(near, key=lambda j: hashlib.md5(f"9|{i}|{j}".encode()).hexdigest())[:4])}
    assert {tuple(r) for r in df.collect()} == want


def test_cells_with_equal_tapes_meet_once(spark):
    """Copies of cells add to counts, not to the rows that pairs are made from."""
    rng, n = random.Random(9), 7
    one = [(c, 0, t, [rng.choice("ab") for _ in range(rng.randint(0, 3))], rng.choice([1, 2])) for c in range(12) for t in range(4)]
    rows = [(c + 100 * k, clone, "s", t, read, len(read), 3 if len(read) == 3 else term) for k in range(n) for c, clone, t, read, term in one]
    tapes = spark.createDataFrame(rows, "cell long, clone int, sample string, tape int, read array<string>, depth int, term int")
    prefixes = reads.explode_prefixes(tapes)
    chars = trie.character_ids(trie.characters(prefixes)).cache()
    assert compat.cell_sets(chars).count() <= 12 and compat.cell_sets(chars).agg(F.sum("n")).first()[0] <= 12 * n
    pairs = compat.co_occurring(chars)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    state = {(r[0], r[3]): r for r in rows}
    tells = lambda cell, tape, level: (cell, tape) in state and (state[cell, tape][5] >= level or state[cell, tape][6] in (1, 3))
    own = {r.id: r for r in chars.collect()}
    want = {}
    for a, b in itertools.combinations(sorted(own), 2):
        x, y = own[a], own[b]
        both = set(x.cells) & set(y.cells)
        if x.tape != y.tape and both:
            want[a, b] = (len(both), sum(tells(c, y.tape, y.level) for c in x.cells) - len(both), sum(tells(c, x.tape, x.level) for c in y.cells) - len(both))
    excluded = {(r.a, r.b): (r.n11, r.n10, r.n01) for r in compat.excluding(pairs, chars, tapes).collect()}
    cells = tapes.select("cell", "clone").distinct()
    crossed = {(r.a, r.b): (r.n11, r.n10, r.n01) for r in compat.crosstab(trie.labels(tapes, chars, cells)).collect()}
    assert want and excluded == want and crossed == want


def test_copies_of_cells_are_sent_to_blocks_together(spark, monkeypatch):
    rng = random.Random(10)
    one = [(c, t, [rng.choice("ab") for _ in range(rng.randint(1, 2))]) for c in range(6) for t in range(3)]
    tapes = spark.createDataFrame([(c + 10 * k, 0, t, read, len(read)) for k in range(150) for c, t, read in one], "cell long, clone int, tape int, read array<string>, depth int")
    prefixes = tapes.select("cell", "clone", "tape", F.posexplode("read").alias("d", "_x"), "read").select("cell", "clone", "tape", (F.col("d") + 1).alias("d"), F.array_join(F.slice("read", F.lit(1), F.col("d") + 1), ">").alias("prefix"))
    sent, whole = [], relate.in_blocks
    monkeypatch.setattr(relate, "in_blocks", lambda features, keys, run, schema: sent.append(features.count()) or whole(features, keys, run, schema, 100))
    found = [(r.i, r.j, r.shared, r.joint) for r in relate.pairs(prefixes, tapes).collect()]
    read = {(c, t): x for c, t, x in one}
    depth = lambda i, j: sum(next((k for k, (a, b) in enumerate(zip(read[i, t], read[j, t])) if a != b), min(len(read[i, t]), len(read[j, t]))) for t in range(3))
    ids = [c + 10 * k for k in range(150) for c in range(6)]
    want = [(i, j, depth(i % 10, j % 10), 3) for i, j in itertools.combinations(sorted(ids), 2)]
    assert sent[0] <= 6 * 3 and sorted(found) == want


def test_cells_with_equal_entries_are_fitted_once(spark, monkeypatch):
    rng = random.Random(11)
    one = [[(t, int(rng.random() < 0.3 + 0.1 * t), rng.choice([0.5, 1.0])) for t in range(5)] for _ in range(8)]
    rows = [(c + 10 * k, 0, t, x, w) for k in range(40) for c, e in enumerate(one) for t, x, w in e]
    entries = lambda rows: spark.createDataFrame(rows, "cell long, clone int, tape int, missing int, w double")
    names, whole = {}, fit.written
    monkeypatch.setattr(fit, "written", lambda df, name: names.setdefault(name, whole(df, name)))
    got = {(r.cell, r.tape): r.p for r in fit.within(entries(rows), ["clone"], "w").collect()}
    assert names["entry-classes"].count() <= 8 and names["entry-classes"].agg(F.sum("m")).first()[0] == 320
    assert len(got) == len(rows) and all(got[c + 10 * k, t] == got[c, t] for k in range(40) for c in range(8) for t in range(5))
    # Copies change no margin, so the fit is that of one copy.
    monkeypatch.setattr(fit, "written", whole)
    single = {(r.cell, r.tape): r.p for r in fit.within(entries(rows[: 8 * 5]), ["clone"], "w").collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in single.items())


def test_witnesses_send_characters_once_for_each_part(spark):
    rng = np.random.default_rng(15)
    sets = {(k, i): sorted({int(x) for x in rng.integers(0, 60, 12)}) for k in (1, 2) for i in range(3, 40, 2)}
    characters = spark.createDataFrame([(k, i, c) for (k, i), c in sets.items()], "clone int, id int, cells array<long>")
    pairs = [(k, a, b) for (k, a) in sets for (m, b) in sets if k == m and a < b]
    edges = spark.createDataFrame(pairs, "clone int, a int, b int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for parts, most in ((1, 10**6), (3, 10**6), (1, 50)):
            out = compat.witnesses(edges, characters, parts, most)
            got = {(r.clone, r.a, r.b): (r.both, r.only_a, r.only_b) for r in out.collect()}
            x = {(k, a, b): (set(sets[k, a]), set(sets[k, b])) for k, a, b in pairs}
            assert got == {p: (sorted(s & t), sorted(s - t), sorted(t - s)) for p, (s, t) in x.items()}
        # No edge is shuffled with cells: edges are dealt by parts only.
        plan = compat.witnesses(edges, characters)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(clone" in plan and ", b#" not in "".join(p.split("hashpartitioning(")[1].split("]")[0] for p in plan.split("\n") if "hashpartitioning(" in p)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nulls_of_tests_are_summed_where_their_counts_lie(spark, sf_dir):
    """Rows of tests and permutations, which estimates of size take for those of clades, are neither joined nor broadcast."""
    from strandline.plans import catalogue, further  # noqa: F401

    plan = catalogue.QUERIES["q_combo_null"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    v = catalogue.Views(spark, sf_dir)
    counts = scan.clade_counts(v.prefixes, scan.with_rates(v.entries), 5, 7, 2)
    all_ = scan.statistics(scan.counted_combos(counts)).withColumn("soft", F.round("soft", 9))
    want = scan.permutation_accumulators(all_.where("perm = 0"), all_.where("perm > 0"), scan.COMBO, "soft")
    names = ["observed", "n_ge", "b", "max_null", "mean_null", "sd_null", "p", "margin"]
    got = lambda df: {tuple(r[c] for c in scan.COMBO): [r[c] for c in names] for r in df.collect()}
    want, found = got(want), got(scan.counted_accumulators(counts))
    assert found and found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_parts_of_several_blocks_are_sent_less(spark, monkeypatch):
    """Parts meet block by block in a task, so cells are sent less than once for each block; mates and sums are those of all pairs."""
    tapes, prefixes, own = relatives(spark, n=160)
    monkeypatch.setattr(relate.in_blocks, "__defaults__", (4,))
    near = {}
    mates = relate.nearest_mates(prefixes, tapes, 3)
    for r in mates.collect():
        near.setdefault(r.i, {})[r["rank"]] = r.j
    for i in range(160):
        rel = {j if a == i else a: s / t for (a, j), (s, t) in own.items() if i in (a, j)}
        assert near.get(i, {}) == {k + 1: j for k, j in enumerate(sorted(rel, key=lambda j: (-rel[j], j))[:3])}
    want = {}
    for (i, _), (s, t) in own.items():
        want[i % 2, s, t] = want.get((i % 2, s, t), 0) + 1
    assert {(x.clone, x.shared, x.joint): x.pairs for x in relate.products_by_relatedness(prefixes, tapes, None).collect()} == want
    features = spark.range(160).selectExpr("id AS cell", "0 AS clone")
    run = lambda a, b, same: {"tasks": np.zeros(1, dtype=int), "most": np.array([max(a.num_rows, b.num_rows)]), "pairs": np.array([a.num_rows * (a.num_rows - 1) // 2 if same else a.num_rows * b.num_rows])}
    merge = lambda rows: {"tasks": np.ones(1, dtype=int), "most": rows["most"].max(keepdims=True), "pairs": rows["pairs"].sum(keepdims=True)}
    met = relate.in_blocks(features, ["clone"], (run, merge), "tasks long, most long, pairs long").agg(F.sum("tasks"), F.max("most"), F.sum("pairs")).first()
    assert met[0] <= 4 * 5 // 2 and met[1] <= 4 and met[2] == 160 * 159 // 2
    sums = relate.products_by_relatedness(prefixes, tapes, None)
    assert "FlatMapCoGroupsInArrow" not in relate.audit(sums)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sent_to_their_cells_once(spark, sf_dir):
    """Sites, tapes and the join with cells rest on one exchange of the lines, even where no table is broadcast."""
    from strandline.sources import fixture

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reads.tapes(fixture.reads(spark, sf_dir), fixture.DESIGN)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert plan.count("Exchange hashpartitioning") == 6 and "l_extendedprice" not in plan


def test_cells_are_sent_once_for_several_permutations(spark, monkeypatch):
    entries = spark.range(90).selectExpr("id AS cell", "CAST(id % 2 AS int) AS clone", "explode(sequence(0, 9)) AS tape").selectExpr("*", "CAST(xxhash64(cell, tape) % 3 = 0 AS int) AS missing")
    one = scan._moved_bits(entries, list(range(10)), 7, 5)
    monkeypatch.setattr(scan, "TURNS", 2)
    several = scan._moved_bits(entries, list(range(10)), 7, 5)
    found = {r.cell: bytes(r.bits) for r in several.collect()}
    assert found == {r.cell: bytes(r.bits) for r in one.collect()} and {len(x) for x in found.values()} == {8 * 2}
    # Each permutation moves whole rows within a clone.
    for clone in (0, 1):
        rows = [found[c] for c in range(clone, 90, 2)]
        assert all(sorted(x[2 * p : 2 * p + 2] for x in rows) == sorted(x[:2] for x in rows) for p in range(8))
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
