"""SimHash groups and near-copy removal against brute force."""

import random

import numpy as np
import pytest
import xxhash

from strandline.llm import components, simhash

SCHEMA = "doc_id long, text string, lang string, _fp string, _key int"


def brute_fingerprint(text, size):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_groups(fps, distance):
    return union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])


def near_texts(rng, n, copies):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 2, 3, 40, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            again = list(base)
            again[rng.randrange(len(again))] = word()
            out.append(rng.choice([" ".join(again), " \t".join(base), " ".join(base).upper()]))
    return out


def test_groups(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "É b", "é b", "x y z"] + near_texts(rng, 40, 4)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x", "y", 1) for i, t in zip(ids, texts, strict=True)]
    rows += [(ids[5], texts[5], None, None, None), (ids[7], "something else entirely " * 9, "x", "y", 1), (None, "a", "x", "y", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    root = brute_groups(fps, 3)
    first = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    want = sorted(str((r[0], f"{f:016x}", first.get(g))) for r, f, g in zip(rows, fps, root, strict=True))
    assert sorted(str(tuple(r)) for r in got) == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0 and simhash.keep_first(empty).columns == empty.columns


def crowd(rng, n):
    """Fingerprints around a few centres, so that buckets are large."""
    out = set()
    centres = [rng.getrandbits(64) for _ in range(3)]
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


PLANS = [None, [(list(range(16 * q, 16 * q + 16)), 0) for q in range(4)], [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(16)), 1), (list(range(16, 32)), 1)]]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize(("cap", "small"), [(4096, 24), (4, 2), (16, 8)])
def test_links_connect_what_all_pairs_would(spark, plan, cap, small):
    fps = crowd(random.Random(cap), 250)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long"), 3, cap, small, plan).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 3 for r in found)
    mine, want = union_find(len(fps), [(at[r.a], at[r.b]) for r in found]), brute_groups(fps, 3)
    same = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == x) for x in set(roots)}
    assert same(mine) == same(want)


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    quarters = [list(range(16 * q, 16 * q + 16)) for q in range(4)]
    for n in (100, 10**6, 10**10):
        for distance in (0, 1, 3, 7):
            plan = simhash.allocate(n, rng.random((4, 17)) * n, quarters, distance)
            assert sum(t + 1 for _, t in plan) == distance + 1


def test_pair_counts_are_exact(spark):
    fps = crowd(random.Random(5), 120)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "_fp long")
    n, quarters = simhash.correlated_quarters(df)
    assert n == 120 and sorted(b for q in quarters for b in q) == list(range(64)) and all(len(q) == 16 for q in quarters)
    got = simhash.pair_counts(df, quarters)
    for q, bits in enumerate(quarters):
        mask = sum(1 << b for b in bits)
        want = np.bincount([((a ^ b) & mask).bit_count() for i, a in enumerate(fps) for b in fps[:i]], minlength=17)
        assert np.allclose(got[q], want)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    roots = union_find(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])
    least = {}
    for x in nodes:
        least[roots[at[x]]] = min(least.get(roots[at[x]], x), x)
    assert got == {x: least[roots[at[x]]] for x in nodes}


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_keep_first(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts, kind = [], []
    for g in range(30):
        base = [word() for _ in range(rng.randint(150, 300))]
        for c in range(rng.randint(1, 6)):
            again = list(base)
            if c:
                again[rng.randrange(len(again))] = word()
            texts.append(" ".join(again))
            kind.append(g)
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x", "y", 1) for i, t in zip(ids, texts, strict=True)]
    rows += [(rows[0][0], rows[0][1], "x", "y", 1), (None, "all alone " * 30, "x", "y", 1), (None, None, "x", "y", 1), (7, "", "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    want = {min(i for i, k in zip(ids, kind, strict=True) if k == g) for g in set(kind)}
    got = out.collect()
    assert {r.doc_id for r in got if r.doc_id not in (None, 7)} == want and len(got) == len(want) + 2
    assert sum(r.doc_id == 7 for r in got) == 1


def test_keep_first_of_many_exact_copies(spark):
    text = "one two three four five six seven eight"
    rows = [(500 - i, text.upper() if i % 2 else text.replace(" ", "\n"), "x", "y", i) for i in range(300)] + [(1, "something else " * 9, "x", "y", -1)]
    got = simhash.keep_first(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(tuple(r) for r in got) == sorted([rows[-1], rows[299]])


def test_keep_first_misses_no_copy_of_a_large_group(spark):
    # Copies that are like the original but not like each other, which share crowded shingles.
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(320)]
    texts = [" ".join(base)]
    while len(texts) < 260:
        again = list(base)
        for i in rng.sample(range(5, 315), 6):
            again[i] = f"new{rng.randrange(10**9)}"
        j = simhash.similarity(texts[0], " ".join(again), 5)
        if 0.82 <= j <= 0.88:
            texts.append(" ".join(again))
    rows = [(len(texts) - i, t, "x", "y", 1) for i, t in enumerate(texts)]
    # One more is like a single copy only, and one like none.
    far = texts[100].split()
    rows += [(1000, " ".join(far[:290]), "x", "y", 1), (1001, " ".join(far[:200]), "x", "y", 1)]
    sets = [shingle_set(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = union_find(len(rows), near)
    want = sorted(min(r[0] for r, x in zip(rows, roots, strict=True) if x == root) for root in set(roots))
    for small in (192, 8):
        got = simhash.keep_first(spark.createDataFrame(rows, SCHEMA), small=small).collect()
        assert sorted(r.doc_id for r in got) == want, small
    assert want[0] == 1 and len(want) == 2


def edited(rng, words, kind, part):
    """A near copy of ``words``: a stretch of ``part`` of it cut or added at an end, or single words replaced."""
    k = round(part * len(words))
    new = [f"new{rng.randrange(10**9)}" for _ in range(k)]
    if kind == "words":
        at = set(rng.sample(range(len(words)), max(1, k // 6)))
        return [f"new{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]
    return {"last cut": words[: len(words) - k], "first cut": words[k:], "appended": words + new, "put in front": new + words}[kind]


@pytest.mark.parametrize("kind", ["last cut", "first cut", "appended", "put in front", "words"])
def test_keep_first_finds_copies_by_any_edit(spark, kind):
    rng = random.Random(kind)
    rows = []
    for g in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        part = rng.uniform(0.08, 0.18)
        rows += [(2 * g, " ".join(words), "x", "y", 1), (2 * g + 1, " ".join(edited(rng, words, kind, part)), "x", "y", 1)]
    sets = [shingle_set(r[1]) for r in rows]
    near = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert sum(near) > 40
    want = [r[0] for i, r in enumerate(rows) if i % 2 == 0 or not near[i // 2]]
    assert sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_crowded_texts_that_are_not_similar_make_no_rows_of_pairs(spark, monkeypatch):
    # All share crowded shingles, early enough in their prefixes, but each has three words of its own.
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(90):
        again = list(base)
        for lo in (6, 56, 106):
            again[rng.randrange(lo, lo + 38)] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(again))
    texts += [t.replace(t.split()[0], f"new{i}") for i, t in enumerate(texts[:12])]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = union_find(len(sets), near)
    compared, verify = [], simhash.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    got = simhash.keep_first(spark.createDataFrame(rows, SCHEMA), small=8, distance=0)
    assert sorted(r.doc_id for r in got.collect()) == sorted({min(i for i, x in enumerate(roots) if x == root) for root in roots})
    assert 50 < len(set(roots)) < len(texts)
    assert compared[-1] <= len(texts)


@pytest.mark.parametrize("cut", [1, 3])
def test_block_links_connect_what_all_similar_pairs_would(spark, cut):
    rng = np.random.default_rng(cut)
    sets = [np.sort(rng.choice(60, rng.integers(28, 40), replace=False)).astype(np.uint64) for _ in range(40)]
    sets += [np.delete(x, rng.integers(len(x))) for x in sets[:25]] + [np.delete(x, [0, 3]) for x in sets[10:30]]
    root = [i if i % 7 else 0 for i in range(len(sets))]
    df = spark.createDataFrame([(s, i, root[i], i % cut, cut, bytearray(simhash.pack_set(x))) for s in (5, 6) for i, x in enumerate(sets)], "s long, _rid long, root long, part int, parts int, set binary")
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    known = [(i, r) for i, r in enumerate(root)]
    got = [(r.a, r.b) for r in simhash._block_links(df, 0.8, columns=16).collect()]
    assert {tuple(sorted(p, reverse=True)) for p in got} <= set(near)
    groups = lambda pairs: {frozenset(i for i, r in enumerate(roots) if r == x) for roots in [union_find(len(sets), pairs)] for x in set(roots)}
    assert groups(known + got) == groups(known + near) != groups(known)
