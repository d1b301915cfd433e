"""Filter audit, whitening and personal data against brute force, with edge cases."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from strandline.llm import filter_audit, personal_data, queries, whitening
from strandline.llm.common import table

# Filter audit.


def audit_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marked = []
    for i, text, lang in docs:
        text = text or ""
        w = [x for x in re.split("[ \t\n\v\f\r]+", text) if x]
        fails = {c for c, bad in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text))) if bad}
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails.add("E")
        marked.append((i, lang or "", fails))
    out = []
    for part in {p for _, p, _ in marked}:
        own = [(i, f) for i, p, f in marked if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for i, f in own if c in f and not f & before]
                shapley[c] += len(removed)
                rows.append([part, "".join(order), step, sum(not f & (before | {c}) for _, f in own), len(removed), sum(c in f and bool(f & before) for _, f in own), sum(f == {c} for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("few, salt", [(1_000_000, 50_000), (0, 2)])
def test_audit(spark, monkeypatch, few, salt):
    """Copies within and across languages, repeated rows, nulls, empty and long texts, clashing names; keys broadcast, and joined with salts."""
    monkeypatch.setattr(filter_audit, "FEW_KEYS", few)
    monkeypatch.setattr(filter_audit, "SALT_ROWS", salt)
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 3)
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d#", "ep", *(f"w{i}" for i in range(300))]
    pool = [" ".join(rng.choices(words, k=n)) for n in (5, 90, 120, 130, 200)] + ["", None, " \t\n", "A" * 50_000, "ß É " * 60]
    docs = [(i if i % 11 else None, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [docs[5]] * 3 + [(3, pool[1], "en")] * 4
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, lang string, n long, part string")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, labels)


def test_audit_of_clashing_hashes(spark, monkeypatch):
    """Texts that share a hash are told apart by their text."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = [(i, f"text {i % 3}", "en") for i in range(12)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, [])


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# Whitening.


def whitened_by_hand(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(u.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()


def test_whitening_on_table(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").toPandas()
    x = np.floor(256 * np.stack(rows["embedding"]).astype(float)).astype(np.int64)
    n, deviation, whitened, explained = whitened_by_hand(x)
    out = queries.op12_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 4 * len(rows) and set(out["n"]) == {n}
    order = np.argsort(rows["vec_id"].to_numpy())
    got = out["whitened"].to_numpy().reshape(-1, 4)
    signs = np.sign((got * whitened[order]).sum(axis=0))
    assert np.abs(got * signs - whitened[order]).max() < 1e-9
    assert (out["deviation"].to_numpy().reshape(-1, 4)[:, 0] == deviation[order]).all()
    assert np.abs(out["explained"].to_numpy()[:4] / explained - 1).max() < 1e-9
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_whitening_edges(spark):
    """Nulls, non-finite entries, empty and odd lengths go; repeated rows and rows without ids stay; equal vectors have no component; large entries stay exact."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(30)]
    rows += [rows[2], rows[2], (None, rows[3][1]), (90, rows[4][1])]
    odd = [(91, None), (92, [1.0, None, 2.0]), (93, [1.0, math.inf, 2.0]), (94, [1.0, math.nan, 2.0]), (95, []), (96, [1.0]), (97, [1.0, 2.0])]
    make = lambda r: spark.createDataFrame([(*x, "z") for x in r], "vec_id long, embedding array<double>, x string")
    out = whitening.whiten(make(rows + odd)).toPandas()
    assert sorted(out["id"].dropna()) == sorted(i for i, _ in rows if i is not None) and out["id"].isna().sum() == 1
    n, deviation, _, _ = whitened_by_hand(np.floor(256 * np.array([v for _, v in rows])).astype(np.int64))
    assert set(out["n"]) == {n} == {30} and sorted(map(int, out["deviation"])) == sorted(map(int, deviation)) and set(map(len, out["whitened"])) == {3}
    flat = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["identity_error"]) for r in flat] == [(1, 0, [], 0.0)] * 2
    far = [[2.0**40, 1.0], [-(2.0**41), 3.0], [5.0, 2.0**39]]
    x = [[int(256 * c) for c in v] for v in far]
    s = [sum(c) for c in zip(*x)]
    want = sorted(sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x)
    assert sorted(int(r["deviation"]) for r in whitening.whiten(make(list(enumerate(far)))).collect()) == want
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make(odd[:5])).count() == 0


@pytest.mark.parametrize("values", [[3, 3, 3, 1, 1, 1], [1, 1 + 1e-9, 1 + 2e-9, 5, 2, 2 + 1e-12, 1e-3, 0], list(np.linspace(1, 1 + 1e-6, 64)), [1.0] * 20, [0, 0], [4.0]])
def test_refined_eigenvectors(values):
    """Clusters, equal and zero eigenvalues: orthonormal beyond doubles, with residuals to match."""
    wide = np.longdouble
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(values),) * 2))[0].astype(wide)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(q)) - 0.5 * q.T @ q)
    a = (q * np.array(values, wide)) @ q.T
    found, x = whitening.refined_eigenvectors((a + a.T) / 2)
    assert float(np.abs(x.T @ x - np.eye(len(q))).max()) < 1e-15 and float(np.abs(a @ x - x * found).max()) < 1e-15
    assert np.allclose(found.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-15)


# Personal data.


def plain_by_hand(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


DISGUISED = [
    ("email", "john [at] example [dot] com"), ("email", "john (at) mail3 (dot) example (dot) com"), ("email", "wing dot 27 at mail6 dot example dot com"), ("email", "wing.27 at mail6.example.com"),
    ("email", "wing.27＠mail6．example．com"), ("email", "аnna.55@mаil4.exаmple.com"), ("email", "john​.doe@exa​mple.com"), ("email", "john.doe @ example.com"), ("email", "re_55 arroba mail punto example punto com"),
    ("phone", "plus one four one five five five five oh one two three"), ("phone", "+1 (O17) 555-77l3"), ("phone", "＋１ （０１７） ５５５－７７１３"), ("phone", "(plus) 1 017 555 7713"),
    ("ip", "192 dot 168 dot 1 dot 17"), ("ip", "97[.]51[.]17[.]173"), ("ip", "nine seven dot five one dot one seven dot one seven three"), ("ip", "neun sieben Punkt fünf eins Punkt eins sieben Punkt eins"), ("ip", "٩٧.51.17.173"), ("ip", "one nine two dot one six eight dot one dot one"), ("phone", "plus one, four one five, five five five dash oh one two three"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "４１１１-１１１１-１１１１-１１１１"), ("card", "𝟜𝟙𝟙𝟙 𝟙𝟙𝟙𝟙 𝟙𝟙𝟙𝟙 𝟙𝟙𝟙𝟙"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
def test_disguised(kind, text):
    """The span of the disguise in the source, wherever it stands, also beside a plain identifier."""
    for before, after in (("", ""), ("Write to: ", ", soon."), ("é ß 漢 ", "; or a@b.c"), ("x " * 3000, "\nend")):
        spans = personal_data.find(before + text + after)
        assert (kind, len(before), len(before) + len(text), False) in spans
        assert [s for s in spans if not s[3]] == [(kind, len(before), len(before) + len(text), False)]


@pytest.mark.parametrize("text", ["look at this. The end", "meet at example.com soon", "call +1 (017) 555-7713 one two", "4111 1111 1111 1111 one two", "x at y dot z", "one of five (a) or (b) at two.", "5 apples @ 3.50 each", "a dot on the i. At best.net"])
def test_clean_text_stays(text):
    assert all(own for *_, own in personal_data.find(text)) and [s[:3] for s in personal_data.find(text)] == plain_by_hand(text)


def test_plain_spans():
    rng = random.Random(1)
    bits = ["1", "2", "5", "0", ".", "@", "a", "b-", "+", " ", "-", "(", "255", "4111", "é", "%"]
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 40)))
        assert [s[:3] for s in personal_data.find(text) if s[3]] == plain_by_hand(text)


def test_long_texts_take_linear_time():
    import time

    for text in ("a." * 100_000, "1." * 100_000, "a@" * 50_000, " at a" * 30_000, "one " * 50_000, "+1(" * 50_000, "1l" * 50_000, " dot a" * 30_000 + " at b dot com", "1" * 150_000, "٣" * 50_000):
        began = time.time()
        personal_data.find(text)
        assert time.time() - began < 5


def test_personal_data_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op13_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        plain = plain_by_hand(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in plain) for k in personal_data.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_personal_data_edges(spark):
    rows = [(1, None), (None, "a@b.c"), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (4, "x" * 300_000 + " a [at] b [dot] com")]
    out = personal_data.find_personal_data(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, spans int"))
    got = sorted(((r["id"], [tuple(s) for s in r["spans"]]) for r in out.collect()), key=str)
    mail = [("email", 0, 5, True)]
    assert got == sorted([(1, []), (None, mail), (2, []), (3, mail), (3, mail), (4, [("email", 300_001, 300_019, False)])], key=str)
    assert personal_data.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
