"""The Kneser-Ney classifier, nearest neighbours, and the pipeline."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import kneser_ney, neighbours

DOCS = "doc_id long, text string, lang string, perplexity string, _key int"


def sentence(rng, n, letters="abcdefgh"):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 3, 4])))
    return " ".join(word() for _ in range(n))


SYMBOLS = kneser_ney.symbol_table("abcdefghé")


def symbols(text):
    return SYMBOLS[kneser_ney.code_points([text], 0)[0]].tolist()


def brute_model(texts, order):
    """Probability of a symbol after a context, straight from the definition."""
    counts = [None, *({} for _ in range(order))]
    top = Counter()
    for t in texts:
        s = [0] * (order - 1) + symbols(t)
        top.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts[order] = top
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, weight = {}, {}, {}
    for k in range(1, order + 1):
        have = Counter(counts[k].values())
        d = kneser_ney.discounts(have[1], have[2], have[3], have[4])
        cut[k] = lambda n, d=d: min(d[min(n, 3) - 1], n)
        total[k], weight[k] = defaultdict(int), defaultdict(float)
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            weight[k][g[:-1]] += cut[k](n)

    def p(context, symbol):
        if not context and symbol is None:
            return 1 / 64
        k = len(context) + 1
        low = p(context[1:], symbol) if context else 1 / 64
        if context not in total[k]:
            return low
        n = counts[k].get((*context, symbol), 0)
        return ((n - cut[k](n) if n else 0) + weight[k][context] * low) / total[k][context]

    return p


def test_probabilities(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 30) + rng.choice(".!#É") for _ in range(20)]
    order = 3
    counts = kneser_ney.count_ngrams(spark.createDataFrame([("x", t) for t in texts], "_lang string, text string"), order, {"x": "abcdefghé"})
    probs = kneser_ney.probabilities(counts, order)
    p = brute_model(texts, order)
    for r in probs.collect():
        gram = tuple(r.code // 64**i % 64 for i in range(r.k - 1, -1, -1))
        assert r.p == pytest.approx(p(gram[:-1], gram[-1]))
    context = tuple(symbols("ab"))
    assert sum(p(context, s) for s in range(64)) == pytest.approx(1)
    tables = {}
    for k in range(1, order + 1):
        rows = [r for r in probs.collect() if r.k == k]
        tables[k, "p"] = (np.array([r.code for r in rows]), np.array([r.p for r in rows]))
        g = {r.code // 64: r.g for r in rows}
        tables[k, "g"] = (np.array(list(g)), np.array(list(g.values())))
    model = kneser_ney.Model(tables, order, "abcdefghé")
    for t in [*texts[:3], "abc zz qq 123", "é", "\0a"]:
        s = [0] * (order - 1) + symbols(t.replace("\0", "\ufffd"))
        logs = [math.log(p(tuple(s[i - order + 1 : i]), s[i])) for i in range(order - 1, len(s))]
        assert model.perplexities([t])[0] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
    assert np.isnan(model.perplexities(["", "a"])).tolist() == [True, False]


def test_model_takes_little_more_than_its_table():
    rng = np.random.default_rng(4)
    order, tables = 4, {}
    for k in range(1, order + 1):
        codes = np.unique(rng.integers(1, 34, (2000, k)) @ 64 ** np.arange(k - 1, -1, -1))
        tables[k, "p"] = (codes, rng.random(len(codes)))
        contexts = np.unique(codes // 64)
        tables[k, "g"] = (contexts, rng.random(len(contexts)))
    tracemalloc.start()
    model = kneser_ney.Model(tables, order, "abcdefghijklmnopqrstuvwxyzé")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.log.nbytes == 4 * 35**order and peak < 1.5 * model.log.nbytes + 8e6
    p, g = (tables[order, c] for c in "pg")
    at = model._recode(p[0], order)
    assert np.array_equal(model.log[at], np.log(p[1]).astype(np.float32))
    # An n-gram without a row has the shorter one's probability, times the weight of its context.
    shorter = model._recode(tables[3, "p"][0], 3)
    for context, weight in zip(g[0][:20], g[1][:20], strict=True):
        own = model._recode(np.array([context]), 3)[0] * 35 + shorter % 35
        known = {c % 35**3: v for c, v in zip(shorter, tables[3, "p"][1], strict=True)}
        for a in own:
            if a not in at and a % 35**3 in known:
                assert model.log[a] == np.float32(np.log(weight * known[a % 35**3]))


def test_pieces_of_a_batch_are_small():
    texts = ["ab c", None, "", "é ü" * 5, "x" * 40, "y"]
    batch = pa.record_batch({"_lang": pa.array(["sx", "n", "sx", "sx", "n", "sx"]), "text": pa.array(texts)})
    for most in (1, 8, 1000):
        found = list(kneser_ney._by_language(batch, most))
        assert sorted((i, t) for _, rows, part in found for i, t in zip(rows.tolist(), part, strict=True)) == [(i, t or "") for i, t in enumerate(texts)]
        assert all(len(part) == 1 or sum(len(t.encode()) + 1 for t in part[:-1]) < most for _, _, part in found)


def corpus(rng):
    good = [(i, sentence(rng, 60), rng.choice(["en", None, "rare"] if i < 10 else ["en", None]), "p", 1) for i in range(400)]
    bad = [(1000 + i, sentence(rng, 60).upper().replace(" ", "!! "), "en", "p", 1) for i in range(20)]
    return good + bad


def test_classifier(spark):
    rows = corpus(random.Random(2)) + [(5000, None, "en", "p", 1), (5001, "", None, "p", 1), (None, sentence(random.Random(3), 50), "xx", "p", 1)]
    labels = spark.createDataFrame([(i, 1, 0, "z") for i in range(200)] + [(3, 1, 0, "z"), (None, 1, 0, "z"), (1000, 0, 0, "z"), (9, 1, None, "z"), (10, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    docs = spark.createDataFrame(rows, DOCS)
    for broadcast in (10**6, 10):
        kept = kneser_ney.keep(docs, labels, broadcast_ids=broadcast)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert len([i for i in range(400) if i in ids]) >= 398 and {None, 5000, 5001} <= ids and not any(1000 + i in ids for i in range(20))


def brute_verdicts(rows, labelled, order=4, quantile=0.99, slack=1.5, least=20):
    """doc_id and verdict of each row, from brute-force models of the training fold."""
    fold = lambda i: i in labelled and labelled[i]
    train, held = ([r for r in rows if fold(r[0]) is not False and fold(r[0]) == k] for k in (0, 1))
    letters = lambda texts: "".join(c for c, _ in sorted(Counter(c for t in texts for c in t if c.isalpha() and not c.isupper()).items(), key=lambda x: (-x[1], x[0]))[:56])

    def model(own):
        texts = [r[1] for r in own]
        table = kneser_ney.symbol_table(letters(texts))
        of = lambda t: table[kneser_ney.code_points([t], 0)[0]].tolist()
        global symbols
        before, symbols = symbols, of
        p = brute_model(texts, order)
        symbols = before

        def perplexity(text):
            s = [0] * (order - 1) + of(text)
            logs = [math.log(p(tuple(s[i - order + 1 : i]), s[i])) for i in range(order - 1, len(s))]
            return math.exp(-sum(logs) / len(logs)) if logs else None

        return perplexity

    count = lambda rs: Counter(r[2] for r in rs)
    own = [k for k in count(train) if min(count(train)[k], count(held)[k]) >= least]
    models = {k: model([r for r in train if r[2] == k]) for k in own} | {"*": model(train)}
    key = lambda r: r[2] if r[2] in own else "*"
    scores = [(key(r), models[key(r)](r[1])) for r in held]
    limit = {k: slack * sorted(x for j, x in scores if k in (j, "*"))[max(0, math.ceil(quantile * sum(k in (j, "*") for j, _ in scores)) - 1)] for k in models}
    return {r[0]: (x := models[key(r)](r[1])) is None or x <= limit[key(r)] for r in rows}


def test_verdicts_are_those_of_brute_force_in_any_script(spark):
    """Languages in Latin, Cyrillic and Chinese script, and one with few documents; junk in letters of the same script."""
    rng = random.Random(8)
    scripts = {"en": "abcdefgh", "ru": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437", "zh": "\u7684\u4e00\u662f\u4e0d\u4e86\u4eba\u6211\u5728", "few": "xyzw"}

    def text(lang, junk):
        letters = scripts[lang]
        order_ = {c: letters[(i + 1) % 8 if len(letters) > 4 else (i + 1) % 4] for i, c in enumerate(letters)}
        out, c = [], letters[0]
        for _ in range(80):
            c = rng.choice(letters) if junk or rng.random() < 0.15 else order_[c]
            out.append(c + (" " if rng.random() < 0.2 else ""))
        return "".join(out)

    rows = [(i, text(lang, False), lang) for j, (lang, n) in enumerate((("en", 120), ("ru", 120), ("zh", 120), ("few", 12))) for i in range(1000 * j, 1000 * j + n)]
    rows += [(10_000 + 100 * j + i, text(lang, True), lang) for j, lang in enumerate(("en", "ru", "zh")) for i in range(10)] + [(20_000, "", "ru")]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 10_000], "doc_id long, quality int, toxic int")
    folds = {r.doc_id: r.fold for r in kneser_ney.trusted_ids(labels).collect()}
    want = brute_verdicts(rows, folds)
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, perplexity string, _lang double")
    judged = kneser_ney.classify(docs, labels)
    assert judged.columns == ["doc_id", "text", "lang", "_lang", "perplexity", "threshold", "good"]
    got = {r.doc_id: r.good for r in judged.collect()}
    assert got == want
    assert not any(got[10_000 + 100 * j + i] for j in range(3) for i in range(10)) and sum(got.values()) > 350


def test_classifier_without_labels_or_documents(spark):
    docs = spark.createDataFrame(corpus(random.Random(4)), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser_ney.keep(docs, none).count() == docs.count()
    assert kneser_ney.keep(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, vec int"


def exact(rows, every, k):
    by = [(i, np.array(v, np.float64)) for i, v, *_ in rows]
    out = set()
    for q, x in by:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in by if i != q)[:k]
            out |= {(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)}
    return out


def test_neighbours_of_a_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(size=8)).tolist(), 1, "x", 2) for i in range(90)]
    rows += [(100 + i, rows[0][1], 1, "x", 2) for i in range(30)]
    odd = [(300, None, 1, "x", 2), (310, [0.0] * 8, 1, "x", 2), (320, [float("nan")] * 8, 1, "x", 2), (330, [float("inf")] + [1.0] * 7, 1, "x", 2), (340, [1.0] * 7, 1, "x", 2), (350, [1.0] * 7 + [None], 1, "x", 2), (None, [1.0] * 8, 1, "x", 2), (360, [], 1, "x", 2)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows + odd, VECTORS), 10, 10)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()} == exact(rows, 10, 10)


def test_recall_with_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=16) if i % 3 else np.ones(16)).tolist(), 1, "x", 2) for i in range(3000)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS), 50, 10, rerank=60, block_rows=100, block_queries=7)
    mine, want = {(r.query_id, r.vec_id) for r in got.collect()}, {(q, i) for q, _, i, _ in exact(rows, 50, 10)}
    assert len(mine) == len(want) and len(mine & want) / len(want) > 0.95


def test_few_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", 2)], VECTORS)
    assert neighbours.nearest_neighbours(one, 10).count() == 0
    assert neighbours.nearest_neighbours(one.limit(0), 10).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", 2), (20, [1.0, 2.0], 1, "x", 2)], VECTORS)
    assert sorted(map(tuple, neighbours.nearest_neighbours(two, 10).collect())) == [(0, 1, 20, 0.0), (20, 1, 0, 0.0)]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns
        seen.append((name, now.count()))
    n = [c for _, c in seen]
    assert docs.count() >= n[0] >= n[1] >= n[2] > 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.where("quality = 0").join(now, "doc_id", "left_semi").count()
    assert bad <= 1
    assert corpus_pipeline.run(spark, sf_dir).agg(F.countDistinct("doc_id")).first()[0] == now.select("doc_id").distinct().count()
