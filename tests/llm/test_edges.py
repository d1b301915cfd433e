"""Very long texts, repeated rows, nulls, clashing names and empty tables in the text operators and pipeline stages."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import kneser_ney, mixing, packing, quality_rules, simhash, token_counts
from strandline.llm.common import noted, shared_path
from strandline.llm.queries import tokenizer_path

#: Columns that operators use inside, too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, _rid int, _key string, _lang string, perplexity double, _size int, kept boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "c", 2, "k", "l", 0.5, 3, False) for i, t, lang, source in rows], SCHEMA)


def long_text(n=200_000, salt=""):
    return " ".join(f"w{i * i % 7919}{salt}" for i in range(n))


def rows():
    text = long_text()
    return [(1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, long_text(salt="x"), None, None), (4, None, "en", "b"), (5, "", "en", "b"), (None, "a short text", None, "b"), (None, None, None, None)]


def test_mixing_takes_long_and_empty_texts(spark):
    got = mixing.mix(table(spark, rows()), buckets=8)[0].collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 3, 200_000, 200_000, 200_000, 200_000]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(table(spark, rows()).limit(0))[0].count() == 0


def test_resample_keeps_columns_and_long_texts(spark):
    docs = table(spark, rows())
    out = mixing.resample(docs, buckets=8)
    assert out.schema == docs.schema and {r.n for r in out.select(F.length("text").alias("n")).collect()} <= {len(r[1]) if r[1] is not None else None for r in rows()}
    assert mixing.resample(docs.limit(0)).count() == 0
    # equal ids and sizes with other texts: reruns agree whatever the partitions
    twins = table(spark, [(7, f"a{i} b c", "en", "ab"[i % 2]) for i in range(60)])
    first, again = (sorted(r.text for r in mixing.resample(twins.repartition(n, F.col("text"))).collect()) for n in (2, 9))
    assert first == again


def test_rules_take_long_texts_and_clashing_names(spark):
    docs = table(spark, rows())
    got = {(r.doc_id, r.n_words) for r in quality_rules.quality_verdicts(docs).collect()}
    assert {(1, 200_000), (3, 200_000), (4, 0), (5, 0), (None, 3), (None, 0)} <= got
    assert quality_rules.keep_good(docs).schema == docs.schema and quality_rules.keep_good(docs.limit(0)).count() == 0


def test_near_duplicates_take_long_texts(spark):
    docs = table(spark, [*rows(), (9, long_text().replace("w49 ", "other ", 1), "en", "a")])
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    groups = simhash.near_duplicates(docs).collect()
    assert len(groups) == 9 and {r.component_id for r in groups if r.doc_id in (1, 2, 9)} == {1}


def test_classifier_takes_long_texts(spark):
    docs = table(spark, [*rows(), *((100 + i, f"the usual words of text {i} " * 5, "en", "a") for i in range(120))])
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.keep(docs, labels)
    assert kept.schema == docs.schema and {4, 5} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_tokens_of_a_long_text(spark):
    docs, path = table(spark, rows()), tokenizer_path("byte_bpe_50k.json")
    n = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).where("doc_id IN (1, 3, 4)").collect()}
    packed = packing.pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    of = {r.doc_id: r.n for r in packed}
    assert n[4] == 0 and of[4] == 1 and of[1] == n[1] + 1 and of[2] == 2 * (n[1] + 1) and of[3] == n[3] + 1


def test_paths_are_noted_where_they_are_made(spark):
    with noted() as outer:
        a = shared_path(spark, "a")
        with noted() as inner:
            b = shared_path(spark, "b")
        assert inner == [b] and outer == [a, b]
    shared_path(spark, "c")
    assert outer == [a, b]


@pytest.mark.parametrize("size", [4, 1200])
def test_components_of_hubs(spark, size, monkeypatch):
    from strandline.llm import components as module
    from strandline.llm.components import components

    monkeypatch.setattr(module, "FEW", 0)

    edges = [(0, i) for i in range(1, size)] + [(10_000 + i, 10_001 + i) for i in range(50)] + [(size - 1, 9_999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(size)} | {9_999: 0} | {10_000 + i: 10_000 for i in range(51)}
