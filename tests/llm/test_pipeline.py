"""The pipeline's stages on a whole table, each against brute force on its own input."""

from collections import Counter

import pytest
from test_models import brute_verdicts
from test_text_rules import brute_targets, words

import corpus_pipeline
from strandline.llm import kneser_ney
from strandline.llm.queries import ORACLE, tokenizer_path

duckdb = pytest.importorskip("duckdb")
tokenizers = pytest.importorskip("tokenizers")


def shingles(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute_first(docs):
    """The least id of each group that a similarity of 0.8 connects; all pairs are compared."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (name, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), name), name)
    return set(least.values())


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    kept = con.execute(f"SELECT doc_id FROM ({ORACLE['op6_quality_rules']}) WHERE kept").fetchall()
    assert good.columns == docs.columns and set(rows(good)) == {r[0] for r in kept}

    clean = stages["quality_classifier"](spark, good, sf_dir).cache()
    folds = {r.doc_id: r.fold for r in kneser_ney.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    verdict = brute_verdicts([(r.doc_id, r.text or "", r.lang) for r in rows(good).values()], folds)
    assert set(rows(clean)) == {i for i, ok in verdict.items() if ok}

    first = stages["near_dedup"](spark, clean, sf_dir).cache()
    assert set(rows(first)) == brute_first([(r.doc_id, r.text) for r in rows(clean).values()])

    mixed = stages["mixing"](spark, first, sf_dir).cache()
    size, got, longest = Counter(), Counter(), 0
    for r in rows(first).values():
        size[r.source] += len(words(r.text))
        longest = max(longest, len(words(r.text)))
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
    assert all(abs(got[s] - t) <= longest for s, t in brute_targets(dict(size)).items())

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    library = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in mixed.collect()]
    ids = sum(len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False))
    assert sum(r.length for r in packed) == ids and len([r for r in packed if r.start == 0]) == len(texts)
