"""Quality rules, URL filters and mixing against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, quality_rules, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_words long, _lang int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    w = words(text)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for v in where.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "a\nb\na\na", "é è # $\u00a0x", "one two three four " * 40, "a b c d a b c e a b", "\x0ba\x0cb\r\nc\r\nc", "a b a b a"]


def test_counts(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n#"]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_verdicts(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert got[i][:5] == want, t
        assert got[i][5] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i][5] and got[i][6])


def test_bins(spark):
    rows = spark.range(3000).withColumn("b", quality_rules.bin_of(F.col("id"))).collect()
    for r in rows:
        drop = max(0, r.id.bit_length() - 7)
        assert r.b == r.id >> drop << drop


def test_quartiles_are_those_of_merged_sketches(spark):
    rng = random.Random(2)
    rows = [("en", rng.choice("xy"), rng.randint(0, 5000)) for _ in range(500)]
    bins = spark.createDataFrame(rows, "_lang string, _source string, v long").select("_lang", "_source", F.lit("m").alias("metric"), quality_rules.bin_of(F.col("v")).alias("bin")).groupBy("_lang", "_source", "metric", "bin").agg(F.count("*").alias("n"))
    got = quality_rules.quartiles(quality_rules.merge(bins, ["_lang"]), ["_lang"], "l").first()
    values = sorted(v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7) for _, _, v in rows)
    assert (got.n_l, got.q25_l, got.q75_l) == (500, values[124], values[374])


def test_fences_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(200)), rng.choice(["en", None]), rng.choice(["s", "t", None]), 0, 0) for i in range(200)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(200)), "en", "s", 0, 0) for i in range(10)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(10))
    docs = spark.createDataFrame(clean + junk, DOCS)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 200


def test_rules_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality_rules.quality_verdicts(docs).count() == 0 and quality_rules.keep_good(docs).count() == 0


# Mixing.


def brute_targets(size):
    names = sorted((n for n in size if n is not None), key=lambda x: x.encode()) + [n for n in size if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, out, free = 1.5 * sum(size.values()), {}, set(names)
    while free:
        left, w = total - sum(out.values()), sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / w > 2 * size[n]]
        if not over:
            out |= {n: left * weight[n] / w for n in free}
            break
        for n in over:
            out[n] = 2.0 * size[n]
            free.discard(n)
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_mix(spark, block):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 7, 30, 300]))), "en", rng.choice(["a", "a", "a", "B", "é", None]), 9, 9) for i in range(150)]
    rows += [(7, None, None, "a", 0, 0), (7, "x y", None, None, 0, 0), (7, "x y", None, None, 0, 0), (None, "p q r", None, "zz", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, block_words=block, shard_slots=8, buckets=16)[0].collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    want = brute_targets(dict(size))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(docs.repartition(7), block_words=block, shard_slots=8, buckets=16)[0]
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_shards_draw_from_all_sources(spark):
    rows = [(i, "w " * 500, "en", "abc"[i % 3], 0, 0) for i in range(60)]
    documents, slots = mixing.mix(spark.createDataFrame(rows, DOCS), block_words=16, shard_slots=128)
    per = slots.groupBy("shard").agg(F.countDistinct("_source").alias("s"), F.count("*").alias("n")).collect()
    assert len(per) > 5 and all(r.s == 3 for r in per if r.n > 60)
    # a pass over a source takes each block once
    doubled = slots.groupBy("_source", "block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert doubled <= 2


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 5000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"), 3).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != sorted(got)


def test_mix_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS))[0].count() == 0
    one = mixing.mix(spark.createDataFrame([(1, None, None, None, 0, 0)], DOCS))[0].collect()
    assert [(r.doc_id, r["size"], r.taken, r.target) for r in one] == [(1, 0, 0, 0.0)]


def test_resample(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([5, 50, 200]), "en", rng.choice("aab"), 0, 0) for i in range(200)] + [(3, "w w", None, "a", 0, 0)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.resample(docs, block_words=16)
    assert out.columns == docs.columns
    size, got = Counter(), Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    copies = Counter()
    for r in out.collect():
        got[r.source] += len(words(r.text))
        copies[r.doc_id] += 1
    for s, t in brute_targets(dict(size)).items():
        assert abs(got[s] - t) <= 200
    assert max(copies[i] for i in range(200) if i != 3) <= 2


# URLs.

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("example.com", "", "block"), ("a.example.com", "/en/77", "block")]


def brute_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("lane_rows", [2, 100_000])
def test_urls(spark, lane_rows):
    rng = random.Random(6)
    hosts = ["example.com", "WWW.Example.com", "a.example.com", "b.a.example.com", "com", "xcom", "example.net", "q.example.net", "net", "org", "x.org", "example.com.", "", "É.com", "example.com:80"]
    paths = ["", "/", "/en/", "/en/7", "/en/77x", "/EN/7", "/de/8", "/de/9", "/es/", "/es", "/en/?q=/en/7", "/en#/x", "?x=/en/", "/en/7\nz"]
    urls = [rng.choice(["http", "https", ""]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(400)]
    urls += [None, "", "example.com/en/", "http:/example.com/en/", "a://b://example.com/en/", "://", "x://example.com"]
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(urls)] + [(0, urls[0], "h", "r", 2), (None, "http://x.com/en/", "", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, _lane int")
    got = url_filters.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), lane_rows=lane_rows).collect()
    want = sorted(str((i, *brute_judge(u))) for i, u, *_ in rows)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_urls_without_rows_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.com/en/")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge_urls(pages, rules).collect()] == [(1, "x.com", "/en/", None, "allow")]
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_rules_go_only_where_their_hosts_are(spark):
    rules = spark.createDataFrame([(f"h{i}.example{i % 500}.com", "", "block") for i in range(20_000)] + [("com", "/x", "block")], "host string, path string, verdict string")
    long = "http://h7.example7.com/" + "a" * 200_000
    pages = spark.createDataFrame([(1, long), (2, "http://h7.example8.com/x"), (3, "http://a.h8.example8.com/"), (4, "http://org/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {1: ("h7.example7.com", "block", 200_001), 2: ("com/x", "block", 2), 3: ("h8.example8.com", "block", 1), 4: (None, "allow", 2)}
