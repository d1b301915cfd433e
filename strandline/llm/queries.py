"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import filter_audit, kneser_ney, mixing, neighbours, packing, personal_data, quality_rules, simhash, token_counts, token_files, url_filters, warc, whitening
from strandline.llm.common import shared_path, table

#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; STRANDLINE_TOKENIZERS names another folder."""
    if folder := os.environ.get("STRANDLINE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", F.col("good").alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return token_files.read_tokens(folder, manifest)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = rows.select("id", "n", "deviation", "identity_error", each)
    return out.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "c.whitened", "c.explained", "identity_error")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter(plain, lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = {f"n_{kind}": F.size(of_kind(kind)).cast("long") for kind in personal_data.KINDS}
    return found.select(F.col("id").alias("doc_id"), *(c.alias(name) for name, c in counts.items()), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_classifier": op5_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_neighbours": op7_neighbours,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_url_filters": op10_url_filters,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_personal_data": op13_personal_data,
}
ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
        l AS (SELECT html, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY html)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < largest THEN largest END AS refers_to
        FROM p LEFT JOIN l USING (html)""",
    "op6_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('s' || lang, 'n') AS l, coalesce('s' || source, 'n') AS s FROM documents),
        w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
        g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
        r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1) GROUP BY rid),
        x AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS x FROM d),
        c AS (SELECT rid, doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines,
                     CAST(len(x) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
              FROM d JOIN w USING (rid) JOIN x USING (rid) LEFT JOIN r USING (rid)),
        m AS (SELECT rid, l, s, unnest([
                {'m': 1, 'v': 100 * word_chars // n_words}, {'m': 2, 'v': 1000 * n_symbols // n_words}, {'m': 3, 'v': 1000 * n_dup_lines // greatest(n_lines, 1)},
                {'m': 4, 'v': 1000 * n_repeat_words // n_words}, {'m': 5, 'v': 1000 * n_capitals // greatest(word_chars, 1)}], recursive := true) FROM c WHERE n_words > 0),
        b AS (SELECT rid, l, s, m, v, (v >> k) << k AS b FROM (SELECT *, CAST(greatest(0, length(bin(v)) - 7) AS BIGINT) AS k FROM m)),
        qs AS (SELECT l, s, m, count(*) AS n, list_sort(list(b)) AS b FROM b GROUP BY ALL), ql AS (SELECT l, m, count(*) AS n, list_sort(list(b)) AS b FROM b GROUP BY ALL), qa AS (SELECT m, count(*) AS n, list_sort(list(b)) AS b FROM b GROUP BY ALL),
        q AS (SELECT qs.l, qs.s, m, CASE WHEN qs.n >= 40 THEN qs.b WHEN ql.n >= 40 THEN ql.b ELSE qa.b END AS b FROM qs JOIN ql USING (l, m) JOIN qa USING (m)),
        f AS (SELECT l, s, m, q75 + greatest(6 * (q75 - q25), least) AS high, CASE WHEN m = 1 THEN q25 - greatest(6 * (q75 - q25), least) END AS low
              FROM (SELECT l, s, m, b[CAST(ceil(len(b) / 4) AS BIGINT)] AS q25, b[CAST(ceil(3 * len(b) / 4) AS BIGINT)] AS q75, [300, 100, 500, 500, 400][m] AS least FROM q)),
        v AS (SELECT rid, bool_or(v > high OR coalesce(v < low, false)) AS failed FROM b JOIN f USING (l, s, m) GROUP BY rid)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(failed, false) AS kept
        FROM c LEFT JOIN v USING (rid)""",
    "op10_url_filters": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (SELECT page_id, max_by({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) AS best
              FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS bits
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, bits, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before FROM o CROSS JOIN range(1, 6) r(step)),
        r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (bits & bit = 0 AND bits & before = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before = 0), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (bits = bit), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before = 0 AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (bits & bit > 0 AND bits & before = 0 AND toxic), 0) AS BIGINT) AS toxic_lost
              FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
