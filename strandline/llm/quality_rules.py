"""Quality rules with thresholds from mergeable quantile sketches.

Each text is measured by integer metrics. A sketch is a histogram over log-linear
integer bins (exact below 128, then seven significant bits, so a quantile is at most
1/64 too low); two sketches merge by adding counts, which a grouped sum does with a
partial sum on each side of the shuffle. The sketch of a language is the merge of its
sources' sketches, and that of the table the merge of the languages'.

From the sketch of a document's language and source come Tukey fences; a group with
fewer than ``min_docs`` documents takes those of its language, or else of the table.
Only built-in functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import SEPARATOR_CHARS, key_of, let, materialise, protect, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Metric: its value in integers from the counts, and the least distance of a fence from its quartile.
METRICS = {
    "word_length": ("100 * word_chars div n_words", 300),
    "symbols": ("1000 * n_symbols div n_words", 100),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 500),
    "repeats": ("1000 * n_repeat_words div n_words", 500),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", 400),
}
#: Metrics that are also fenced from below.
TWO_SIDED = ("word_length",)


def _repeat_words(w: Column) -> Column:
    """Words inside a 3-word window that the text has more than once."""

    def covered(starts: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, none, step, lambda a: a["n"])

    def heavy(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        return let(ordered, lambda s: covered(starts(s)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(heavy(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted)


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add the column ``counts``, a struct of long counts of each whole text (null: empty); a column with that name is replaced."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(F.col(text_column)), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.withColumns({"_words": by_words, "_lines": by_lines})
    counts = {
        "n_words": F.col("_words.n_words"),
        "word_chars": F.length(F.translate(text, SEPARATOR_CHARS, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.col("_lines.n_dup_lines"),
        "n_repeat_words": F.col("_words.n_repeat_words"),
        "n_lines": F.col("_lines.n_lines"),
        "n_capitals": without(UPPER),
    }
    return out.withColumn("counts", F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))).drop("_words", "_lines")


def metric(name: str) -> Column:
    """An integer metric of a text with words, from its ``counts``."""
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"counts.\1", METRICS[name][0]))


def bin_of(value: Column) -> Column:
    """Lower end of the value's bin: seven significant bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 7).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, bin, n: the histogram of each metric in each group, over texts with words."""
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bin_of(metric(m)).alias("bin")) for m in METRICS))).alias("x")
    rows = measured.where("counts.n_words > 0").select(*keys, one)
    return rows.groupBy(*keys, "x.metric", "x.bin").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """keys, metric, n, and the quartiles q25 and q75: the first bin up to which a quarter or three quarters lie."""
    group = W.partitionBy(*keys, "metric")
    running = sketch.withColumns({"_upto": F.sum("n").over(group.orderBy("bin")), "_all": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(4 * F.col("_upto") >= q * F.col("_all"), F.col("bin")))
    return running.groupBy(*keys, "metric").agg(F.max("_all").alias(f"n_{suffix}"), at(1).alias(f"q25_{suffix}"), at(3).alias(f"q75_{suffix}"))


def fences(sketch: DataFrame, k: int = 6, min_docs: int = 40) -> DataFrame:
    """_lang, _source, and for each metric its fences ``<metric>_low`` and ``<metric>_high``."""
    by_lang, by_all = merge(sketch, ["_lang"]), merge(sketch, [])
    q = quartiles(sketch, ["_lang", "_source"], "s").join(quartiles(by_lang, ["_lang"], "l"), ["_lang", "metric"]).join(quartiles(by_all, [], "a"), ["metric"])
    pick = lambda c: F.when(F.col("n_s") >= min_docs, F.col(f"{c}_s")).when(F.col("n_l") >= min_docs, F.col(f"{c}_l")).otherwise(F.col(f"{c}_a"))
    q = q.select("_lang", "_source", "metric", pick("q25").alias("q25"), pick("q75").alias("q75"))
    spread = F.col("q75") - F.col("q25")
    cells = []
    for m, (_, least) in METRICS.items():
        slack = F.greatest(k * spread, F.lit(least))
        cells.append(F.max(F.when(F.col("metric") == m, F.col("q75") + slack)).alias(f"{m}_high"))
        cells.append(F.max(F.when(F.col("metric") == m, F.col("q25") - slack if m in TWO_SIDED else F.lit(None).cast("long"))).alias(f"{m}_low"))
    return q.groupBy("_lang", "_source").agg(*cells)


def judge(measured: DataFrame, k: int = 6, min_docs: int = 40, min_words: int = 50, max_repeat_percent: int = 50, max_groups: int = 100_000) -> DataFrame:
    """Add ``base_failed``, ``failed`` (the metrics beyond their fences) and ``kept`` to rows with ``counts``, lang and source.

    The fences have one row for each language and source. Up to ``max_groups`` such rows
    (at most about 150 bytes each) are broadcast, so that texts stay where they are; with
    more the join shuffles.
    """
    keyed = measured.withColumns({"_lang": key_of(F.col("lang")), "_source": key_of(F.col("source"))})
    limits = materialise(fences(sketches(keyed, ["_lang", "_source"]), k, min_docs), "fences")
    small = limits.limit(max_groups + 1).count() <= max_groups
    joined = keyed.join(F.broadcast(limits) if small else limits, ["_lang", "_source"], "left")
    n, repeat = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    failed = [F.when(F.coalesce((metric(m) > F.col(f"{m}_high")) | F.coalesce(metric(m) < F.col(f"{m}_low"), F.lit(False)), F.lit(False)), F.lit(m)) for m in METRICS]
    out = joined.withColumn("base_failed", (n < min_words) | (100 * repeat > max_repeat_percent * n))
    out = out.withColumn("failed", F.when(n > 0, F.array_compact(F.array(*failed))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.drop("_lang", "_source", *(f"{m}_{end}" for m in METRICS for end in ("low", "high")))


def quality_verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, failed, kept.

    A null text is an empty one: no words, base_failed. Null languages and sources form
    groups of their own. Repeated rows are judged each; other columns are ignored; texts of
    any length are counted whole; an empty table gives an empty result.
    """
    narrow = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    judged = judge(materialise(narrow, "quality"), **options)
    return judged.select("doc_id", "counts.*", "base_failed", "failed", "kept")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``, whatever their names."""
    own, restore = protect(docs, ["doc_id", "text", "lang", "source"])
    return restore(judge(materialise(with_counts(own), "quality"), **options).where("kept"))
