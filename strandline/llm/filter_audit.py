"""Audit of how filters interact: what every filter removes in every order of the filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import let, materialise, words

#: Filters by letter; bit i of a document's failures is the i-th of them. The last one marks copies.
LETTERS = "ABCDE"
COPY = 1 << (len(LETTERS) - 1)

#: Up to this many keys of copied texts are broadcast (16 bytes each); beyond it only keys of over a 2000th of all rows are, of which there are fewer than 2000.
FEW_KEYS, HOT_SHARE = 1_000_000, 2000
#: Rows of one key that a salt takes.
SALT_ROWS = 50_000

KEY = ["_h", "_bytes"]
ROW = ["doc_id", "part", *KEY]


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B repeated words, C capitals, D symbols."""

    def judge(w: Column) -> Column:
        n = F.size(w)
        bits = [n < 100, 100 * F.size(F.array_distinct(w)).cast("long") < 80 * n.cast("long"), 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))

    return let(words(text), judge)


def _with_copied_keys(texts: DataFrame, copied: DataFrame, total: int) -> DataFrame:
    """The rows of ``texts`` whose key is in ``copied`` (KEY, n), with no task taking all rows of a hot key."""
    if copied.count() <= FEW_KEYS:
        return texts.join(F.broadcast(copied.select(*KEY)), KEY)
    hot = F.col("n") * HOT_SHARE > total
    busy = F.broadcast(copied.where(hot).select(*KEY))
    rest = texts.join(busy, KEY, "left_anti").join(copied.where(~hot).select(*KEY), KEY)
    return texts.join(busy, KEY).unionByName(rest)


def copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """ROW of the distinct rows whose text a smaller doc_id has, too.

    rows: ROW. texts: ROW, text. The join is left-semi on hash, exact text and smaller
    doc_id, with one row a text on its right side: the smallest doc_id, grouped with
    partial minima. Where all texts of a hash are equal, which the grouping proves, rows
    needn't bring their texts to the join; texts that share a hash are joined with them.
    """
    total = rows.count()
    copied = materialise(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"), "audit-keys")
    first = _with_copied_keys(texts, copied, total).where("doc_id IS NOT NULL").groupBy(*KEY, "text").agg(F.min("doc_id").alias("_first"))
    first = materialise(first, "audit-texts")
    by_key = first.groupBy(*KEY).agg(F.min("_first").alias("_first"), F.count("*").alias("_texts"))
    salts = F.ceil(F.col("n") / SALT_ROWS)
    salted = materialise(by_key.join(copied, KEY).withColumn("_salts", salts), "audit-firsts")

    spread = salted.where("_texts = 1").select(*KEY, "_first", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    # A key has more salts only if it has over SALT_ROWS rows, so such keys are few: at most a row for each SALT_ROWS rows.
    many = F.broadcast(salted.where("_salts > 1").select(*KEY, "_salts")) if total // SALT_ROWS <= FEW_KEYS else salted.where("_salts > 1").select(*KEY, "_salts")
    dealt = rows.join(many, KEY, "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("_salts", F.lit(1))))
    on = [dealt[c] == spread[c] for c in (*KEY, "_salt")]
    marked = dealt.join(spread, [*on, spread["_first"] < dealt["doc_id"]], "left_semi").select(*ROW)
    clash = salted.where("_texts > 1").select(*KEY, "n")
    if not clash.isEmpty():
        left = _with_copied_keys(texts, clash, total).select(*ROW, "text")
        right = first.join(clash, KEY, "left_semi").select(*KEY, "text", "_first")
        on = [left[c] == right[c] for c in (*KEY, "text")]
        marked = marked.unionByName(left.join(right, [*on, right["_first"] < left["doc_id"]], "left_semi").select(*ROW).distinct())
    return marked


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits, n: the failed filters of documents, and how many equal rows a row stands for.

    Ids that fail a filter on their own text are united with the ids of copies, and their bits or-ed.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    texts = own.withColumns({"_h": F.xxhash64("text"), "_bytes": F.octet_length("text")})
    rows = texts.select(*ROW, text_failures(F.col("text")).alias("bits")).groupBy(*ROW).agg(F.max("bits").alias("bits"), F.count("*").alias("n"))
    rows = materialise(rows, "audit-rows")
    marked = copies(rows.select(*ROW), texts).select(*ROW, F.lit(COPY).alias("bits"), F.lit(0).cast("long").alias("n"))
    return rows.unionByName(marked).groupBy(*ROW).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).select("doc_id", "part", "bits", "n")


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, good, toxic, n: how many documents have each combination of failures and labels."""
    flag = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    tally = lambda df: df.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))
    labelled = failed.where("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    nameless = failed.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return tally(tally(labelled).unionByName(tally(nameless)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; more columns are not read. A
    null text is empty, a null lang the part "". Several labels of an id count if any is 1.
    Rows that repeat an id count each, and don't mark each other as copies, nor does a row
    without an id mark or get marked. Texts are read whole. An empty table gives no rows.

    Only counts of failure combinations (at most 128 a part) meet the orders: first the 80
    pairs of a filter and a set of filters before it, then the 600 steps of all orders.
    """
    n = len(LETTERS)
    everything = range(1 << n)
    places = [(i, before) for i in range(n) for before in everything if not before >> i & 1]
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.lit(1 << i).alias("bit"), F.lit(before).alias("before")) for i, before in places))).alias("at")
    each = combinations(failures(docs), labels).select("*", at).select("part", "bits", "good", "toxic", "n", "at.*")
    fails, earlier = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long")))
    sums = each.groupBy("part", "f", "before").agg(
        count(~fails & ~earlier).alias("kept"),
        count(fails & ~earlier).alias("removed"),
        count(fails & earlier).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(fails & ~earlier & F.col("good")).alias("good_lost"),
        count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    # A set of s filters stands before a filter in s! (n - 1 - s)! orders.
    orders_of = F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)))
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * F.element_at(orders_of, F.bit_count("before") + 1)).alias("shapley"))
    steps = [("".join(LETTERS[i] for i in p), k + 1, p[k], sum(1 << i for i in p[:k])) for p in permutations(range(n)) for k in range(n)]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    out = sums.join(shapley, ["part", "f"]).join(F.broadcast(orders), ["f", "before"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
