"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are cut into blocks
of a fixed length. For each output shard the number of blocks from each source is a
multinomial draw; running totals over the shards turn the counts into slot numbers of
the source, and a pseudorandom permutation of the source's block indices turns a slot
number into a block. Documents and drawn blocks meet in a join on (source, block).

Multinomial totals miss the targets a little, so a draw stops at its source's quota and
what is missing is added in a last shard. A source's last block is a short one; it comes
last in each pass over the source, and the last slot of a source takes only the words
still missing: the words taken equal the rounded target exactly.

Everything is DataFrame operations. Running totals go over hash buckets of documents and
superblocks of shards, so no source is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import key_of, materialise, protect, words

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, source, _source (a key that is never null), size in words."""
    return docs.select("doc_id", "source", key_of(F.col("source")).alias("_source"), F.size(words(F.col(text_column))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_source, source_size, target: one row for each source.

    Sources in code point order, null last, get ``weights`` in turn. They share ``share``
    times all words; none gets over ``most`` times its own, and the excess goes to the
    others by weight. With sources ordered by cap over weight, the full ones are a prefix:
    the level is the first at which the rest need not be capped.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.max("source").alias("_name"))
    # One row for each source: these windows have no key, and few rows.
    turn = F.row_number().over(W.orderBy(F.col("_name").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", most * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), "_name")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = share * F.sum("source_size").over(W.partitionBy())
    per = per.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("weight") * F.col("_level") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("level")))).over(W.partitionBy())
    per = per.withColumn("_at", level["level"])
    return per.select("_source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("weight") * F.col("_at")), F.col("_cap")).alias("target"))


def positions(sized: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Add ``_bucket``, ``_row`` (together unique in a source) and ``start``, the source's words before the document.

    Documents follow the hash of their id and size; equal ones follow the column ``_tie``, if there is one.
    """
    tie = [c for c in ("_tie",) if c in sized.columns]
    keyed = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    inside = W.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "size", *tie)
    keyed = keyed.withColumns({"_row": F.row_number().over(inside), "_in": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    sums = sized.groupBy("_source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)).cast("int").alias("_bucket")).agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_base", F.sum("_n").over(W.partitionBy("_source").orderBy("_bucket")) - F.col("_n")).drop("_n")
    return keyed.join(sums, ["_source", "_bucket"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_hash", "_in", "_base")


def permuted(index: Column, n: Column, key: Column, seed: int, rounds: int = 4) -> Column:
    """A pseudorandom permutation of 0 to n - 1, a different one for each key.

    A Feistel network on pairs (l, r) with l below a = ceil(sqrt(n)) and r below
    ceil(n / a), walked until it falls below n. Fewer than a of the pairs lie beyond n, so
    with n up to 4096 the 64 steps always do; above, the odds of more are below 64 ** -64.
    """

    def turn(x: Column, a: Column, b: Column) -> Column:
        left, right = F.floor(x / b), F.pmod(x, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed + i), key, right), a), a)
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed + i), key, left), b), b)
        return left * b + right

    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")
    once = lambda x: F.transform(F.array(x), lambda y: turn(y, a, b))[0]
    walk = lambda x: F.aggregate(F.sequence(F.lit(2), F.lit(64)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    first = F.transform(F.array(turn(index.cast("long"), a, b)), lambda x: F.when(x < n, x).otherwise(walk(x)))[0]  # nearly all need one step
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(first)


def plan_slots(quotas: DataFrame, slots: int, seed: int, shard_slots: int, grid: int = 4096) -> DataFrame:
    """_shard, _source, _first, _n: how many blocks each shard draws from each source, and its first slot number there.

    quotas: _source and quota, whose sum is ``slots``.
    """
    spark = quotas.sparkSession
    # A source is an interval of [0, slots); a draw falls into one. Both are cut at a grid so that they meet in an equi-join.
    ends = W.orderBy("_source")
    edges = quotas.where("quota > 0").withColumn("_to", F.sum("quota").over(ends)).withColumn("_from", F.col("_to") - F.col("quota"))
    cell = lambda x: F.floor(x / F.lit(max(slots, 1)) * grid)
    edges = edges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), F.least(cell(F.col("_to")), F.lit(grid - 1)))))
    draw = spark.range(slots).select((F.col("id") / shard_slots).cast("long").alias("_shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("_u"))
    draws = draw.withColumn("_cell", F.least(cell(F.col("_u")), F.lit(grid - 1))).groupBy("_shard", "_cell", "_u").count()
    drawn = draws.join(edges, "_cell").where("_u >= _from and _u < _to").groupBy("_shard", "_source").agg(F.sum("count").alias("_n"))

    drawn = drawn.withColumn("_super", F.floor(F.col("_shard") / 4096))
    inside = W.partitionBy("_source", "_super").orderBy("_shard")
    supers = drawn.groupBy("_source", "_super").agg(F.sum("_n").alias("_k"))
    supers = supers.withColumn("_base", F.sum("_k").over(W.partitionBy("_source").orderBy("_super")) - F.col("_k")).drop("_k")
    drawn = drawn.withColumn("_first", F.sum("_n").over(inside) - F.col("_n")).join(supers, ["_source", "_super"]).withColumn("_first", F.col("_first") + F.col("_base"))
    limits = quotas.select("_source", "quota")
    kept = drawn.join(limits, "_source").withColumn("_n", F.least(F.col("_n"), F.col("quota") - F.col("_first"))).where("_n > 0").select("_shard", "_source", "_first", "_n")

    totals = drawn.groupBy("_source").agg(F.sum("_n").alias("_drawn"))
    missing = limits.join(totals, "_source", "left").select((F.lit(slots) / shard_slots).cast("long").alias("_shard"), "_source", F.coalesce("_drawn", F.lit(0)).alias("_first"), (F.col("quota") - F.coalesce("_drawn", F.lit(0))).alias("_n")).where("_n > 0")
    # A row's slots are generated from it: cut it so that no row stands for many.
    every = kept.unionByName(missing).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / shard_slots))))
    return every.select("_shard", "_source", (F.col("_first") + F.col("_part") * shard_slots).alias("_first"), F.least(F.lit(shard_slots), F.col("_n") - F.col("_part") * shard_slots).alias("_n"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int = 4096, buckets: int | None = None, seed: int = 17, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (documents, slots).

    documents: doc_id, source, size, source_size, target, taken; one row for each row of
    ``docs``. slots: shard, source key, slot, block, words; one row for each block drawn.

    A null text has no words and gives nothing. A null source is a source. Rows may
    repeat; ties in the order of documents are between rows with the same id and size,
    which the result doesn't tell apart. ``most`` is at most 2 times in whole passes, so no
    document is taken more often than that. The same rows and seed give the same mix,
    whatever the partitions. A text of any length is one document, cut into as many blocks
    as it needs; other columns are ignored; an empty table gives empty tables.

    A source's documents are dealt to ``buckets`` for running totals: as many as there are
    million rows in the table, 1,024 at least.
    """
    return mix_sized(materialise(sizes(docs, text_column), "sizes"), weights, share, most, block_words, shard_slots, buckets, seed)


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_slots: int = 4096, buckets: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``mix`` from the rows of ``sizes``; further columns are carried to the documents."""
    buckets = buckets or max(1024, sized.count() // 1_000_000)
    carried = [c for c in sized.columns if c not in ("doc_id", "source", "_source", "size")]
    goals = materialise(targets(sized, weights, share, most), "targets")
    b = block_words
    goals = goals.withColumns({"_want": F.least(F.round("target"), F.floor(most * F.col("source_size"))).cast("long"), "_blocks": F.ceil(F.col("source_size") / b)})
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("_passes", passes).withColumn("_rest", F.col("_want") - F.col("_passes") * F.col("source_size"))
    goals = goals.withColumn("quota", (F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / b)).cast("long"))
    n_slots = goals.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    drawn = plan_slots(goals, n_slots, seed, shard_slots)
    # Few rows, each of which stands for many slots: deal them out before they are generated.
    drawn = drawn.repartition(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_shard", "_source", "_first")
    slots = drawn.select(F.col("_shard").alias("shard"), "_source", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"))
    slots = slots.join(goals.select("_source", "source_size", "_blocks", "_passes", "_rest", "quota"), "_source")
    at, full = F.pmod("slot", "_blocks"), F.floor(F.col("source_size") / b)
    block = F.when(at < full, permuted(at, full, F.concat_ws("|", "_source", F.floor(F.col("slot") / F.col("_blocks"))), seed)).otherwise(at)
    length = F.least(F.lit(b), F.col("source_size") - F.col("block") * b)
    last = (F.floor(F.col("slot") / F.col("_blocks")) == F.col("_passes")) & (F.col("slot") == F.col("quota") - 1)
    slots = slots.withColumn("block", block).withColumn("words", F.when(last, F.least(length, F.col("_rest") - at * b)).otherwise(length)).select("shard", "_source", "slot", "block", "words")

    whole = F.col("words") == F.least(F.lit(b), F.col("source_size") - F.col("block") * b)
    drawn = slots.join(goals.select("_source", "source_size"), "_source").groupBy("_source", "block").agg(F.sum(F.when(whole, 1).otherwise(0)).alias("_whole"), F.max(F.when(~whole, F.col("words")).otherwise(0)).alias("_cut"))
    placed = positions(sized, seed, buckets)
    end = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor(end / b))))
    low = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b))
    took = F.coalesce(F.col("_whole") * (high - low) + F.greatest(F.least(high, F.col("_cut")) - low, F.lit(0)), F.lit(0))
    taken = pieces.join(drawn, ["_source", "block"], "left").groupBy("_source", "_bucket", "_row", "doc_id", "source", "size", *carried).agg(F.sum(took).alias("taken"))
    documents = taken.join(goals.select("_source", "source_size", "target"), "_source").select("doc_id", "source", "size", "source_size", "target", "taken", *carried)
    return documents, slots


def resample(docs: DataFrame, seed: int = 17, buckets: int | None = None, **options) -> DataFrame:
    """The rows of ``docs``, whole documents, as often as the mix takes them.

    A document comes as often as the mix takes all of its words. Those taken in part
    then come once more, in a pseudorandom order, until the words taken in part of their
    source are reached: a source differs from its words in the mix by less than a document.
    A document without words comes once. Null texts have no words, a null source is a
    source, repeated rows are documents of their own, all columns are kept whatever their
    names, and an empty table stays empty. The same rows give the same result whatever
    their partitions: documents with equal id and size are ordered by their text's hash.
    """
    docs, restore = protect(docs, ["doc_id", "text", "source"])
    numbered = materialise(docs.withColumns({"_rid": F.monotonically_increasing_id(), "_size": F.size(words(F.col("text"))).cast("long")}), "numbered")
    sized = numbered.select("doc_id", "source", key_of(F.col("source")).alias("_source"), F.col("_size").alias("size"), "_rid", F.xxhash64("text").alias("_tie"))
    buckets = buckets or max(1024, sized.count() // 1_000_000)
    documents, _ = mix_sized(sized, seed=seed, buckets=buckets, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))
    documents = materialise(documents.select("doc_id", "source", key_of(F.col("source")).alias("_source"), "size", "_rid", "_tie", whole.alias("_whole"), F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).alias("_part")), "taken")
    partly = documents.where("_part > 0")
    due = partly.groupBy("_source").agg(F.sum("_part").alias("_due"))
    more = positions(partly.drop("_whole", "_part"), seed + 1, buckets).join(due, "_source").where(F.col("start") < F.col("_due")).select("_rid", F.lit(1).alias("_more"))
    copies = documents.join(more, "_rid", "left").select("_rid", (F.col("_whole") + F.coalesce("_more", F.lit(0))).alias("_copies")).where("_copies > 0")
    return restore(numbered.join(copies, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
