"""Trees as tables: tree, node, parent (null at the root), t (time from the root), tip.

What runs along paths is computed by doubling: a table of the ancestors 1, 2, 4, ...
steps above each node takes as many joins as the depth has bits, and sums, minima and
marks move along it in the same number of rounds. Only ``closure`` makes a row for each
node and ancestor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.reads import hash_order
from strandline.sources.shared import written

KEY = ["tree", "node"]


def jumps(tree: DataFrame) -> list[DataFrame]:
    """tree, node, up: the ancestor 1, 2, 4, ... steps above each node that has one, a table for each step."""
    now = written(tree.where("parent IS NOT NULL").select(*KEY, F.col("parent").alias("up")), "jump")
    out: list[DataFrame] = []
    while not now.isEmpty():
        out.append(now)
        if len(out) > 40:
            raise ValueError("the parents of some nodes run in a circle")
        over = now.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"))
        now = written(now.join(over, ["tree", "up"]).select(*KEY, F.col("_up").alias("up")), "jump")
    return out


def closure(tree: DataFrame) -> DataFrame:
    """tree, node, anc, steps: every node with each of its ancestors, itself included."""
    out = tree.select(*KEY, F.col("node").alias("anc"), F.lit(0).alias("steps"))
    for k, jump in enumerate(jumps(tree)):
        above = out.select("tree", F.col("node").alias("up"), "anc", "steps")
        out = written(out.unionByName(jump.join(above, ["tree", "up"]).select(*KEY, "anc", (F.col("steps") + (1 << k)).alias("steps"))), "closure")
    return out


def gather(tree: DataFrame, own: DataFrame, merge: Callable[[str], Column], step: Callable[[Column, int], Column] = lambda x, _: x) -> DataFrame:
    """tree, node, x: ``merge`` of the x of ``own`` (tree, node, x) over a node and all below it.

    ``step(x, d)`` is x as it arrives d steps above. Nodes that nothing reaches have no row.
    """
    out = own
    for k, jump in enumerate(jumps(tree)):
        sent = jump.join(out, KEY).select("tree", F.col("up").alias("node"), step(F.col("x"), 1 << k).alias("x"))
        out = written(out.unionByName(sent).groupBy(*KEY).agg(merge("x").alias("x")), "gather")
    return out


def descend(tree: DataFrame, own: DataFrame) -> DataFrame:
    """tree, node, x: the sum of the x of ``own``, which has a row for each node, over a node and all its ancestors."""
    out = own
    for jump in jumps(tree):
        above = out.select("tree", F.col("node").alias("up"), F.col("x").alias("_x"))
        more = jump.join(above, ["tree", "up"]).select(*KEY, "_x")
        out = written(out.join(more, KEY, "left").select(*KEY, (F.col("x") + F.coalesce("_x", F.lit(0).cast(own.schema["x"].dataType))).alias("x")), "descend")
    return out


def depths(tree: DataFrame) -> DataFrame:
    """Add level, the number of steps to the root."""
    one = tree.select(*KEY, F.col("parent").isNotNull().cast("int").alias("x"))
    return tree.join(descend(tree, one).withColumnRenamed("x", "level"), KEY)


def clade_sizes(tree: DataFrame) -> DataFrame:
    """tree, node, n_tips of the nodes with a tip at or below them."""
    return gather(tree, tree.where("tip").select(*KEY, F.lit(1).cast("long").alias("x")), F.sum).withColumnRenamed("x", "n_tips")


def preorder(tree: DataFrame) -> DataFrame:
    """tree, node, first, last: numbers from 1 such that a node's clade is the nodes with first in [first, last]; siblings by id."""
    size = gather(tree, tree.select(*KEY, F.lit(1).cast("long").alias("x")), F.sum)
    own = tree.select(*KEY, "parent").join(size, KEY)
    before = F.sum("x").over(W.partitionBy("tree", "parent").orderBy("node")) - F.col("x")
    offset = own.select(*KEY, F.when(F.col("parent").isNull(), F.lit(1)).otherwise(before + 1).cast("long").alias("x"))
    first = descend(tree, offset).withColumnRenamed("x", "first")
    return first.join(size, KEY).select(*KEY, "first", (F.col("first") + F.col("x") - 1).alias("last"))


def last_common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """tree, i, j, lca: the deeper node is lifted to the other's level, then both to right below their ancestor."""
    ups = jumps(tree)
    level = depths(tree).select("tree", "node", "level")
    of = lambda c: level.select("tree", F.col("node").alias(c), F.col("level").alias(f"_l{c}"))
    now = pairs.select("tree", "i", "j").join(of("i"), ["tree", "i"]).join(of("j"), ["tree", "j"])
    deep = F.col("_li") >= F.col("_lj")
    now = now.select("tree", "i", "j", F.when(deep, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(deep, F.col("j")).otherwise(F.col("i")).alias("b"), F.abs(F.col("_li") - F.col("_lj")).alias("_gap"))
    lift = lambda rows, c, jump: rows.join(jump.select("tree", F.col("node").alias(c), F.col("up").alias(f"_{c}")), ["tree", c], "left")
    for k in reversed(range(len(ups))):
        moves = F.col("_gap").bitwiseAND(1 << k) > 0
        now = written(lift(now, "a", ups[k]).withColumn("a", F.when(moves, F.col("_a")).otherwise(F.col("a"))).drop("_a"), "lca")
    for k in reversed(range(len(ups))):
        apart = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))
        both = lift(lift(now, "a", ups[k]), "b", ups[k])
        now = written(both.withColumns({"a": F.when(apart, F.col("_a")).otherwise(F.col("a")), "b": F.when(apart, F.col("_b")).otherwise(F.col("b"))}).drop("_a", "_b"), "lca")
    up = tree.select("tree", F.col("node").alias("a"), "parent")
    return now.join(up, ["tree", "a"]).select("tree", "i", "j", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("parent")).alias("lca"))


def propagate(tree: DataFrame, lost: DataFrame) -> DataFrame:
    """tree, node, key, lost: a loss at a node holds for all below it (it never comes back)."""
    hit = lost.select(*KEY, "key").distinct()
    for jump in jumps(tree):
        above = hit.select("tree", F.col("node").alias("up"), "key")
        hit = written(hit.unionByName(jump.join(above, ["tree", "up"]).select(*KEY, "key")).distinct(), "lost")
    # One row for each node and key is what is asked for; the keys are few (tapes).
    every = tree.select(*KEY).join(lost.select("key").distinct())
    return every.join(hit.withColumn("lost", F.lit(True)), ["tree", "node", "key"], "left").withColumn("lost", F.coalesce("lost", F.lit(False)))


def tip_pairs(tree: DataFrame, seed: int) -> DataFrame:
    """tree, node, i, j: for each node with two children or more, a tip below each of its first two, the least by hash order."""
    tips = tree.where("tip").select(*KEY, F.struct(hash_order(seed, *KEY).alias("h"), "node").alias("x"))
    pick = gather(tree, tips, F.min).select(*KEY, F.col("x.node").alias("pick"))
    child = tree.where("parent IS NOT NULL").select("tree", F.col("parent"), "node").join(pick, KEY)
    turn = F.row_number().over(W.partitionBy("tree", "parent").orderBy("node"))
    two = child.withColumn("_k", turn).where("_k <= 2").groupBy("tree", F.col("parent").alias("node"))
    return two.agg(F.max(F.when(F.col("_k") == 1, F.col("pick"))).alias("i"), F.max(F.when(F.col("_k") == 2, F.col("pick"))).alias("j")).where("j IS NOT NULL")


def lineages(tree: DataFrame, points: int = 50) -> DataFrame:
    """tree, idx, n: branches alive at evenly spaced times from the root to the last tip; a branch lives after its parent's time up to its own."""
    up = tree.alias("c").join(tree.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"])
    top = tree.groupBy("tree").agg(F.max("t").alias("top"))
    # The grid points that a branch covers follow from its ends, so no pairs with the grid are made.
    step = F.col("top") / points
    first, last = F.floor(F.col("t0") / step) + 1, F.least(F.floor(F.col("t") / step), F.lit(points))
    rows = up.join(top, "tree").withColumns({"_a": first, "_b": last}).where("_a <= _b")
    return rows.select("tree", F.explode(F.sequence("_a", "_b")).alias("idx")).groupBy("tree", "idx").agg(F.count("*").alias("n"))


def statistics(tree: DataFrame) -> DataFrame:
    """tree, n_nodes, n_tips, length (sum of branches), height."""
    up = tree.join(tree.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"], "left")
    return up.groupBy("tree").agg(F.count("*").alias("n_nodes"), F.count_if("tip").alias("n_tips"), F.sum(F.when(F.col("t0").isNotNull(), F.col("t") - F.col("t0")).otherwise(0.0)).alias("length"), F.max("t").alias("height"))


def balance(tree: DataFrame) -> DataFrame:
    """tree, b1: the sum over inner nodes but the root of one over the most steps to a tip below."""
    high = gather(tree, tree.where("tip").select(*KEY, F.lit(0).alias("x")), F.max, lambda x, d: x + d)
    inner = high.where("x > 0").join(tree.where("parent IS NOT NULL").select(*KEY), KEY)
    return inner.groupBy("tree").agg(F.sum(1 / F.col("x")).alias("b1"))


def faults(tree: DataFrame) -> DataFrame:
    """fault and n: roots other than one, nodes without their parent, children before parents, tips with children."""
    parent = tree.select("tree", F.col("node").alias("parent"), F.col("t").alias("pt"), F.col("tip").alias("ptip"), F.lit(True).alias("found"))
    up = tree.join(parent, ["tree", "parent"], "left")
    roots = tree.groupBy("tree").agg(F.count_if(F.col("parent").isNull()).alias("r")).agg(F.count_if(F.col("r") != 1).alias("n")).select(F.lit("roots").alias("fault"), "n")
    count = lambda name, c: up.agg(F.count_if(c).alias("n")).select(F.lit(name).alias("fault"), "n")
    return roots.unionByName(count("orphan", F.col("parent").isNotNull() & F.col("found").isNull())).unionByName(count("order", F.col("t") < F.col("pt"))).unionByName(count("tip", F.coalesce("ptip", F.lit(False))))


def sample_locations(tree: DataFrame, n: int) -> DataFrame:
    """tree, k, node, at: n points spread evenly over the total branch length."""
    up = tree.join(tree.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"])
    run = W.partitionBy("tree").orderBy("node")
    b = up.withColumn("_len", F.col("t") - F.col("t0")).withColumns({"_to": F.sum("_len").over(run), "_all": F.sum("_len").over(W.partitionBy("tree"))})
    b = b.withColumn("_from", F.col("_to") - F.col("_len")).withColumn("_step", F.col("_all") / n)
    k0, k1 = F.ceil(F.col("_from") / F.col("_step") - 0.5), F.ceil(F.col("_to") / F.col("_step") - 0.5) - 1
    hit = b.withColumns({"_k0": F.greatest(k0, F.lit(0)), "_k1": F.least(k1, F.lit(n - 1))}).where("_k0 <= _k1")
    return hit.select("tree", F.explode(F.sequence("_k0", "_k1")).alias("k"), "node", "t0", "_from", "_step").select("tree", "k", "node", (F.col("t0") + (F.col("k") + 0.5) * F.col("_step") - F.col("_from")).alias("at"))


def newick(tree: DataFrame) -> DataFrame:
    """tree, text: each tree is written by one kernel."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        time = dict(zip(rows["node"], rows["t"], strict=True))
        children: dict[int, list[int]] = {}
        root = 0
        for node, parent in zip(rows["node"], rows["parent"], strict=True):
            if pd.isna(parent):
                root = node
            else:
                children.setdefault(int(parent), []).append(node)
        text: dict[int, str] = {}
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                text[node] = "(" + ",".join(f"{text.pop(c)}:{time[c] - time[node]:.10g}" for c in sorted(children[node])) + ")"
            elif node in children:
                stack.append((node, True))
                stack += [(c, False) for c in children[node]]
            else:
                text[node] = str(node)
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "text": [text[root] + ";"]})

    return tree.select("tree", "node", "parent", "t").groupBy("tree").applyInPandas(run, "tree long, text string")


def epoch_overlap(tree: DataFrame, epochs: DataFrame) -> DataFrame:
    """tree, node, epoch, span: how much of each branch lies in each epoch (epoch, low, high). Epochs are a few rows of configuration."""
    up = tree.join(tree.select("tree", F.col("node").alias("parent"), F.col("t").alias("t0")), ["tree", "parent"])
    met = up.join(F.broadcast(epochs), (F.col("t0") < F.col("high")) & (F.col("t") > F.col("low")))
    return met.select("tree", "node", "epoch", (F.least("t", "high") - F.greatest("t0", "low")).alias("span"))


def root_split(tree: DataFrame) -> DataFrame:
    """tree, child, n_tips of the nodes right below the root."""
    root = tree.where("parent IS NULL").select("tree", F.col("node").alias("parent"))
    return tree.join(root, ["tree", "parent"]).select("tree", "node").join(clade_sizes(tree), ["tree", "node"]).select("tree", F.col("node").alias("child"), "n_tips")


def history_keys(tree: DataFrame) -> DataFrame:
    """tree, n_nodes, key: the same for trees that join the same tips in the same order, whatever their nodes' ids and the order of children.

    A lineage is named by its smallest tip, which no other lineage alive at the same time
    has, so the lineages that a node joins, and the nodes' order from the latest on (ties:
    the smaller name), tell the whole history. Sets and sequences are folded into hashes by
    exclusive or, so no list of a node's children or of a tree's nodes is made.
    """
    bits = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *c).cast("binary")), 1, 15), 16, 10).cast("long")
    name = gather(tree, tree.where("tip").select(*KEY, F.col("node").alias("x")), F.min)
    named = tree.join(name, KEY)
    joined = named.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.bit_xor(bits(F.col("x").cast("string"))).alias("_set"), F.count("*").alias("_n"))
    ranked = named.join(joined, KEY).withColumn("_k", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("t"), "x", "_n")))
    fold = F.bit_xor(bits(*(F.col(c).cast("string") for c in ("_k", "_set", "_n"))))
    return ranked.groupBy("tree").agg(F.count("*").alias("n_nodes"), fold.alias("key"))
