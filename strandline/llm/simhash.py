"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

If the 64 bits are cut into partitions with thresholds t such that the sum of t + 1
exceeds the distance, two fingerprints within it are within t in some partition. Bits
that go together are grouped into the same partition, and dynamic programming on the
candidate counts that the partitions' histograms give allocates the thresholds: a
partition with few common values gets a high one, a crowded one a low one or none (-1).

Each distinct fingerprint goes to the buckets of its own value in a partition and, as a
probe, to those within the threshold. Buckets are compared in sorted runs and only the
edges of a spanning forest leave them, never all pairs. A bucket with more than ``cap``
fingerprints is cut again by the bits that its members needn't share, as often as
needed; once few such bits are left, members within one bit and within two bits of the
same key are linked to one of them instead. No bucket is capped or skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import join_hot, materialise, protect, with_ids
from strandline.llm.components import components

BITS = 64
QUARTER = 16
U = np.uint64


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lowered; of all words if there are fewer."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # on bytes: A-Z, and the six separators
    if not words:
        return np.zeros(0, U)
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], U)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    pairs = zip((ends - lengths)[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], 42) for a, b in pairs), U, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes, repeats counted."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Add ``_fp``, the fingerprint as a signed long, to the rows of ``docs``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            fps = np.fromiter((fingerprint(shingle_hashes((t.as_py() or "").encode(), size)) for t in texts), U, len(texts))
            yield batch.append_column("_fp", pa.array(fps.view(np.int64)))

    return docs.mapInArrow(run, schema)


def _pick(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed."""
    out = np.zeros(len(fps), U)
    for i, b in enumerate(bits):
        out |= ((fps >> U(b)) & U(1)) << U(i)
    return out


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def correlated_quarters(distinct: DataFrame) -> tuple[int, list[list[int]]]:
    """The number of fingerprints, and the bits in four groups that go together.

    A task sums how often two bits are both set; 4096 sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                x = np.unpackbits(_fps(batch.slice(at, 1 << 16)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["k", "n"])

    sums = np.zeros(BITS * BITS)
    for k, n in distinct.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        sums[k] = n
    n = distinct.count()
    both = sums.reshape(BITS, BITS) / max(n, 1)
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    while free:
        left = sorted(free)
        group = [max(left, key=lambda b: related[b, left].max())]
        while len(group) < QUARTER:
            group.append(max((b for b in left if b not in group), key=lambda b: related[b, group].sum()))
        groups.append(sorted(group))
        free -= set(group)
    return n, groups


def pair_counts(distinct: DataFrame, quarters: list[list[int]]) -> np.ndarray:
    """[quarter, d]: how many pairs of fingerprints differ in d bits there, from the histograms of its 65,536 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(quarters), 1 << QUARTER), np.int64)
        for batch in batches:
            fps = _fps(batch)
            for q, bits in enumerate(quarters):
                total[q] += np.bincount(_pick(fps, bits).astype(np.int64), minlength=1 << QUARTER)
        q, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q * (1 << QUARTER) + v), pa.array(total[q, v])], ["k", "n"])

    rows = distinct.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(quarters) << QUARTER)
    counts[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    weight = np.bitwise_count(np.arange(1 << QUARTER, dtype=np.uint32))
    out = np.zeros((len(quarters), QUARTER + 1))
    for q, h in enumerate(counts.reshape(len(quarters), -1)):
        x = h.copy()
        for _ in range(2):  # Walsh-Hadamard transform, square, and back: pairs by the exclusive or of their values
            for s in range(QUARTER):
                x = x.reshape(-1, 2, 1 << s)
                x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1).ravel()
            x = x * x if _ == 0 else x / (1 << QUARTER)
        out[q] = np.bincount(weight, weights=x, minlength=QUARTER + 1) / 2
        out[q, 0] = max(0.0, out[q, 0] - h.sum() / 2)
    return out


def allocate(n: int, counts: np.ndarray, quarters: list[list[int]], distance: int, row_cost: float = 1.0, pair_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe: the cheapest by dynamic programming.

    Partitions are quarters or halves. A half's pairs are estimated from its quarters as if
    these were independent. The estimates steer the cost, never the result.
    """
    share = counts / max(counts.sum(axis=1).max(), 1.0)
    pairs = n * (n - 1) / 2

    def cost(part: tuple[int, ...], t: int) -> float:
        if t < 0:
            return 0.0
        bits = QUARTER * len(part)
        rows = n * sum(comb(bits, d) for d in range(t + 1))
        found = share[part[0]]
        for q in part[1:]:
            found = np.convolve(found, share[q])
        return row_cost * rows + pair_cost * pairs * float(found[: t + 1].sum())

    best: tuple[float, list[tuple[tuple[int, ...], int]]] | None = None
    for scheme in ([(0,), (1,), (2,), (3,)], [(0, 1), (2, 3)], [(0, 1), (2,), (3,)]):
        table: dict[int, tuple[float, list[tuple[tuple[int, ...], int]]]] = {0: (0.0, [])}
        for part in scheme:
            after: dict[int, tuple[float, list[tuple[tuple[int, ...], int]]]] = {}
            for used, (spent, chosen) in table.items():
                for t in range(-1, min(distance - used, 3) + 1):
                    total = spent + cost(part, t)
                    if used + t + 1 not in after or total < after[used + t + 1][0]:
                        after[used + t + 1] = (total, [*chosen, (part, t)])
            table = after
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = table[distance + 1]
    assert best is not None, "the distance is too large for these partitions"
    return [([b for q in part for b in quarters[q]], t) for part, t in best[1] if t >= 0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _rows(key: np.ndarray, fp: np.ndarray, probe: bool | np.ndarray, free: int | np.ndarray) -> pa.RecordBatch:
    full = lambda v, kind: np.broadcast_to(np.asarray(v, kind), len(fp))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(full(probe, bool)), pa.array(full(free, U).copy().view(np.int64))], ["key", "fp", "probe", "free"])


BUCKETS = "key long, fp long, probe boolean, free long"


def buckets(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp, probe, free: each fingerprint in the buckets of its values and, as a probe, in those nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fps(batch)
            for p, (bits, t) in enumerate(plan):
                value, free = _pick(fps, bits), ~sum(1 << b for b in bits) & (1 << BITS) - 1
                # 0 to 2 ** 32 for the values; probes also leave the partition's bits free
                for d in range(t + 1):
                    for flips in combinations(range(len(bits)), d):
                        key = _mix((value ^ U(sum(1 << i for i in flips))) | U((p + 1) << 40))
                        yield _rows(key, fps, d > 0, free)

    return distinct.mapInArrow(run, BUCKETS)


def _cut_again(rows: DataFrame, parts: int) -> DataFrame:
    """Cut buckets by the bits their members needn't share, into ``parts`` smaller ones for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, free = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for i in (0, 1, 3))
            probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for mask in np.unique(free):
                own = free == mask
                bits = [b for b in range(BITS) if int(mask) >> b & 1]
                for p in range(parts):
                    some = bits[p::parts]
                    if some:
                        left = int(mask) & ~sum(1 << b for b in some)
                        yield _rows(_mix(_mix(key[own] + U(p + 1)) ^ _pick(fp[own], some)), fp[own], probe[own], left)

    return rows.mapInArrow(run, BUCKETS)


def _near_keys(rows: DataFrame, distance: int) -> DataFrame:
    """Edges of buckets with few free bits: members within distance - distance // 2 flips of a key meet one within distance // 2.

    Two fingerprints in the same bucket that are within the distance differ in free bits
    or, for probes, in bits flipped to get there; so all 64 bits count for a bucket's
    probes, and only the free ones where it has none.
    """
    near, far = distance // 2, distance - distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, vary = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in ("key", "fp", "vary"))
            for mask in np.unique(vary):
                own = vary == mask
                bits = [b for b in range(BITS) if int(mask) >> b & 1]
                for d in range(min(far, len(bits)) + 1):
                    for flips in combinations(bits, d):
                        at = _mix(_mix(fp[own] ^ U(sum(1 << b for b in flips))) ^ key[own])
                        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp[own].view(np.int64)), pa.array(np.full(len(at), d <= near))], ["at", "fp", "near"])

    # The bits in which the members of a bucket differ at all.
    vary = rows.groupBy("key").agg(F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all")).select("key", F.col("some").bitwiseXOR(F.col("all")).alias("vary"))
    keyed = rows.join(vary, "key").select("key", "fp", "vary").mapInArrow(run, "at long, fp long, near boolean")
    hubs = keyed.where("near").groupBy("at").agg(F.min("fp").alias("hub"))
    found = keyed.join(hubs, "at").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def _forest(fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of fingerprints within the distance: breadth first, each step over those not yet reached."""
    left, a, b = fp, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                queue.extend(hit)
    return a, b


def _compare(rows: DataFrame, distance: int, small: int) -> DataFrame:
    """a, b: edges between the fingerprints of each bucket that are within the distance."""

    def edges(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        a, b = [], []
        for g in np.flatnonzero(size > small):
            x, y = _forest(np.unique(fp[edge[g] : edge[g + 1]]), distance)
            a += x
            b += y
        at = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
        for d in range(1, small):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            ok = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= distance) & ~(probe[at] & probe[at + d])]
            a.append(fp[ok])
            b.append(fp[ok + d])
        none = np.zeros(0, U)
        x, y = np.concatenate([none, *a]), np.concatenate([none, *b])
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x.view(np.int64), y.view(np.int64))), pa.array(np.minimum(x.view(np.int64), y.view(np.int64)))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool))
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, fp, probe = (np.concatenate(x) for x in zip(held, (new[0].astype(np.int64).view(U), new[1].astype(np.int64).view(U), new[2].astype(bool)), strict=True))
            if not len(key):
                continue
            last = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))  # the last bucket may go on
            if last:
                yield edges(key[:last], fp[:last], probe[:last])
            held = (key[last:], fp[last:], probe[last:])
        if len(held[0]):
            yield edges(*held)

    ordered = rows.select("key", "fp", "probe").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, distance: int = 3, cap: int = 4096, small: int = 24, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """a, b: edges within ``distance`` that connect exactly what all pairs within it would.

    Buckets of up to ``small`` fingerprints give all their pairs within it, larger ones a
    spanning forest.
    ``distinct`` holds each fingerprint once, in its first column.
    """
    if plan is None:
        n, quarters = correlated_quarters(distinct)
        plan = allocate(n, pair_counts(distinct, quarters), quarters, distance)
    rows = buckets(distinct, plan)
    found: DataFrame | None = None
    parts = distance + 1
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.bit_count("free")).alias("free")).where(F.col("n") > cap)
        hot = materialise(sizes, "hot-buckets")
        if hot.isEmpty():
            edges = _compare(rows, distance, small)
            return edges if found is None else found.unionByName(edges).distinct()
        # The rest of the buckets are done; those too large are cut again, or met by keys if few bits are free.
        edges = _compare(rows.join(hot.select("key"), "key", "left_anti"), distance, small)
        crowded = materialise(rows.join(hot.select("key", F.col("free").alias("_free")), "key"), "crowded")
        edges = edges.unionByName(_near_keys(crowded.where(F.col("_free") <= 5 * parts).drop("_free"), distance))
        found = materialise(edges if found is None else found.unionByName(edges), "links")
        rows = materialise(_cut_again(crowded.where(F.col("_free") > 5 * parts).drop("_free"), parts), "cut-again")


def similarity(a: str, b: str, size: int) -> float:
    """Jaccard similarity of the sets of shingles of ``size`` words."""
    x, y = (set(shingle_hashes(t.encode(), size).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


#: The share of texts, one in so many, whose shingles are counted to order all shingles, and how many of the most common are told apart.
SAMPLED, COMMON = 16, 1 << 18
#: Bytes of a shingle's hash in a set.
WIDTH = 6
#: How many shingles of their prefixes two similar texts share at least: a chance meeting is of one.
TOGETHER = 2


def pack_set(hashes: np.ndarray) -> bytes:
    """A sorted set of hashes, their lowest 48 bits each."""
    own = np.unique(hashes & U((1 << 8 * WIDTH) - 1))
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def bucket_counts(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of about a bucket for two; empty if a count is over 255."""
    n = 1 << max(5, (len(own) // 2).bit_length() - 1)
    counts = np.bincount((own & U(n - 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def overlap_bound(a: bytes, b: bytes) -> int | None:
    """At most so many hashes are in both sets, by their bucket counts; None if these don't tell."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())  # buckets are the lowest bits: fold the finer ones


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """_rid, _fp (fingerprint), n, s (set of shingle hashes), c (bucket counts) of each text (_rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                hashes = shingle_hashes((t.as_py() or "").encode(), size)
                packed = pack_set(hashes)
                out.append((fingerprint(hashes), len(packed) // WIDTH, packed, bucket_counts(unpack_set(packed)) if packed else b""))
            fp, n, s, c = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, U).view(np.int64)), pa.array(n, pa.int32()), pa.array(s, pa.binary()), pa.array(c, pa.binary())], ["_rid", "_fp", "n", "s", "c"])

    return texts.select("_rid", "text").mapInArrow(run, "_rid long, _fp long, n int, s binary, c binary")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that a sample of ``sets`` repeats most, and how often. They steer the cost, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_set(x.as_py()).view(np.int64))], ["s"])

    sample = sets.where(F.pmod(F.xxhash64("_rid"), F.lit(SAMPLED)) == 0).select("s").mapInArrow(run, "s long")
    top = sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    own = top.column("s").to_numpy().astype(np.int64).view(U)
    order = np.argsort(own)
    return own[order], top.column("n").to_numpy()[order]


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """_rid, n, s, p: the shingles of each of ``sets``, of n, up to position p in one order of all shingles, rare ones first.

    Two texts with a similarity of ``least`` or more share at least that part of the
    shingles of either, so they share ``TOGETHER`` of the first n - ceil(least * n) +
    ``TOGETHER`` of each, or all if either has fewer.
    """
    common, counts = common_shingles(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, sizes, firsts = [], [], []
            for rid, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpack_set(x.as_py())
                if not len(own):
                    continue
                weight = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    weight = np.where(common[at] == own, counts[at], 0)
                rids.append(rid)
                sizes.append(len(own))
                firsts.append(own[np.lexsort((own, weight))][: len(own) - int(np.ceil(least * len(own) - 1e-9)) + TOGETHER])
            if rids:
                each = [len(f) for f in firsts]
                column = lambda v, kind, each=each: pa.array(np.repeat(np.array(v, kind), each))
                yield pa.RecordBatch.from_arrays([column(rids, np.int64), column(sizes, np.int32), pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each]))], ["_rid", "n", "s", "p"])

    return sets.select("_rid", "s").mapInArrow(run, "_rid long, n int, s long, p int")


def least_shared(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """How many shingles the prefixes (``prefixes``) of texts with n and m shingles share at least, if their similarity is ``least`` or more.

    Of the shingles that both have, those in the prefix that ends first in the order are in
    the other one, too; at most what lies behind that prefix is not.
    """
    behind = lambda k: np.maximum(np.ceil(least * k - 1e-9) - TOGETHER, 0)
    return np.ceil(least / (1 + least) * (n + m) - 1e-6) - np.maximum(behind(n), behind(m))


#: The ``need`` of a pair whose similarity is out of reach.
NEVER = (1 << 31) - 1


def _distinct_pairs(x: np.ndarray, y: np.ndarray, need: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the least need of its rows, and the sum of its times."""
    order = np.lexsort((y, x))
    x, y, need, times = x[order], y[order], need[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, int)
    return (x[first], y[first], np.minimum.reduceat(need, first), np.add.reduceat(times, first)) if len(x) else (x, y, need, times)


def meetings(rows: DataFrame, least: float, small: int) -> DataFrame:
    """What comes of texts that share a shingle of their prefixes (_rid, n, s, p), by one pass over the rows in the order of shingles.

    A shingle of up to ``small`` texts gives their pairs: x, y, need (how many shingles they
    must share, NEVER if the similarity is out of reach with this as the first one) and
    times, each pair once for a batch. Texts of a shingle with more are handed on: s, _rid, n, p, with y null; however
    many there are, a task holds a batch of them.
    """

    def pairs(s: np.ndarray, rid: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        found: list[tuple[np.ndarray, ...]] = []
        at = np.arange(len(s))
        for d in range(1, small):
            at = at[at + d < len(s)]
            at = at[s[at] == s[at + d]]
            if not len(at):
                break
            other = at + d
            room = np.minimum(n[at] - p[at], n[other] - p[other]) * (1 + least) >= least * (n[at].astype(float) + n[other]) - 1e-6
            need = np.where(room, least_shared(n[at].astype(float), n[other].astype(float), least), NEVER).astype(np.int32)
            found.append((np.minimum(rid[at], rid[other]), np.maximum(rid[at], rid[other]), need, np.ones(len(at), np.int64)))
        return _distinct_pairs(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.int64))

    kinds = [("x", pa.int64()), ("y", pa.int64()), ("need", pa.int32()), ("times", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("p", pa.int32())]

    def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds], [c for c, _ in kinds])

    def told(s: np.ndarray, rid: np.ndarray, n: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, which, count = np.unique(s, return_inverse=True, return_counts=True)
        k = count[which]
        few, many = (k > 1) & (k <= small), k > small
        x, y, need, times = pairs(s[few], rid[few], n[few], p[few])
        if len(x):
            yield batch_of(x=x, y=y, need=need, times=times)
        if many.any():
            yield batch_of(s=s[many], x=rid[many], n=n[many], p=p[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.int32))
        held, crowded = none, None
        for batch in batches:
            own = tuple(np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            if crowded is not None:  # the shingle before was handed on, and may go on
                end = int(np.searchsorted(own[0], crowded, side="right"))
                if end:
                    yield batch_of(**dict(zip(("s", "x", "n", "p"), (c[:end] for c in own), strict=True)))
                own = tuple(c[end:] for c in own)
            held = own
            if not len(own[0]):
                continue
            last = int(np.searchsorted(own[0], own[0][-1]))  # its rows may go on
            if last:
                yield from told(*(c[:last] for c in own))
            held, crowded = tuple(c[last:] for c in own), None
            if len(held[0]) > small:
                crowded = held[0][-1]
                yield batch_of(**dict(zip(("s", "x", "n", "p"), held, strict=True)))
                held = none
        if len(held[0]):
            yield from told(*held)

    ordered = rows.select("s", "_rid", "n", "p").repartition("s").sortWithinPartitions("s")
    return ordered.mapInArrow(run, "x long, y long, need int, times long, s long, n int, p int")


def _spanning(near: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph ``near``, whose nodes of equal ``root`` are joined already: breadth first, each step over those not yet reached."""
    _, root = np.unique(root, return_inverse=True)
    left, a, b = near.any(axis=1), [], []
    while left.any():
        queue = [int(np.argmax(left))]
        left[queue] = False
        joined = {root[queue[0]]}
        while queue:
            x = queue.pop()
            hit = np.flatnonzero(left & (near[x] | (root == root[x])))
            left[hit] = False
            queue.extend(hit.tolist())
            new = {root[y]: y for y in hit if root[y] not in joined}
            joined.update(new)
            a.extend([x] * len(new))
            b.extend(new.values())
    return np.array(a, int), np.array(b, int)


def _block_links(rows: DataFrame, least: float, columns: int = 1 << 14) -> DataFrame:
    """a, b: pairs with a similarity of ``least`` or more among a shingle's texts (s, _rid, root, part, parts, set), as many as connect what all such pairs of two parts would.

    What texts of two parts share is counted on bits, for ``columns`` shingles of their
    whole sets at a time, so pairs that aren't similar are never rows.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, root, part = (table.column(c).to_numpy() for c in ("_rid", "root", "part"))
        sets = [unpack_set(x.as_py()) for x in table.column("set")]
        n = np.array([len(x) for x in sets], float)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, many = np.repeat(np.arange(len(rid)), n.astype(int)), count[code] > 1
        row, code = row[many], (np.cumsum(count > 1) - 1)[code[many]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        u, v = key[1].as_py(), key[2].as_py()
        x, y = np.flatnonzero(part == u), np.flatnonzero(part == v)
        both = np.zeros((len(x), len(y)), np.int32)
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
            own = slice(*np.searchsorted(code, [start, start + columns]))
            at = code[own] - start
            bits = np.zeros((len(rid), at.max() // 64 + 1), U)
            np.bitwise_or.at(bits, (row[own], at // 64), U(1) << (at % 64).astype(U))
            there = bits[y]
            for k, i in enumerate(x):
                both[k] += np.bitwise_count(there & bits[i]).sum(axis=1, dtype=np.int32)
        near = np.zeros((len(rid), len(rid)), bool)
        for k, i in enumerate(x):
            similar = (both[k] >= least * (n[i] + n[y] - both[k]) - 1e-9) & (root[i] != root[y])
            near[i, y] |= similar
            near[y, i] |= similar
        a, b = _spanning(near, root)
        return pa.table({"a": rid[a], "b": rid[b]})

    # A text of part p meets each part q once, as the lower or the higher one.
    other = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = other.select("s", F.least("part", "_q").alias("u"), F.greatest("part", "_q").alias("v"), "part", "_rid", "root", "set")
    return met.groupBy("s", "u", "v").applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs (x, y) whose sets have a similarity of ``least`` or more.

    Bucket counts, about a tenth of the sets, bound the overlap of a pair first; only what
    they leave open brings the sets together.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for nx, ny, cx, cy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                most = overlap_bound(cx.as_py(), cy.as_py())
                ok.append(most is None or most >= least * (nx + ny - most) - 1e-6)
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpack_set(a.as_py()), unpack_set(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    asked = materialise(pairs.select(F.explode(F.array("x", "y")).alias("_rid")).distinct(), "asked")
    sets = with_ids(sets, asked, "_rid")

    def beside(rows: DataFrame, columns: list[str]) -> DataFrame:
        own = lambda k: sets.select(F.col("_rid").alias(k), *(F.col(c).alias(f"{c}{k}") for c in columns))
        return rows.join(own("x"), "x").join(own("y"), "y")

    left = beside(pairs, ["n", "c"]).select("x", "y", "nx", "ny", "cx", "cy").mapInArrow(possible, "x long, y long")
    return materialise(beside(left, ["s"]).select(F.col("x").alias("a"), F.col("y").alias("b"), "sx", "sy").mapInArrow(similar, "a long, b long"), "similar")


def fingerprint_pairs(sets: DataFrame, distance: int) -> DataFrame:
    """x, y: pairs of texts whose fingerprints are equal or linked (``links``); of texts with one fingerprint each meets the first."""
    firsts = sets.where("n > 0").groupBy("_fp").agg(F.min("_rid").alias("_first"))
    firsts = materialise(firsts, "fingerprints")
    same = sets.where("n > 0").join(firsts, "_fp").where("_rid <> _first").select(F.col("_first").alias("x"), F.col("_rid").alias("y"))
    of = lambda k: firsts.select(F.col("_fp").alias(k), F.col("_first").alias(f"_{k}"))
    near = links(firsts.select("_fp"), distance).join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y"))
    return same.unionByName(near).distinct()


def similar_pairs(sets: DataFrame, least: float = 0.8, small: int = 192, block: int = 2048, distance: int = 3) -> DataFrame:
    """a, b: pairs of ``sets`` with a similarity of ``least`` or more that connect exactly what all such pairs would.

    First come the pairs that SimHash fingerprints within ``distance`` bits propose, and
    those of each shingle with more than ``small`` texts with the one most of whose prefix
    is in such shingles. The rest is exact: candidates share as many shingles of their
    prefixes (``prefixes``) as they must (``least_shared``), so none is missed, and all
    that are in different components by then are verified; texts of a shingle with more
    than ``small`` meet in blocks of about ``block``, which give links only.
    """
    met = materialise(meetings(prefixes(sets, least), least, small), "meetings")
    # If any shingle that a pair shares is crowded, the blocks below find it; else all it shares are here, the first one with room.
    few = met.where("y IS NOT NULL").groupBy("x", "y").agg(F.sum("times").alias("_n"), F.min("need").alias("_need"))
    enough = few.where("_n >= _need").select("x", "y")
    many = met.where("y IS NULL").select(F.col("x").alias("_rid"), "n", "s", "p").withColumn("k", F.count("*").over(W.partitionBy("s")))
    crowded = not many.isEmpty()

    proposed = fingerprint_pairs(sets, distance)
    if crowded:
        many = materialise(many, "crowded")
        heat = many.groupBy("_rid").agg((F.sum("k") / F.first("n")).alias("heat"))
        leaders = many.join(heat, "_rid").groupBy("s").agg(F.max(F.struct("heat", "_rid")).alias("m")).select("s", F.col("m._rid").alias("y"))
        led = many.join(leaders, "s").where("_rid <> y").select(F.least("_rid", "y").alias("x"), F.greatest("_rid", "y").alias("y"))
        proposed = proposed.unionByName(led).distinct()
    near = verified(materialise(proposed, "proposed-pairs"), sets, least)
    found = components(near).select("node", "root")

    def apart(rows: DataFrame, key: str, root: str) -> DataFrame:
        """``rows`` with the component of the text ``key`` so far."""
        return rows.join(found.select(F.col("node").alias(key), F.col("root").alias(root)), key, "left").withColumn(root, F.coalesce(root, key))

    rest = apart(apart(enough, "x", "_rx"), "y", "_ry").where("_rx <> _ry").select("x", "y")
    if crowded:
        rooted = apart(many, "_rid", "root")
        mixed = rooted.groupBy("s").agg(F.min("root").alias("_l"), F.max("root").alias("_m")).where("_l < _m").select("s")
        parts = F.greatest(F.ceil(F.col("k") / block), F.lit(1)).cast("int")
        parted = rooted.join(mixed, "s").select("s", "_rid", "root", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("_rid"), F.col("parts")).cast("int"))
        parted = materialise(parted, "crowded-shingles")
        busy = materialise(parted.select("_rid").distinct(), "busy")
        own = with_ids(sets, busy, "_rid").select("_rid", F.col("s").alias("set"))
        near = near.unionByName(materialise(_block_links(parted.join(own, "_rid"), least), "block-links"))
    return near.unionByName(verified(materialise(rest, "rest-pairs"), sets, least))


def keep_first(docs: DataFrame, size: int = 5, least: float = 0.8, small: int = 192, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id.

    Texts that are equal but for A-Z case and white space are one. Two texts are linked if
    their sets of ``size``-word shingles have a similarity of ``least`` or more; groups are
    what links connect. SimHash fingerprints propose links first, and an exact search
    finds those they miss (``similar_pairs``).
    Null ids come last, and of repeated rows one stays. Null and empty texts are one text.
    Texts of any length are taken whole; other columns, whatever their names, are kept; an
    empty table stays empty.
    """
    docs, restore = protect(docs, ["doc_id", "text"])
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.StringType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.md5(b" ".join((t.as_py() or "").encode().lower().split())).hexdigest() for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.append_column("_key", pa.array(keys, pa.string()))

    marked = materialise(docs.mapInArrow(mark, schema).withColumn("_rid", F.monotonically_increasing_id()), "marked")
    # From here on a text stands for all its copies: a partial sum meets them before any shuffle.
    least_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid"))
    texts = materialise(marked.groupBy("_key").agg(least_id.alias("_m")).select("_m.*"), "texts")
    sets = materialise(shingle_sets(with_ids(marked.select("_rid", "text"), texts, "_rid"), size), "shingle-sets")
    roots = components(similar_pairs(sets, least, small, distance=distance)).select(F.col("node").alias("_rid"), F.col("root").alias("_root"))

    rooted = texts.join(roots, "_rid", "left").withColumn("_root", F.coalesce("_root", "_rid"))
    first = rooted.groupBy("_root").agg(F.min(F.struct("none", "doc_id", "_rid")).alias("m")).select("m._rid")
    return restore(with_ids(marked, materialise(first, "firsts"), "_rid"))


def group_fingerprints(marked: DataFrame, distance: int = 3, cap: int = 4096) -> DataFrame:
    """_fp, _n (rows), _root, component_id for the fingerprints of ``marked`` (doc_id, _fp).

    component_id is the smallest doc_id that any chain of links reaches.
    """
    distinct = materialise(marked.groupBy("_fp").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")), "fingerprints")
    found = components(links(distinct.select("_fp"), distance, cap))
    rooted = distinct.join(found.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_n", F.coalesce("root", "_fp").alias("_root"), "_first")
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rooted.join(least, "_root").select("_fp", "_n", "_root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, cap: int = 4096) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; texts of any
    length are read whole, each in the task that holds its row. Repeated
    rows stay and share a component. Null ids stay; a component of null ids only has a
    null component_id. Other columns are ignored; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs.select(docs["doc_id"].cast("long"), "text"), size).select("doc_id", "_fp"), "marked")
    groups = materialise(group_fingerprints(marked, distance, cap).drop("_root"), "groups")
    return join_hot(marked, groups, ["_fp"], "_n").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
