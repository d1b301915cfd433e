"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample of
rows that a hash picks (``train_rows``); every row is then indexed: its list, and one
code per subspace of its residual. There are about half as many lists as the square root
of the rows, and one for 16 rows of the sample at most. A query visits its nearest lists, sums the entries of
its distance tables by the codes there, and the best by that estimate are reranked by
exact distance on the original vectors.

How many lists a query visits is fitted too: the fewest that hold ``reach`` of the true
neighbours of sample rows within the sample. Data in clusters need few; data without
structure need most of the lists.

Lists are dealt to blocks of bounded size, and so are the queries of a list, so a list
that holds a third of all rows is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import materialise


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vec (doubles): rows with an id and a finite, non-zero vector of the most common length (the largest of equally common ones)."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    out = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = out.where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
    size = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return out.where(F.size("vec") == (size["n"] if size else 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from the first k distinct rows; an empty cluster keeps its centre."""
    centres = np.unique(x[: 16 * k], axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """What is fitted: centres, codebooks (subspace, code, dimension) and the share of lists to visit."""

    def __init__(self, sample: np.ndarray, lists: int, width: int = 2, codes: int = 256, k: int = 10, reach: float = 0.985):
        self.centres = _kmeans(sample, lists)
        near = _nearest(sample, self.centres)
        self.dims = [np.arange(i, min(i + width, sample.shape[1])) for i in range(0, sample.shape[1], width)]
        residual = sample - self.centres[near]
        self.books = [_kmeans(residual[:8192, d], codes, 4) for d in self.dims]
        self.visits = self._fit_visits(sample, near, k, reach)

    def _fit_visits(self, sample: np.ndarray, near: np.ndarray, k: int, reach: float) -> int:
        """Lists that hold ``reach`` of the neighbours of 512 sample rows."""
        q = sample[:512]
        d = (sample**2).sum(axis=1)[None] - 2 * q @ sample.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centres)
        truth = near[np.argpartition(d, k - 1, axis=1)[:, :k]]
        order = np.argsort((self.centres**2).sum(axis=1)[None] - 2 * q @ self.centres.T, axis=1)
        place = np.argsort(order, axis=1)[np.arange(len(q))[:, None], truth]
        return int(np.quantile(place, reach, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _nearest(x, self.centres)
        residual = x - self.centres[near]
        return near, np.stack([_nearest(residual[:, d], b).astype(np.uint8) for d, b in zip(self.dims, self.books, strict=True)], axis=1)

    def estimates(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (query, row) of queries to coded rows of a list: each query's table of a subspace is made once and read by all rows."""
        residual = queries - self.centres[which]
        out = np.zeros((len(queries), len(codes)))
        for s, (d, b) in enumerate(zip(self.dims, self.books, strict=True)):
            table = ((residual[:, None, d] - b[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, s]]
        return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_neighbours(rows: DataFrame, every: int, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", train_rows: int = 65_536, rerank: int = 300, block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``every``.

    score is the Euclidean distance of the original vectors in double precision; nearest
    first, ties to the smaller id. Rows with a query's own id are not its candidates. Rows
    with a null id, a null, zero or non-finite vector, or one of another length than most,
    take no part; other columns are ignored. With fewer than k candidates in the lists a
    query would visit, it visits more. Repeated rows are found as often as they are there;
    where rows of a query's id differ, the query is the least vector, so reruns agree. An
    empty table, or one without usable rows, gives no rows.
    """
    spark = rows.sparkSession
    vectors = materialise(valid_vectors(rows, id_column, vector_column), "vectors")
    n = vectors.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    step = max(1, n // train_rows)
    picked = vectors.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(step)) == 0) if step > 1 else vectors
    sample = picked.orderBy(F.xxhash64(F.lit(6), "id"), "id").select("vec").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = vectors.limit(1).select("vec").toArrow().column(0).combine_chunks()
    dim = len(sample[0])
    fitted = spark.sparkContext.broadcast(Index(sample.flatten().to_numpy().reshape(-1, dim), max(1, min(round(n**0.5 / 2), len(sample) // 16)), k=k))  # bounded by train_rows

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, codes = fitted.value.encode(_matrix(batch, "vec"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "code"])

    coded = materialise(vectors.mapInArrow(index, "id long, list int, code binary"), "index")
    sizes = dict(coded.groupBy("list").count().collect())  # a row for each list, at most a sixteenth of train_rows

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, least = fitted.value.centres, fitted.value.visits
        held = np.array([sizes.get(i, 0) for i in range(len(centres))])
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort((centres**2).sum(axis=1)[None] - 2 * _matrix(batch, "vec") @ centres.T, axis=1)
            # as many lists as fitted, and then until there are enough rows besides repeats of the query
            enough = (np.cumsum(held[order], axis=1) < 4 * k + 1).sum(axis=1) + 1
            lists = [o[: max(least, e)].astype(np.int32) for o, e in zip(order, enough, strict=True)]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(lists))], ["query_id", "vec", "list"])

    queries = materialise(vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    visits = materialise(queries.mapInArrow(visit, "query_id long, vec array<double>, list int"), "visits")
    asked = dict(visits.groupBy("list").count().collect())
    dealt = spark.createDataFrame([(i, -(-sizes[i] // block_rows), -(-asked.get(i, 0) // block_queries)) for i in sizes], "list int, blocks int, asks int")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    ask = F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int").alias("ask")
    left = coded.join(dealt.where("asks > 0"), "list").select("list", block, F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "id", "code")
    right = visits.join(dealt, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), ask, "query_id", "vec")

    def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows, asks = rows.sort_values("id"), asks.sort_values("query_id")
            ids, codes = rows["id"].to_numpy(), np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            which = int(rows["list"].iloc[0])
            for at in range(0, len(asks), 128):
                some = asks.iloc[at : at + 128]
                names = some["query_id"].to_numpy()
                d = fitted.value.estimates(np.stack(some["vec"].to_numpy()), which, codes)
                d[ids[None] == names[:, None]] = np.inf
                # the best of each, and of those that tie with the last one those with the smallest ids
                if len(ids) > rerank:
                    edge = np.partition(d, rerank - 1, axis=1)[:, rerank - 1, None]
                    tied = d == edge
                    room = rerank - (d < edge).sum(axis=1, keepdims=True)
                    kept = (d < edge) | (tied & (np.cumsum(tied, axis=1) <= room))
                else:
                    kept = np.ones(d.shape, bool)
                q, r = np.nonzero(kept & np.isfinite(d))
                out.append(pd.DataFrame({"query_id": names[q], "id": ids[r], "estimate": d[q, r]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "estimate": pd.Series(dtype="float64")})

    key = ["list", "block", "ask"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, "query_id long, id long, estimate double")
    best = found.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("estimate", "id"))).where(F.col("_n") <= rerank).select("query_id", "id").distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(((_matrix(batch, "vec") - _matrix(batch, "asked")) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query_id", "vec_id", "score"])

    pairs = best.join(vectors, "id").join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("asked")), "query_id").select("query_id", F.col("id").alias("vec_id"), "vec", "asked")
    scored = pairs.mapInArrow(measure, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
