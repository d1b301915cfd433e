"""Lexical retrieval packing: fill token windows with documents that resemble their seed.

Texts are encoded once into a written table. Document frequencies of tokens, counted
over all documents, number as many as the vocabulary, so they are shared with all tasks.
Documents are sorted by the least hash of their token triples (their place), which puts
copies and close texts side by side, and each stretch of that order with ``shard_tokens``
tokens is a shard with a BM25 inverted index of its own, over all of its tokens. A place
that more than a thousandth of all documents share counts as one document in the
frequencies, so that a large group of copies doesn't make its own tokens look common.

In a shard, a window begins with a seed document. While it has room, the index returns
the unused documents that match the seed best, and these fill it in turn; one that does
not fit is cut, and its rest seeds the next window. So all windows are full but the last
of a shard, and that one is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialise
from strandline.llm.pieces import chunks, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
U = np.uint64


def triple_hashes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least hash of three neighbouring ids in each document; ``ends`` where each one ends, none empty."""
    one = np.append(ids[1:], 0).astype(U)
    one[ends - 1] = 0
    two = np.append(one[1:], U(0))
    two[ends - 1] = 0
    h = (ids.astype(U) + U(1)) * U(0x9E3779B97F4A7C15) ^ (one + U(1)) * U(0xC2B2AE3D27D4EB4F) ^ (two + U(1)) * U(0x165667B19E3779F9)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return np.minimum.reduceat(h ^ (h >> U(32)), np.concatenate(([0], ends[:-1])))


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (as bytes, two or four for an id) and place (where the document sorts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = np.dtype("<u2") if max(len(enc.marks), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for part, texts in chunks(batch, "text", 4 << 20):
                n, ids = enc.encode(texts)
                ids = np.insert(ids.astype(kind), np.cumsum(n), end_id)
                ends = np.cumsum(n + 1)
                place = triple_hashes(ids, ends).view(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends * kind.itemsize)).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), data.cast(pa.binary()), pa.array(place)], ["doc_id", "ids", "place"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, place long")


def crowded_places(encoded: DataFrame, part: int = 1000) -> dict[int, int]:
    """Places that more than one in ``part`` documents share, fewer than ``part`` therefore, and how many share each."""
    per = encoded.groupBy("place").agg(F.count("*").alias("n"))
    least = encoded.count() // part
    return {r["place"]: r["n"] for r in per.where(F.col("n") > F.lit(max(least, 1))).collect()}


def document_frequencies(encoded: DataFrame, vocabulary: int, width: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each token stands, the number of documents and of tokens, over all of them.

    Documents of a crowded place weigh one together, in whole millionths.
    """
    crowded, unit = crowded_places(encoded), 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary + 2, np.int64)  # the last two: documents and tokens
        for batch in batches:
            for x, place in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(x.as_buffer(), f"<u{width}")
                seen = np.unique(ids)
                weight = unit // crowded[place] if place in crowded else unit
                total[seen] += weight
                total[-2:] += (weight, len(ids))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    rows = encoded.select("ids", "place").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary + 2, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out[:-2] / unit, out[-2] / unit, int(out[-1])


class ShardIndex:
    """A BM25 inverted index of a shard's documents.

    A document's query is its ``terms`` strongest tokens (of the highest BM25 weight in it).
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: float, mean: float, terms: int = 64, k1: float = 1.2, b: float = 0.75):
        idf = np.log1p((np.maximum(n_docs - df, 0) + 0.5) / (df + 0.5))
        self.n, self.terms = len(docs), terms
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        own = np.repeat(np.arange(len(docs)), lengths)
        code = np.sort(np.concatenate(docs).astype(np.int64) * len(docs) + own)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        tf = np.diff(first, append=len(code))
        self.term, self.docs = np.divmod(code[first], len(docs))
        self.weights = np.maximum(idf[self.term], 1e-6) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[self.docs] / mean))
        self.starts = np.searchsorted(self.term, np.arange(len(df) + 1))
        self.of_doc = np.argsort(self.docs.astype(np.uint32), kind="stable")
        self.at = np.searchsorted(self.docs[self.of_doc], np.arange(len(docs) + 1))
        self.used = np.zeros(len(docs), bool)
        self.next = 0

    def query(self, doc: int) -> np.ndarray:
        """The strongest tokens of a document, ties to the smaller id."""
        own = self.of_doc[self.at[doc] : self.at[doc + 1]]
        return self.term[own[np.argsort(-self.weights[own], kind="stable")[: self.terms]]]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of each document for the query of one."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.query(doc)]
        return np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)

    def neighbours(self, seed: int, most: int = 16) -> Iterator[int]:
        """All unused documents: those that match, best first, looked up ``most`` at a time, then those next in order."""
        while True:
            score = self.scores(seed)
            score[self.used] = 0
            hits = np.flatnonzero(score)
            if not len(hits):
                break
            if len(hits) > most:
                edge = np.partition(score[hits], len(hits) - most)[len(hits) - most]
                hits = hits[score[hits] >= edge]
            best = hits[np.lexsort((hits, -score[hits]))][:most]
            yield from best.tolist()
            if not self.used[best].all():
                return  # the caller passed some by
        while (doc := self.first_unused()) is not None:
            yield doc

    def first_unused(self) -> int | None:
        while self.next < self.n and self.used[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None


def pack_shard(docs: list[np.ndarray], index: ShardIndex, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length)."""
    seed, at = index.first_unused(), 0
    while seed is not None:
        index.used[seed] = True
        now, room = [], window
        doc, found = seed, None
        while doc is not None and room:
            index.used[doc] = True
            n = min(room, len(docs[doc]) - at)
            now.append((doc, at, n))
            room -= n
            at += n
            if at < len(docs[doc]):
                break  # the window is full, and this document seeds the next
            found = found or index.neighbours(seed)
            doc, at = next((d for d in found if not index.used[d]), None), 0
        if room:
            yield from powers_of_two(now)
        else:
            yield now
        seed = doc


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut pieces into sequences whose lengths are powers of two, the longest first."""
    left = sum(n for _, _, n in pieces)
    todo = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, at, n = todo.pop()
            take = min(n, room)
            out.append((doc, at, take))
            room -= take
            if take < n:
                todo.append((doc, at + take, n - take))
        yield out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shard_tokens: int = 2 << 20, shard_docs: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Each document's ids, with ``end_id`` after them, lie in exactly one piece each; a
    piece is ids start to start + length - 1 of its document, at ``offset`` of its
    sequence. ids_crc32 is of the piece's ids as little-endian unsigned 32-bit integers.
    A null text is empty and has only its end id. Repeated rows are packed each, null ids
    stay, other columns are ignored; an empty table gives no pieces. A text of any length
    is encoded whole, in chunks, and cut into as many windows as its ids fill.
    """
    encoded = materialise(encode(docs, tokenizer, end_id), "encoded", compression="zstd")
    vocabulary = max(len(encoder(tokenizer).marks), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    df, n_docs, n_tokens = document_frequencies(encoded, vocabulary, width)
    shared = docs.sparkSession.sparkContext.broadcast(df)  # one number for each token of the vocabulary
    mean = n_tokens / max(n_docs, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sequence = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            for pieces in pack_shard(held, ShardIndex(held, shared.value, n_docs, mean), window):
                offset = 0
                for doc, at, n in pieces:
                    rows.append((names[doc], at, n, zlib.crc32(held[doc][at : at + n].astype("<u4").tobytes()), len(held[doc]), (task << 40) + sequence, offset))
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(np.frombuffer(x.as_py(), f"<u{width}"))
                tokens += len(held[-1])
                if tokens >= shard_tokens or len(held) >= shard_docs:
                    yield flush()
                    names, held, tokens = [], [], 0
        if held:
            yield flush()

    ordered = encoded.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES)
