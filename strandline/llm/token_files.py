"""Token ids in wavelet-matrix shard files, in the order of doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import wavelet
from strandline.llm.common import materialise
from strandline.llm.files import dealt, get, put
from strandline.llm.pieces import chunks, encoder

MANIFEST = "name string, task int, seq int, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shard_ids: int = 1 << 21) -> DataFrame:
    """Encode each text, append ``end_id``, and write shard files to ``folder``; returns their manifest.

    Documents are sorted by doc_id (null first, ties by text) over range partitions; a
    task begins a new file once it has ``shard_ids`` ids, between two documents. The
    manifest is a written table: name, task and seq (their order is that of the
    documents), n_docs, n_ids, n_bytes. A null text is empty and has only its end id.
    Repeated rows are written each, a long text is one document, other columns are
    ignored; an empty table gives an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(len(enc.marks) - 1, end_id).bit_length()
        held, names, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            data = wavelet.dump(ids, names, lengths, bits)
            name = f"{task:07d}-{seq:07d}.wm"
            put(folder, name, data)
            return pa.RecordBatch.from_pylist([{"name": name, "task": task, "seq": seq, "n_docs": len(names), "n_ids": len(ids), "n_bytes": len(data)}], schema=schema)

        schema = pa.schema([("name", pa.string()), ("task", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
        for batch in batches:
            for part, texts in chunks(batch, "text", 4 << 20):
                n, ids = enc.encode(texts)
                ends = np.cumsum(n)
                ids = np.insert(ids.astype(np.uint16 if bits <= 16 else np.uint32), ends, end_id)
                doc_ids, n = part.column(0).to_pylist(), n + 1
                ends, at = np.cumsum(n), 0
                while at < len(n):  # as many documents as the file still takes, one at least
                    begin = ends[at] - n[at]
                    to = max(at + 1, int(np.searchsorted(ends, begin + shard_ids - total, side="right")))
                    held.append(ids[begin : ends[to - 1]])
                    sizes.append(n[at:to])
                    names += doc_ids[at:to]
                    total += int(ends[to - 1] - begin)
                    at = to
                    if total >= shard_ids or at < len(n):
                        yield flush()
                        held, names, sizes, total, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    ordered = docs.select(docs["doc_id"].cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """name and base, the ids of all files before: running totals of tasks, then within a task."""
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("_n"))
    tasks = tasks.select("task", (F.sum("_n").over(W.orderBy("task")) - F.col("_n")).alias("_base"))
    inside = F.sum("n_ids").over(W.partitionBy("task").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("_in", inside).join(tasks, "task").select("name", (F.col("_base") + F.col("_in")).alias("base"))


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    Only files of the manifest are read; one that is missing, of another size or damaged
    is an error. An empty manifest gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_bytes, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix, doc_ids, lengths = wavelet.load(get(folder, name, n_bytes))
                ids = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.join(shard_starts(manifest), "name").select("name", "n_bytes", "base")
    return dealt(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
