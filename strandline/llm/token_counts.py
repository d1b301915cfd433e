"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.pieces import chunks, encoder


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Texts are encoded in Arrow batches that hold about equal bytes, long texts cut where
    the tokenizer cuts in any case, and only lengths leave the worker. A null text is
    empty and has no tokens; special tokens in a text count as the library takes them by
    default. Repeated rows stay, null ids stay, other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                n, _ = enc.encode(texts, ids=False)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
