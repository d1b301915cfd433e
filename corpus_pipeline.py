"""A corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All
but the last return the columns of ``documents``. As its input has been written, a stage but the
first begins by removing what the stages before it left in the shared folder, other than its input.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import kneser_ney, mixing, packing, quality_rules, simhash
from strandline.llm.common import materialise, noted, remove, table
from strandline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is far beyond that of trusted text of their language."""
    return kneser_ney.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target weights."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into windows."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


#: What the stages of a run have left in the shared folder; a run's thread has its own.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("_LEFT", default=())


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame], first: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with the tables of the stages before it removed."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = [] if first else list(_LEFT.get())
        remove(spark, left, docs)
        with noted() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.set((*left, *made))
        return out

    return run


STAGES = [
    ("quality_rules", tidy(quality, first=True)),
    ("quality_classifier", tidy(classifier)),
    ("near_dedup", tidy(near_dedup)),
    ("mixing", tidy(mix)),
    ("packing", tidy(pack)),
]

#: Fingerprints, permutations and token ids aren't SQL; ``tests/llm`` holds each stage's operator against brute force, and the chain against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        with noted() as made:
            docs = materialise(rows, f"stage-{name}")
        _LEFT.set((*_LEFT.get(), *made))
    return STAGES[-1][1](spark, docs, sf_dir)
