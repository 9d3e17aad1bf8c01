"""A corpus from raw documents to tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe, jaccard, linededup, mixing, quality
from driftloom.llm.common import documents, stored
from driftloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Callable[[DataFrame], DataFrame]) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(docs)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stage(quality.clean)),
    ("line_dedup", stage(linededup.clean)),
    ("near_duplicates", stage(jaccard.distinct_documents)),
    ("source_mixing", stage(mixing.mixed)),
    ("bpe_tokens", stage(bpe.encode)),
]

#: The near-duplicate and BPE stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tokens: the rows that all stages keep, with a column ids; each stage is stored before the next."""
    docs = documents(spark, sf_dir)
    for i, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
