"""A corpus pipeline of five operators: each stage works on what its predecessor kept.

Null, empty and repeated rows, extra columns and empty tables are handled as the operators' docstrings
say. Between stages the rows are written as Parquet and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, mixing, simhash, toxicity
from tessera.llm.common import materialize, read_table
from tessera.llm.queries import VOCABULARY


def decide(docs: DataFrame, outputs: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, back to the columns of ``docs``: own columns named like ``outputs`` stay as they were."""
    hidden = {c: f"__own_{c}" for c in docs.columns if c in outputs}
    found = stage(docs.withColumnsRenamed(hidden))
    return found.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model fitted on all labels."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return decide(docs, ("score", "predicted"), lambda d: toxicity.score(d, model).filter("predicted = 0"))


def drop_unrecognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; texts without a letter or in another language go."""
    model = language.train(docs, F.lit(True))
    return decide(docs, ("lang_pred", "score", "recognised"), lambda d: language.identify(d, model).filter("recognised"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the source mix takes them: a document may go or repeat."""
    return decide(docs, mixing.OUTPUTS, lambda d: mixing.emit(mixing.mix_sources(d)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    return bpe.encode_decode(docs, VOCABULARY).select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unrecognised),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("bpe", tokenize),
]

#: A learned model, an automaton and hash joins decide: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
