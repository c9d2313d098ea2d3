"""A training-data pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, cluster, mixing, near_dedup, suffix_dedup, toxicity
from tessella.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; all others stay as they are."""
    chain = toxicity.train(docs, cluster.table(spark, sf_dir, "labels"))
    names = ("__tsl_toxicity", "__tsl_toxic", "__tsl_categories")
    return toxicity.score(docs, chain, keep=tuple(docs.columns), names=names).where("not __tsl_toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) one document stays."""
    return near_dedup.deduplicated(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out of the texts."""
    return suffix_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their target shares."""
    return mixing.mixed(docs, max_epochs=3, seed=0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, tokenizer_file(), keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Classifiers, sketches and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = cluster.stage(step(spark, docs, sf_dir), name)
    return docs
