"""From raw documents to token files: each stage's result is written and read again as the next one's documents.

Defined results: null, empty and wordless texts have a quality score like any other, are copies of nothing and hold no benchmark item; rows without
doc_id are no copies of each other; repeated doc_ids are one document to near-dedup, which keeps one row; a stage that leaves no row gives the next an empty table; further columns,
whatever their names, come through to the token files, which hold ids only; scores of exactly 0.5 are accepted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, mixing, near_dedup, quality, token_files
from gridloom.llm._shared import shared_folder, stored
from gridloom.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All domains are told apart. Junk has no target: the quality stage has removed it, and a share of what is left could only be met by repeating the few,
#: mostly tiny documents of it that came through (with a target of 4 % they became 100 times as many rows as there were documents).
MIX = mixing.MixConfig(targets={"clean": 0.98, "toxic": 0.02}, margin=1.0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labelled rows among them."""
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs, near_dedup.NearDedupConfig(percent=80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: clean ones whole, toxic ones thinned or repeated to their target, junk as it is."""
    return mixing.mixed(docs, _table(spark, sf_dir, "labels"), MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: a row for each document."""
    folder = shared_folder(spark, "token-files")
    shards = token_files.write_shards(docs, folder, token_files.TokenFileConfig(tokenizer_path(), end_id=1))
    return token_files.read_shards(spark, folder, shards)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: The classifiers and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
