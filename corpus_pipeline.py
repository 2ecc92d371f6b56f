"""A cleaning pipeline over `documents`, each stage working on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontamination, exact_dedup, packing, simhash, toxicity
from stratalog.llm.common import documents, materialise, table
from stratalog.llm.queries import tokenizer_file


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of the documents of this stage.

    Null and empty texts stay; repeated rows go or stay together; rows with a null id are scored and never learnt from. An
    empty table gives an empty one. All columns are kept, whatever their names.
    """
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest in its original form, then the smallest id, a null id last.

    Null texts are empty, and empty and blank texts are one group, of which one stays. Of repeated rows one stays. An
    empty table gives an empty one. All columns are kept, whatever their names.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays: that of the smallest id; see `simhash.drop_near_duplicates`.

    Null texts are empty; texts without words are near each other. Of rows repeated under that id one stays. An empty table
    gives an empty one. All columns are kept, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, with all rows of their id; rows with a null id stay, and so do null and empty texts.

    Null and empty items are in no document. An empty table gives an empty one. All columns are kept, whatever their names.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences; see `packing.pack_documents`.

    Null texts are empty and give the end id alone; repeated rows are packed each; a null id stays null; an empty table
    gives an empty one. Other columns are not read.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("simhash near-dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("best-fit packing", stage_packing),
]

#: Word automata, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
