"""From raw documents to tokens: five stages, each on all that the one before has kept.

Defined results, of every stage: a null text counts as empty and is neither near another nor contaminated; rows with the same doc_id are told
apart by their text, and rows equal in both count as one from the dedup stages on; ties go to the smallest doc_id, null last; texts of any
length are read whole; an empty table gives an empty table. Further columns pass through all stages; in the last one a column that has
the name of one of its results (`ADDED`) gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caudal.llm.bpe import encode, tokenizer_path
from caudal.llm.decontaminate import without_benchmark
from caudal.llm.exact import drop_exact_duplicates
from caudal.llm.jaccard import Rule, one_of_each
from caudal.llm.quality import quality_scores
from caudal.llm.tables import discard, settled, table

ADDED = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
NEAR = Rule(shingle=5, percent=80)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one stays."""
    return one_of_each(docs, NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    own = [f"doc.`{c}`" for c in docs.columns if c.lower() not in ADDED]
    return encode(docs, tokenizer_path(), with_ids=True).select(*own, *ADDED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("BPE", tokens),
]

# No SQL: the classifier, the edit-distance search and BPE have none. The tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder, read by the next and then deleted."""
    docs, own = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if own:  # never the given table
            discard(before)
        own = True
    return STAGES[-1][1](spark, docs, sf_dir)
