"""Exact dedup by a heavy-hitter split.

Texts are the same when they agree after every run of white space becomes one space; they are compared by SHA-256.
Digests that many rows share are found by Misra-Gries summaries of the partitions, counted exactly (the verified
winners) and removed map-side by a broadcast of at most `counters` rows. All other digests are grouped by an ordinary
shuffle, in which no group can be larger than three `counters`-ths of the rows.

Defined results: a null text counts as empty; a null doc_id comes after every number; of repeated rows (same doc_id,
same text) exactly one stays; an empty table gives an empty table; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import WHITE, numbered, settled

COUNTERS = 1024


def text_digest(text: str | F.Column) -> F.Column:
    """SHA-256 (binary) of the text after white space is folded; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(column, F.lit("")), WHITE, " "), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One summary of a partition's digests. A counter is too low by at most rows / (counters + 1); those no higher than
    that are left out, so that a partition without frequent digests sends nothing."""
    summary: Counter = Counter()
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for pair in pc.value_counts(batch.column(0)).to_pylist():
            summary[pair["values"]] += pair["counts"]
        if len(summary) > counters:
            cut = sorted(summary.values(), reverse=True)[counters]
            summary = Counter({k: v - cut for k, v in summary.items() if v > cut})
    kept = {k: v for k, v in summary.items() if v * (counters + 1) > rows}
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.binary()), "least": pa.array(list(kept.values()), pa.int64())})


def group_summary(keyed: DataFrame) -> DataFrame:
    """For each digest the row that stays (smallest doc_id, then row number) and the number of rows."""
    return keyed.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("stays"),
        F.count(F.lit(1)).alias("group_size"),
    )


def exact_groups(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """`keyed`: settled rows of (row, doc_id, digest). Adds keep_id, group_size and kept to each row."""
    rows = keyed.count()
    summaries = keyed.select("digest").mapInArrow(lambda batches: misra_gries(batches, counters), "digest binary, least long")
    # The sums of all counters are at most `rows`, so at most `counters` digests can pass: the bound of the broadcast.
    frequent = summaries.groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") * (counters + 1) > F.lit(rows)).select("digest")
    winners = settled(group_summary(keyed.join(F.broadcast(frequent), "digest")), "exact-winners").where("group_size > 1")
    heavy = keyed.join(F.broadcast(winners), "digest")
    light = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    both = heavy.unionByName(light.join(group_summary(light), "digest"))
    return both.select(
        "row", "doc_id", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = settled(numbered(docs.select("doc_id", text_digest("text").alias("digest"))), "exact-digests")
    return exact_groups(keyed, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    whole = settled(numbered(docs.select(F.struct("*").alias("doc"), text_digest(docs["text"]).alias("digest"))), "exact-docs")
    groups = exact_groups(whole.select("row", F.col("doc.doc_id").alias("doc_id"), "digest"), counters)
    return whole.join(groups.where(~F.col("kept")).select("row"), "row", "left_anti").select("doc.*")
