"""Incremental load of consumption exports that arrive as files: each micro-batch is reviewed and published like a manual
load. Late or repeated files follow the same conflict policy, and loading a batch twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from caudal.operators.loading import combined, compare_load, load_summary, review_findings
from caudal.session import cut_lineage
from caudal.sources.exports import CONSUMPTION
from caudal.sources.store import Versions


class LoadStopped(ValueError):
    """A batch holds values that contradict the master."""


def export_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The Parquet files of a folder as a stream with the fact schema."""
    return spark.readStream.schema(CONSUMPTION).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def load_batch(batch: DataFrame, master: Versions, policy: str = "detener") -> None:
    """Review one batch against the current master and publish the result."""
    current = master.read()
    if current is None:
        current = batch.limit(0)  # no master yet: every row is new
    compared = cut_lineage(compare_load(current, batch))
    findings = review_findings(load_summary(compared), policy).collect()  # at most one row
    if any(row["nivel"] == "error" and row["codigo"] == "conflictos" for row in findings):
        raise LoadStopped(f"{findings[0]['n']} keys have another value in the new files")
    if not any(row["codigo"] == "sin_cambios" for row in findings):
        master.publish(combined(compared))


def start(stream: DataFrame, master: Versions, checkpoint: str, policy: str = "detener") -> StreamingQuery:
    """Load everything that is there and stop; run it again when more files arrive."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: load_batch(batch, master, policy))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
