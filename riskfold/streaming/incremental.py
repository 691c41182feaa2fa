"""Incremental scoring of newly arriving source files.

A file stream (``binaryFile``) feeds micro-batches to the same batch
operators: parse, features, model scoring, flat report.  Every file is
complete inside the micro-batch that brings it, so no streaming state is
kept.  Each batch overwrites its own ``epoch=<id>`` folder, so a retried
batch replaces its output instead of duplicating it; the checkpoint records
which files were already processed.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskfold.operators.features import extract_features
from riskfold.operators.score import FLAG_THRESHOLD, flat_report
from riskfold.operators.train import score_files
from riskfold.sources.files import relative_path


def source_stream(spark: SparkSession, root: str, pattern: str = "*.py", max_files_per_batch: int = 10_000) -> DataFrame:
    """Streaming ``(repo, path, content)`` of files appearing under ``root``."""
    root_uri = root if "://" in root else "file://" + os.path.abspath(root)
    key = root_uri.split("://", 1)[1].rstrip("/") + "/"
    stream = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("pathGlobFilter", pattern)
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files_per_batch)
              .load(root_uri))
    rel = relative_path(F.col("path"), key)
    name = os.path.basename(os.path.abspath(root).rstrip("/"))
    return stream.select(F.lit(name).alias("repo"), rel.alias("path"), F.col("content"))


def score_new_files(spark: SparkSession, root: str, model: PipelineModel, output: str, checkpoint: str,
                    threshold: float = FLAG_THRESHOLD, available_now: bool = True) -> StreamingQuery:
    """Start the incremental scorer; with ``available_now`` it processes what
    is there and stops (call ``awaitTermination``)."""

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        scored = score_files(model, extract_features(batch, "content"))
        (flat_report(scored, threshold, with_error=True)
         .write.mode("overwrite").parquet(os.path.join(output, f"epoch={epoch_id}")))

    writer = (source_stream(spark, root).writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
