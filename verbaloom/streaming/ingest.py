"""Tokens and constructions of annotated files, as the files arrive.

The file source remembers which files it has read, so nothing is done twice after a restart; a batch that is run again
overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import ASC_SUFFIX, asc_tokens, doc_id_of, failed_files


def stream_asc_files(spark: SparkSession, folder: str, most_files: int = 10_000) -> DataFrame:
    """(doc_id, value) of annotated files, as a stream; at most ``most_files`` a batch, the rest in the next."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*{ASC_SUFFIX}").option("maxFilesPerTrigger", most_files).load(folder)
    return raw.select(doc_id_of(F.col("_metadata.file_name")).alias("doc_id"), "value")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write ``tokens`` (or ``then`` of them) and ``failed`` files below ``out``, a folder a batch; ends when all is read."""

    def batch(files: DataFrame, n: int) -> None:
        tokens = asc_tokens(files)
        (then(tokens) if then else tokens).write.mode("overwrite").parquet(f"{out}/tokens/batch={n}")
        failed_files(files).write.mode("overwrite").parquet(f"{out}/failed/batch={n}")

    return stream_asc_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
