"""Verification of archives as they land in a directory (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.archives import verify


def verify_landing(spark: SparkSession, landing: str, reports: str, checkpoint: str, suffix: str = ".dz") -> StreamingQuery:
    """Appends the report on each new archive in `landing` to the Parquet table `reports`.

    Only paths are streamed.  A batch goes to a folder of its own that is overwritten, so that one that is tried again
    leaves its rows once.
    """
    paths = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("pathGlobFilter", f"*{suffix}").load(landing).select("path")

    def check(batch: DataFrame, number: int) -> None:
        found = [r.path for r in batch.collect()]
        if found:
            paths = [p if "://" in p else p.removeprefix("file:") for p in found]
            verify(batch.sparkSession, paths).write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return paths.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
