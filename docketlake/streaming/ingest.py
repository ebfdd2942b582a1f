"""Incremental ingest of dump files as a stream.

Each new file is read once (the checkpoint says which); a micro-batch is
upserted by id, so late and repeated posts refresh what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlake.plans.pipeline import Warehouse, classify_pending, ingest
from docketlake.sources.dumps import posts, submissions


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)


def start_ingest(spark: SparkSession, folder: str, warehouse: str, checkpoint: str, subreddit: str, now: int, classify: bool = True) -> StreamingQuery:
    """Ingest all NDJSON files that have come since the last run, then stop. A batch that is run again writes the same rows."""
    target = Warehouse(spark, warehouse)

    def batch(df: DataFrame, _id: int) -> None:
        parsed = df.select(F.col("value").alias("raw_json"), F.try_parse_json("value").alias("v")).filter(F.col("v").isNotNull())
        ingest(target, posts(submissions(parsed)), subreddit, "dump", now, advance=True)
        if classify:
            classify_pending(target, now)

    return stream_lines(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
