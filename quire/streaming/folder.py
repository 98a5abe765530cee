"""A folder as a stream of new files: an extension over the batch engine.

Each micro-batch holds the files that appeared since the last one; their contents are named by
hash and handed to a batch function. The checkpoint makes restarts exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.files import case_glob

FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: The source skips new files that are older than this against the newest one seen: none should be.
MAX_FILE_AGE = "36500d"


def watch(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, modified_at, size_bytes, doc_id, content) of files as they appear; each content once while its hash is remembered."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFileAge", MAX_FILE_AGE).option("pathGlobFilter", case_glob(extensions)).load(folder)
    named = files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("doc_id"), "content")
    # by arrival, so that no file is late whatever its own time; the state forgets a content a week after it arrived
    arrived = named.withColumn("_arrived_at", F.current_timestamp()).withWatermark("_arrived_at", "7 days")
    return arrived.dropDuplicatesWithinWatermark(["doc_id"]).drop("_arrived_at")


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off all that is there and stop; the next call goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows over a stream or a table of events with a watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
