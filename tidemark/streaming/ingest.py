"""Reports that arrive in a folder, and event counts over time windows, with Structured Streaming.

An addition of this engine: each new file is shredded and appended once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.store import Store
from tidemark.sources.html import cells_of
from tidemark.sources.report_source import FILE_SCHEMA, read_rows


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, instance: str, at: str, files: int = 100) -> StreamingQuery:
    """Import each HTML file that appears in a folder; a batch that failed midway is run again under its name, one that is done is skipped."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(folder)
    pages = raw.select(F.xxhash64("path").alias("report_id"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.decode("content", "UTF-8").alias("html"))
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: store.import_reports(df, instance, at, name=hashlib.sha256(f"{checkpoint}\n{n}".encode()).hexdigest())).start()


def stream_rows(spark: SparkSession, folder: str, out: str, **options: object) -> DataFrame:
    """Table rows of all report files that lie in a folder now, shredded by the source as a stream.

    Each batch's rows go to a folder of their own, which a batch that is run again overwrites. Called again with the same
    out, only files that are new since then are read.
    """
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    rows = read_rows(spark, folder, stream=True, **options)
    rows.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(FILE_SCHEMA + ", batch long").parquet(f"{out}/rows")


def stream_cells(spark: SparkSession, folder: str, out: str, **options: object) -> DataFrame:
    """The cells of stream_rows()."""
    return cells_of(stream_rows(spark, folder, out, **options))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of events (event_id, ts, event_type, value) in windows.

    Events that come later than the watermark are dropped, and so are repeats of an event_id within it.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def count_events(spark: SparkSession, folder: str, out: str, schema: str, width: str, late: str, files: int | None = None) -> DataFrame:
    """event_counts over all Parquet files that lie in a folder now, all at once or some files at a time, oldest first.

    Each batch's changed windows go to a folder of their own, which a batch that is run again overwrites; of a window
    the last batch counts. Run again after a failure, the query goes on where it stopped.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    query = event_counts(stream, width, late).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("bucket", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
