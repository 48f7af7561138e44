"""Queries that run streams over the given tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries import query
from tidemark.sources.adapters import load
from tidemark.sources.shared import shared_folder
from tidemark.streaming import ingest

#: Days by which events may come late.
LATE = 20


@query(
    "stream.event_counts",
    f"""WITH first AS (SELECT max(ts) - INTERVAL {LATE} DAY AS mark FROM events WHERE event_id % 5 <> 0), kept AS (SELECT e.* FROM events e, first f WHERE e.event_id % 5 <> 0 OR e.ts > f.mark)
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS bucket, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM kept GROUP BY ALL""",
)
def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    """Two arrivals: four of five events, every tenth twice; and the fifth, most of them too late, with repeats of the first.

    Each arrival is counted when it is there; the query goes on from its checkpoint.
    """
    events = load(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4()}"
    repeated = events.filter("event_id % 10 = 1")
    for name, rows in (("a", events.filter("event_id % 5 <> 0").unionByName(repeated)), ("b", events.filter("event_id % 5 = 0").unionByName(repeated))):
        rows.write.parquet(f"{folder}/in/{name}")
        out = ingest.count_events(s, f"{folder}/in/*", f"{folder}/out", "event_id long, ts timestamp, event_type string, value decimal(12,2)", "1 day", f"{LATE} days")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n", F.col("total").cast("double").alias("total"))
