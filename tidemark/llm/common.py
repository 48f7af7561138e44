"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: space and the control characters 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the folder that the cluster names in spark.checkpoint.dir; only a single-process session gets one of its own.

    Executors of a cluster do not see the driver's disk, so a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here delete their shuffle files when they end.

    Otherwise the files of every step stay until the driver happens to collect its garbage, so the disk of a loop
    grows with its rounds. A later run of such a query would make them anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs a read and no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: compressed, and later reads take only the columns they need."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one of this many rows is heavy, so there are at most this many heavy keys.
HEAVY = 1 << 16


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased, all else kept. Pure ASCII strings take the fast path, where lower() does the same."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, upper, upper.lower()))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores put before it until none of columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two non-null columns that tell rows apart: the id (null: least long) and a hash of the text.

    Rows that share both are repeated rows and get the same result.
    """
    return [F.coalesce(df[id_col].cast("long"), F.lit(-(2**63))).alias("_k1"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("_k2")]


#: Bits of the filter that keeps rows without a match out of a shuffle, in words of 64: at most 2^20 rows to broadcast.
FILTER_BITS = 1 << 26


def join_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (with _k1, _k2) left-joined with found (unique _k1, _k2); rows whose key's bit no row of found sets are not shuffled.

    The filter has a fixed size. With more keys than bits it lets all rows through, and the join is a plain one.
    found is read twice, so it should be a written table.
    """
    low = F.pmod(F.xxhash64("_k1", "_k2"), F.lit(64)).cast("int")
    words = found.groupBy(F.expr(f"pmod(xxhash64(_k1, _k2), {FILTER_BITS}) div 64").cast("int").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(xxhash64(_k1, _k2), 64)))")).alias("_bits"))
    tagged = docs.withColumn("_w", F.expr(f"pmod(xxhash64(_k1, _k2), {FILTER_BITS}) div 64").cast("int")).join(F.broadcast(words), "_w", "left")
    hit = F.coalesce(F.getbit("_bits", low), F.lit(0)) == 1
    met = tagged.filter(hit).drop("_w", "_bits").join(found.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    rest = tagged.filter(~hit).drop("_w", "_bits")
    return met.unionByName(rest, allowMissingColumns=True)
