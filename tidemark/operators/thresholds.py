"""Threshold configuration as an append-only log of changes with validation, templates and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

KEY = "config_key"
EVENTS = "seq long, at string, config_key string, action string, old_value double, new_value double, changed_by string, reason string"


def current(configs: DataFrame, events: DataFrame) -> DataFrame:
    """Configs with the value of each key's last event."""
    last = events.groupBy(KEY).agg(F.max_by(F.struct("new_value", "at", "changed_by"), "seq").alias("e"))
    out = configs.join(last, KEY, "left")
    return out.select("category", "data_type", KEY, F.coalesce("e.new_value", "value").alias("value"), "default_value", "min_value", "max_value", F.col("e.at").alias("updated_at"), F.col("e.changed_by").alias("updated_by"))


def error_of(value: Column | str = "new_value") -> Column:
    """First error of a change joined to its config: unknown key, request, bounds, type."""
    return F.coalesce(F.when(F.col("data_type").isNull(), "unknown key"), fn.request_error("changed_by", "reason"), fn.bounds_error(value, "min_value", "max_value"), fn.type_error(value, "data_type"))


def judge(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change (config_key, new_value, changed_by, reason) with its error, or null, and the default as suggestion."""
    c = configs.select(KEY, "data_type", "value", "default_value", "min_value", "max_value")
    out = changes.join(c, KEY, "left").withColumn("error", error_of())
    return out.select(KEY, "new_value", "changed_by", "reason", F.col("value").alias("old_value"), "error", F.when(F.col("error").isNotNull(), F.col("default_value")).alias("suggested"))


def batch_result(judged: DataFrame) -> DataFrame:
    """Counts of a batch that may succeed in part."""
    return judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def accepted(judged: DataFrame, at: str, first_seq: int, action: str = "Update") -> DataFrame:
    """Events for the changes without error, to be appended to the log."""
    # a batch is a request by a user: a few rows
    w = F.row_number().over(Window.orderBy(KEY))
    return judged.filter("error IS NULL").select((w - 1 + first_seq).cast("long").alias("seq"), F.lit(at).alias("at"), KEY, F.lit(action).alias("action"), "old_value", "new_value", "changed_by", "reason")


def reset(configs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Changes that set values back to their defaults."""
    chosen = configs if keys is None else configs.filter(F.col(KEY).isin(keys))
    return chosen.select(KEY, F.col("default_value").alias("new_value"))


def apply_template(templates: DataFrame, configs: DataFrame, name: str) -> DataFrame:
    """Settings of a template, each with the config it meets or as unmatched."""
    c = configs.select(KEY, F.col("value").alias("old_value"))
    return templates.filter(F.col("template") == name).join(c, KEY, "left").select(KEY, "value", "old_value", F.col("old_value").isNotNull().alias("matched"))


def history(events: DataFrame, key: str | None = None, n: int = 100) -> DataFrame:
    """Newest updates and resets, of one key or of all; the key is matched before the limit."""
    out = events.filter(F.col("action").isin("Update", "Reset"))
    if key is not None:
        out = out.filter(F.col(KEY) == key)
    return out.orderBy(F.desc("seq")).limit(n)
