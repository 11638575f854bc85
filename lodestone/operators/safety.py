"""Risk levels, review, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+[.][A-Za-z]{2,}"
ADDRESS = r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b"


def personal(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EMAIL)) + F.regexp_count(text, F.lit(ADDRESS))


def risk(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, risk from 1 to 4: 4 toxic with personal data, 3 toxic, 2 personal data or low quality, 1 others."""
    rows = docs.select("doc_id", (personal(F.col("text")) > 0).alias("personal")).join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    level = F.when(toxic & F.col("personal"), 4).when(toxic, 3).when(F.col("personal") | F.coalesce(F.col("quality") == 0, F.lit(False)), 2).otherwise(1)
    return rows.select("doc_id", level.alias("risk"))


def review_queue(rated: DataFrame, decided: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, risk of what is at least so risky and not yet decided."""
    return rated.filter(F.col("risk") >= least).join(decided.select("doc_id"), "doc_id", "left_anti")


def audit_hourly(events: DataFrame) -> DataFrame:
    """hour, action, n, users, total."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return events.groupBy(hour.alias("hour"), F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("total"))


def audit_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, started, ended (of the last event), n: sessions that a pause of at least `gap` ends."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), "ts")
    return rows.groupBy("user_id", F.session_window("at", gap)).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")).drop("session_window")
