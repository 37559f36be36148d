"""Streaming extensions: the batch semantics of timelines, sessions and progress over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import camera_key


def timeline(shots: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Captures by tumbling window; rows later than ``late`` are left out."""
    return shots.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "n")


def sessions(shots: DataFrame, gap: str = "2 seconds", least: int = 3, late: str = "1 hour") -> DataFrame:
    """Runs of a camera's captures whose gaps stay under ``gap``, from ``least`` captures on.

    A session window's end is its last capture plus ``gap``; place and file name are not looked at.
    """
    key = camera_key(F.col("camera_make"), F.col("camera_model")).alias("camera")
    s = shots.select("ts", "image_id", key).withWatermark("ts", late).groupBy("camera", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("image_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).where(F.col("image_count") >= least).drop("w")


def latest_progress(log: DataFrame, kept: str = "1 hour") -> DataFrame:
    """The last progress of each job in an append-only log of ``job_id, ts, percent``; state older than ``kept`` goes."""
    return log.withWatermark("ts", kept).groupBy("job_id", F.window("ts", kept)).agg(F.max_by("percent", "ts").alias("percent"), F.max("ts").alias("at")).select("job_id", "percent", "at")
