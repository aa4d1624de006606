"""Synthetic catalogs of any size, the same for a seed: rows come from spark.range, so executors make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shares of single shots, frames of a burst and their gaps, long pauses.
SINGLE, BURST, FRAME_MS, PAUSE, PAUSE_MIN = 0.55, (3, 8), (180, 339), 0.04, (20, 60)


def _draw(seed: int, k: int, *columns: str) -> Column:
    """A uniform draw in 0 to 1 that depends on the columns alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *columns), F.lit(1_000_003)) / 1_000_003.0


def photos(spark: SparkSession, shots: int, sessions: int = 1, seed: int = 42) -> DataFrame:
    """photo_id, session_id, taken_at, user_rating, flag, issues, ai_score, faces: `shots` presses of the shutter a session,
    most of them one frame, the others bursts; some long pauses between."""
    rows = spark.range(sessions).withColumnRenamed("id", "session_id").select("session_id", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))).alias("shot"))
    d = lambda k, *c: _draw(seed, k, "session_id", "shot", *c)
    size = F.when(d(0) < SINGLE, 1).otherwise((BURST[0] + F.floor(d(1) * (BURST[1] - BURST[0] + 1))).cast("int"))
    step = F.when(d(2) < PAUSE, (PAUSE_MIN[0] + d(3) * (PAUSE_MIN[1] - PAUSE_MIN[0])) * 60_000).otherwise(3_000 + d(4) * 57_000).cast("long")
    started = rows.withColumn("size", size).withColumn("start", F.sum(step).over(Window.partitionBy("session_id").orderBy("shot")))
    frames = started.select("session_id", "shot", "start", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("frame"))
    f = lambda k: _draw(seed, k, "session_id", "shot", "frame")
    gap = FRAME_MS[0] + F.pmod(F.xxhash64(F.lit(seed), "session_id", "shot"), F.lit(FRAME_MS[1] - FRAME_MS[0]))
    return frames.select(
        ((F.col("session_id") * shots + F.col("shot")) * 16 + F.col("frame")).alias("photo_id"), "session_id", (F.col("start") + F.col("frame") * gap).alias("taken_at"),
        F.when(f(5) < 0.30, (1 + F.floor(f(6) * 5)).cast("int")).alias("user_rating"), F.when(f(7) < 0.08, 1).when(f(7) < 0.14, -1).otherwise(0).alias("flag"),
        F.when(f(8) < 0.35, F.pow(F.lit(2), F.floor(f(9) * 8)).cast("int")).otherwise(0).alias("issues"), f(10).alias("ai_score"), F.when(f(11) < 0.60, (1 + F.floor(f(12) * 3)).cast("int")).otherwise(0).alias("faces"),
    )
