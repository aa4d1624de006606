"""Facets, counters, calendar roll-ups, nested groups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs

REPRESENTATIVES, TOP_TAGS = 4, 500


def session_counters(sessions: DataFrame, photos: DataFrame) -> DataFrame:
    """Per session: photos, picked, rejected, rated; sessions without photos have zeros."""
    counts = photos.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == 1).alias("picked"), F.count_if(F.col("flag") == -1).alias("rejected"), F.count("user_rating").alias("rated"))
    return sessions.join(counts, "session_id", "left").select("session_id", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("n", "photo_count"), ("picked", "picked"), ("rejected", "rejected"), ("rated", "rated"))])


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column with their counts; missing photos and null values are left out."""
    kept = rows.where("missing = 0") if "missing" in rows.columns else rows
    return kept.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def tag_facet(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """The commonest tags by photos that aren't missing."""
    present = tags.distinct().join(photos.where("missing = 0").select("photo_id"), "photo_id", "left_semi")
    return present.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(TOP_TAGS)


def people(faces: DataFrame) -> DataFrame:
    """Per person: photos and faces."""
    return faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.countDistinct("photo_id").alias("photos"), F.count("*").alias("faces"))


def representative_rank() -> list[Column]:
    """Not rejected first, then rating, then score, then the smallest id."""
    return [F.when(F.col("flag") >= 0, 1).otherwise(0).desc(), F.coalesce("user_rating", F.lit(-1)).desc(), (F.coalesce("ai_score", F.lit(-0.001)) * 1_000_000).cast("long").desc(), F.col("photo_id").asc()]


def timeline(photos: DataFrame, granularity: str, from_day: int | None = None, to_day: int | None = None) -> DataFrame:
    """Buckets of local days: key, first and last day, count and the best photos; undated ones, where no window is
    given, in a bucket with a null key. Companions are left out.

    Counts are aggregated before the shuffle; only the best few of each task reach the ranking (a window limit).
    """
    rows = photos.where("pair_id IS NULL").withColumn("day", exprs.local_day(F.col("taken_at"), F.col("offset_min")))
    if from_day is not None or to_day is not None:
        rows = rows.where(F.col("day").between(from_day if from_day is not None else -(2**62), to_day if to_day is not None else 2**62))
    rows = rows.withColumn("first", exprs.bucket_first(F.col("day"), granularity))
    counts = rows.groupBy("first").agg(F.count("*").alias("n"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy(*representative_rank()))).where(F.col("r") <= REPRESENTATIVES)
    tops = best.groupBy("first").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "photo_id"))), lambda x: x["photo_id"]).alias("photo_ids"))
    joined = counts.join(tops, counts["first"].eqNullSafe(tops["first"])).select(counts["first"], "n", "photo_ids")
    return joined.select(exprs.bucket_key(F.col("first"), granularity).alias("key"), "first", exprs.bucket_last(F.col("first"), granularity).alias("last"), "n", "photo_ids")


def burst_stats(photos: DataFrame) -> DataFrame:
    """Size and time bounds of each burst on corrected time (here: capture time, else file time)."""
    t = F.coalesce("taken_at", "mtime")
    return photos.where("burst_id IS NOT NULL").groupBy("burst_id").agg(F.count("*").alias("n"), F.min(t).alias("start_at"), F.max(t).alias("end_at"))


def scene_bounds(photos: DataFrame, bursts: DataFrame) -> DataFrame:
    """Bounds of scenes over their bursts' photos; scenes without photos are dropped."""
    return burst_stats(photos).join(bursts.select("burst_id", "scene_id").distinct(), "burst_id").groupBy("scene_id").agg(F.sum("n").alias("n"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))


def event_centroids(photos: DataFrame, bursts: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per event: mean of valid fixes, and the first known offset in time order."""
    of = bursts.select("burst_id", "scene_id").distinct().join(scenes.select("scene_id", "event_id").distinct(), "scene_id").select("burst_id", "event_id")
    rows = photos.join(of, "burst_id")
    ok = exprs.valid_fix(F.col("gps_lat"), F.col("gps_lon"))
    first = F.struct(F.coalesce("taken_at", "mtime").alias("t"), F.col("photo_id"))
    return rows.groupBy("event_id").agg(F.avg(F.when(ok, F.col("gps_lat"))).alias("lat"), F.avg(F.when(ok, F.col("gps_lon"))).alias("lon"), F.min_by("offset_min", F.when(F.col("offset_min").isNotNull(), first)).alias("offset_min"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit-length mean vector per key, by position, aggregated before the shuffle; vectors of another length than the
    key's longest are left out."""
    longest = rows.groupBy(key).agg(F.max(F.size(vector)).alias("dim"))
    parts = rows.join(longest, key).where(F.size(vector) == F.col("dim")).select(key, F.posexplode(vector).alias("pos", "v"))
    sums = parts.groupBy(key, "pos").agg(F.sum(F.col("v").cast("double")).alias("v"))
    whole = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v"))
    return whole.select(key, F.transform("v", lambda x: F.coalesce(F.try_divide(x, exprs.norm(F.col("v"))), F.lit(0.0))).alias("mean"))


def nested_groups(photos: DataFrame, bursts: DataFrame) -> DataFrame:
    """scene_id, bursts: photos by burst by scene; a burst without a scene is a scene of its own, -burst_id."""
    held = photos.where("burst_id IS NOT NULL").groupBy("burst_id").agg(F.array_sort(F.collect_list(F.struct("rank_in_burst", "photo_id"))).alias("photos"))
    placed = held.join(bursts.select("burst_id", "scene_id").distinct(), "burst_id", "left").withColumn("scene_id", F.coalesce("scene_id", -F.col("burst_id")))
    one = F.struct("burst_id", F.transform("photos", lambda p: p["photo_id"]).alias("photo_ids"))
    return placed.groupBy("scene_id").agg(F.array_sort(F.collect_list(one)).alias("bursts"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value per key, the lowest on ties."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value), F.max("n").alias("n"))


def nonhuman_vote(faces: DataFrame, key: str) -> DataFrame:
    """Whether fewer than half of a cluster's faces with a verdict were recognised."""
    votes = faces.groupBy(key).agg(F.count("eyes_open").alias("known"), F.count_if(F.col("nonhuman") == 0).alias("found"))
    return votes.withColumn("mostly_nonhuman", (F.col("known") > 0) & (F.col("found") < 0.5 * F.col("known")))


def argmax(rows: DataFrame, key: str, value: str, score: Column, tie: str) -> DataFrame:
    """The row's value with the highest score per key, the lowest tie column on ties."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(score.alias("s"), (-F.col(tie)).alias("t"))).alias(value), F.max(score).alias("score"))


def lower_median(values: Column) -> Column:
    """Median of an array of whole numbers; of an even count, the mean of the middle two rounded towards the lower."""
    v = F.array_sort(values)
    n = F.size(v)
    half = F.floor(n / 2).cast("int")
    low, high = F.element_at(v, half), F.element_at(v, half + 1)
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, high).otherwise(low + F.floor((high - low) / 2))


def auc(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Area under the ROC curve per key from tie-averaged ranks; null with one class only."""
    order = Window.partitionBy(key).orderBy(score)
    ranked = rows.withColumn("first", F.rank().over(order)).withColumn("ties", F.count("*").over(Window.partitionBy(key, score)))
    ranked = ranked.withColumn("r", F.col("first") + (F.col("ties") - 1) / 2.0)
    sums = ranked.groupBy(key).agg(F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return sums.select(key, F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0, (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def rank_accuracy(rows: DataFrame, score: str, label: str, key: str, tie: str) -> DataFrame:
    """Share of the positives among as many top-scored rows as there are positives."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).withColumn("pos", F.sum(label).over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(F.try_divide(F.sum(F.when((F.col("r") <= F.col("pos")) & (F.col(label) == 1), 1).otherwise(0)).cast("double"), F.max("pos").cast("double")).alias("accuracy"))


def common_dimension(rows: DataFrame, vector: str) -> DataFrame:
    """The commonest vector length, the larger on ties."""
    counts = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim"))


def moments(times: Column, width: int) -> Column:
    """Independent moments: greedy windows of a width over sorted times, each opened by the first time beyond the last."""
    start = F.struct(F.lit(None).cast("long").alias("open"), F.lit(0).alias("n"))
    step = lambda s, t: F.when(s["open"].isNull() | (t - s["open"] > width), F.struct(t.alias("open"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(times), start, step, lambda s: s["n"])
