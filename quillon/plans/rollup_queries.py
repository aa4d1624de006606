"""Facets, counters, calendars, groups and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import rollups as r
from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view

_RANK = "CASE WHEN flag >= 0 THEN 1 ELSE 0 END DESC, coalesce(user_rating, -1) DESC, trunc(coalesce(ai_score, -0.001) * 1000000)::BIGINT DESC, photo_id"
_OK = "coalesce(gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT (gps_lat = 0 AND gps_lon = 0), false)"
_OF = "of AS (SELECT DISTINCT b.burst_id, b.scene_id, s.event_id FROM burst b LEFT JOIN (SELECT DISTINCT scene_id, event_id FROM scene) s ON s.scene_id = b.scene_id)"


@register("session_counters", f"{oracle_views('photo')} SELECT c_custkey AS session_id, count(photo_id)::BIGINT AS photo_count, count(*) FILTER (flag = 1)::BIGINT AS picked, count(*) FILTER (flag = -1)::BIGINT AS rejected, count(user_rating)::BIGINT AS rated FROM customer LEFT JOIN photo ON session_id = c_custkey GROUP BY 1")
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("session_id"))
    return r.session_counters(sessions, view(spark, sf_dir, "photo"))


def _facet(name: str, column: str) -> None:
    register(name, f"{oracle_views('photo')} SELECT {column}, count(*)::BIGINT AS n FROM photo WHERE missing = 0 AND {column} IS NOT NULL GROUP BY 1")(lambda spark, sf_dir: r.facet(view(spark, sf_dir, "photo"), column))


_facet("lens_facet", "lens")
_facet("device_facet", "device_id")


@register("tag_facet", f"{oracle_views('photo', 'photo_tag')} SELECT tag, count(DISTINCT photo_id)::BIGINT AS n FROM photo_tag SEMI JOIN (SELECT photo_id FROM photo WHERE missing = 0) USING (photo_id) GROUP BY tag ORDER BY n DESC, tag LIMIT 500")
def tag_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.tag_facet(view(spark, sf_dir, "photo"), view(spark, sf_dir, "photo_tag"))


@register("capture_span", f"{oracle_views('photo')} SELECT session_id, min(taken_at) AS first_at, max(taken_at) AS last_at FROM photo WHERE missing = 0 GROUP BY 1")
def capture_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").where("missing = 0").groupBy("session_id").agg(F.min("taken_at").alias("first_at"), F.max("taken_at").alias("last_at"))


@register("people_list", f"{oracle_views('face')} SELECT person_id, count(DISTINCT photo_id)::BIGINT AS photos, count(*)::BIGINT AS faces FROM face WHERE person_id IS NOT NULL GROUP BY 1")
def people_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.people(view(spark, sf_dir, "face"))


_FORMAT = {"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}


def _timeline(granularity: str) -> None:
    day = "CAST(DATE '1970-01-01' + floor((taken_at + coalesce(offset_min, 0) * 60000) / 86400000.0)::INT AS DATE)"
    last = {"day": "first", "month": "last_day(first)", "year": "CAST(first + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)"}[granularity]
    sql = f"""{oracle_views('photo')}, d AS (SELECT *, CAST(date_trunc('{granularity}', {day}) AS DATE) AS first FROM photo WHERE pair_id IS NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY {_RANK}) AS r FROM d)
    SELECT strftime(first, '{_FORMAT[granularity]}') AS key, strftime({last}, '%Y-%m-%d') AS last_day, count(*)::BIGINT AS n, string_agg(CASE WHEN r <= 4 THEN photo_id::VARCHAR END, ',' ORDER BY r) AS photo_ids FROM k GROUP BY first"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = r.timeline(view(spark, sf_dir, "photo"), granularity)
        return got.select("key", F.date_format("last", "yyyy-MM-dd").alias("last_day"), "n", F.array_join("photo_ids", ",").alias("photo_ids"))

    register(f"timeline_{granularity}", sql)(query)


for _g in _FORMAT:
    _timeline(_g)


@register("timeline_window", f"{oracle_views('photo')} SELECT floor((taken_at + coalesce(offset_min, 0) * 60000) / 86400000.0)::BIGINT AS day, count(*)::BIGINT AS n FROM photo WHERE pair_id IS NULL AND floor((taken_at + coalesce(offset_min, 0) * 60000) / 86400000.0) BETWEEN 10227 AND 10591 GROUP BY 1")
def timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.timeline(view(spark, sf_dir, "photo"), "day", 10227, 10591)
    return got.select(F.unix_date("first").cast("long").alias("day"), "n")


@register("root_counts", "SELECT n_name, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON c_nationkey = n_nationkey GROUP BY 1")
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    roots = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return roots.join(few, roots.n_nationkey == few.c_nationkey, "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@register("capture_days", f"{oracle_views('photo')} SELECT DISTINCT session_id, floor((taken_at + coalesce(offset_min, 0) * 60000) / 86400000.0)::BIGINT AS day FROM photo WHERE taken_at IS NOT NULL")
def capture_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").where("taken_at IS NOT NULL").select("session_id", exprs.local_day(F.col("taken_at"), F.col("offset_min")).alias("day")).distinct()


@register("burst_stats", f"{oracle_views('photo')} SELECT burst_id, count(*)::BIGINT AS n, min(coalesce(taken_at, mtime)) AS start_at, max(coalesce(taken_at, mtime)) AS end_at FROM photo WHERE burst_id IS NOT NULL GROUP BY 1")
def burst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.burst_stats(view(spark, sf_dir, "photo"))


@register("scene_bounds", f"{oracle_views('photo', 'burst', 'scene')}, {_OF} SELECT scene_id, count(*)::BIGINT AS n, min(coalesce(taken_at, mtime)) AS start_at, max(coalesce(taken_at, mtime)) AS end_at FROM photo JOIN of USING (burst_id) GROUP BY 1")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.scene_bounds(view(spark, sf_dir, "photo"), view(spark, sf_dir, "burst"))


@register("event_centroids", f"{oracle_views('photo', 'burst', 'scene')}, {_OF} SELECT event_id, round(avg(gps_lat) FILTER ({_OK}), 6) AS lat, round(avg(gps_lon) FILTER ({_OK}), 6) AS lon, arg_min(offset_min, (coalesce(taken_at, mtime), photo_id)) FILTER (offset_min IS NOT NULL) AS offset_min FROM photo JOIN of USING (burst_id) WHERE event_id IS NOT NULL GROUP BY 1")
def event_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.event_centroids(view(spark, sf_dir, "photo"), view(spark, sf_dir, "burst"), view(spark, sf_dir, "scene"))
    return got.select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "offset_min")


@register("mean_embeddings", "WITH p AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT label, i::INT AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS v FROM p")
def mean_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.mean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding")
    return got.select("label", F.posexplode("mean").alias("pos", "v")).select("label", (F.col("pos") + 1).alias("pos"), F.round("v", 6).alias("v"))


@register("nested_groups", f"{oracle_views('photo', 'burst')}, h AS (SELECT burst_id, string_agg(photo_id::VARCHAR, ' ' ORDER BY rank_in_burst, photo_id) AS ids FROM photo WHERE burst_id IS NOT NULL GROUP BY 1) SELECT scene_id, string_agg(h.burst_id::VARCHAR || ':' || ids, ';' ORDER BY h.burst_id) AS bursts FROM h JOIN (SELECT DISTINCT burst_id, scene_id FROM burst) USING (burst_id) GROUP BY 1")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = r.nested_groups(view(spark, sf_dir, "photo"), view(spark, sf_dir, "burst"))
    text = F.transform("bursts", lambda b: F.concat(b["burst_id"].cast("string"), F.lit(":"), F.array_join(F.transform(b["photo_ids"], lambda p: p.cast("string")), " ")))
    return got.select("scene_id", F.array_join(text, ";").alias("bursts"))


@register("track_majority", f"{oracle_views('face')}, c AS (SELECT photo_id % 100 AS g, track_id, person_id, count(*) AS n FROM face WHERE person_id IS NOT NULL GROUP BY ALL) SELECT g * 10 + track_id AS track, arg_max(person_id, (n, -person_id)) AS person_id, max(n)::BIGINT AS n FROM c GROUP BY 1")
def track_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.majority(view(spark, sf_dir, "face").selectExpr("photo_id % 100 * 10 + track_id AS track", "person_id"), "track", "person_id")


@register("burst_face_matrix", f"{oracle_views('face', 'photo')} SELECT burst_id, " + ", ".join(f"count(DISTINCT f.photo_id) FILTER (track_id = {k})::BIGINT AS track_{k}" for k in range(8)) + " FROM face f JOIN photo p ON p.photo_id = f.photo_id WHERE burst_id IS NOT NULL GROUP BY 1")
def burst_face_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "face").join(view(spark, sf_dir, "photo").where("burst_id IS NOT NULL").select("photo_id", "burst_id"), "photo_id")
    got = rows.groupBy("burst_id").pivot("track_id", list(range(8))).agg(F.countDistinct("photo_id"))
    return got.select("burst_id", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"track_{k}") for k in range(8)])


@register("nonhuman_vote", f"{oracle_views('face')} SELECT person_id, count(*)::BIGINT AS known, count(*) FILTER (nonhuman = 0)::BIGINT AS found, count(*) FILTER (nonhuman = 0) < 0.5 * count(*) AS mostly_nonhuman FROM face WHERE person_id IS NOT NULL GROUP BY 1")
def nonhuman_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.nonhuman_vote(view(spark, sf_dir, "face").where("person_id IS NOT NULL"), "person_id")


@register("cover_faces", f"{oracle_views('face')} SELECT person_id, arg_max(photo_id, (round(coalesce(sharpness, 0.0) * w * h, 9), -photo_id)) AS photo_id, round(max(round(coalesce(sharpness, 0.0) * w * h, 9)), 6) AS score FROM face WHERE person_id IS NOT NULL GROUP BY 1")
def cover_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.coalesce("sharpness", F.lit(0.0)) * F.col("w") * F.col("h"), 9)
    got = r.argmax(view(spark, sf_dir, "face").where("person_id IS NOT NULL"), "person_id", "photo_id", score, "photo_id")
    return got.select("person_id", "photo_id", F.round("score", 6).alias("score"))


@register("medians", f"{oracle_views('photo')}, s AS (SELECT session_id, list_sort(list(mtime)) AS v FROM photo GROUP BY 1) SELECT session_id, (SELECT median(user_rating)::DOUBLE FROM photo p WHERE p.session_id = s.session_id) AS rating, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE v[len(v) // 2] + (v[len(v) // 2 + 1] - v[len(v) // 2]) // 2 END AS lower FROM s")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = view(spark, sf_dir, "photo").groupBy("session_id").agg(F.median("user_rating").alias("rating"), F.collect_list("mtime").alias("v"))
    return got.select("session_id", "rating", r.lower_median(F.col("v")).alias("lower"))


@register("scope_statistics", f"{oracle_views('photo')} SELECT scene_type, round(avg(ai_score), 6) AS mean, round(stddev_pop(ai_score), 6) AS sd FROM photo GROUP BY 1")
def scope_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").groupBy("scene_type").agg(F.round(F.avg("ai_score"), 6).alias("mean"), F.round(F.stddev_pop("ai_score"), 6).alias("sd"))


_AUC = f"{oracle_views('photo')}, s AS (SELECT session_id % 20 AS k, round(coalesce(ai_score, 0), 1) AS score, CASE WHEN flag = 1 THEN 1 ELSE 0 END AS y, photo_id FROM photo)"


@register("auc", f"{_AUC} SELECT a.k, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM s a JOIN s b ON a.k = b.k AND a.y = 1 AND b.y = 0 GROUP BY 1")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "photo").select((F.col("session_id") % 20).alias("k"), F.round(F.coalesce("ai_score", F.lit(0.0)), 1).alias("score"), F.when(F.col("flag") == 1, 1).otherwise(0).alias("y"))
    return r.auc(rows, "score", "y", "k").select("k", F.round("auc", 6).alias("auc"))


@register("rank_accuracy", f"{_AUC}, t AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY score DESC, photo_id) AS r, sum(y) OVER (PARTITION BY k) AS pos FROM s) SELECT k, round(sum(CASE WHEN r <= pos AND y = 1 THEN 1 ELSE 0 END) / max(pos)::DOUBLE, 6) AS accuracy FROM t GROUP BY 1")
def rank_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "photo").select((F.col("session_id") % 20).alias("k"), F.round(F.coalesce("ai_score", F.lit(0.0)), 1).alias("score"), F.when(F.col("flag") == 1, 1).otherwise(0).alias("y"), "photo_id")
    return r.rank_accuracy(rows, "score", "y", "k", "photo_id").select("k", F.round("accuracy", 6).alias("accuracy"))


@register("common_dimension", "SELECT arg_max(d, (n, d))::INT AS dim FROM (SELECT len(embedding) AS d, count(*) AS n FROM embeddings WHERE len(embedding) > 0 GROUP BY 1)")
def common_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.common_dimension(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")


@register("moments", f"""{oracle_views('item').replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM item),
 w AS (SELECT user_id, i, t AS open, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN o.t - w.open > 3600000 THEN o.t ELSE w.open END, w.n + CASE WHEN o.t - w.open > 3600000 THEN 1 ELSE 0 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
 SELECT user_id, max(n)::INT AS moments FROM w GROUP BY 1""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "item").groupBy("user_id").agg(F.collect_list("t").alias("ts")).select("user_id", r.moments(F.col("ts"), 3_600_000).alias("moments"))
