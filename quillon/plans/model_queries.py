"""The preference model, people clusters and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import people, preference
from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "item").selectExpr("event_id AS label_id", "event_id % 2000 AS photo_id", "CASE WHEN event_id % 3 = 0 THEN 'flag' ELSE 'rating' END AS kind", "CASE WHEN event_id % 3 = 0 THEN event_id DIV 3 % 3 - 1 ELSE event_id DIV 7 % 6 END AS value", "CASE WHEN event_id % 11 = 0 THEN 'assistant' ELSE 'user' END AS source", "t AS made_at")


_LABELS = """l AS (SELECT event_id AS label_id, event_id % 2000 AS photo_id, CASE WHEN event_id % 3 = 0 THEN 'flag' ELSE 'rating' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id // 3 % 3 - 1 ELSE event_id // 7 % 6 END AS value, t AS made_at FROM item WHERE event_id % 11 <> 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY photo_id, kind ORDER BY made_at DESC, label_id DESC) AS r FROM l)"""


@register("latest_labels", f"{oracle_views('item')}, {_LABELS} SELECT photo_id, kind, value FROM k WHERE r = 1")
def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.latest_labels(_labels(spark, sf_dir)).select("photo_id", "kind", "value")


@register("label_classes", f"{oracle_views('item')}, {_LABELS}, g AS (SELECT photo_id, max(value) FILTER (kind = 'flag' AND value <> 0) AS f, max(value) FILTER (kind = 'rating') AS v FROM k WHERE r = 1 GROUP BY 1), c AS (SELECT photo_id, CASE WHEN f IS NOT NULL THEN f > 0 WHEN v >= 4 THEN true WHEN v <= 2 THEN false END AS positive FROM g) SELECT * FROM c WHERE positive IS NOT NULL")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.classes(_labels(spark, sf_dir))


@register("preference_folds", f"{oracle_views('photo')} SELECT photo_id, (('0x' || substr(md5(coalesce('burst ' || burst_id, 'copies ' || dup_group_id, 'photo ' || photo_id)), 1, 8))::BIGINT % 5)::INT AS fold FROM photo")
def preference_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.folds(view(spark, sf_dir, "photo"))


@register("preference_model")
def preference_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per scene type on synthetic decisions."""
    photos = view(spark, sf_dir, "photo").where("ai_score IS NOT NULL").selectExpr(
        "session_id % 4 AS user_id", "photo_id", "burst_id", "dup_group_id", "array(double(ai_score), double(taste_score), double(sharpness), double(gps_lat)) AS features", "ai_score + coalesce(taste_score, 0) > 0.95 AS positive", "double(photo_id % 97) AS base"
    )
    got = preference.train_by(photos, "user_id")
    return got.select("user_id", "used", F.round("auc", 4).alias("auc"), F.round("base_auc", 4).alias("base_auc"), F.round("margin", 4).alias("margin"), "strength")


@register("preference_explain", f"{oracle_views('photo')}, p AS (SELECT photo_id, 'ai' AS f, (coalesce(ai_score, 0) - 0.5)::DOUBLE AS d FROM photo UNION ALL SELECT photo_id, 'taste', (coalesce(taste_score, 0) - 0.5)::DOUBLE FROM photo UNION ALL SELECT photo_id, 'sharp', (coalesce(sharpness, 0.5) - 0.5)::DOUBLE FROM photo UNION ALL SELECT photo_id, 'flag', (flag / 10.0)::DOUBLE FROM photo), d AS (SELECT * FROM p WHERE abs(d) >= 0.05) SELECT photo_id, coalesce(array_to_string((list(f ORDER BY d DESC, f) FILTER (d > 0))[1:3], ','), '') AS likes, coalesce(array_to_string((list(f ORDER BY d, f) FILTER (d < 0))[1:3], ','), '') AS dislikes FROM d GROUP BY 1")
def preference_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    parts = p.select("photo_id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.expr(e).alias("delta")) for n, e in (("ai", "double(coalesce(ai_score, 0)) - 0.5D"), ("taste", "double(coalesce(taste_score, 0)) - 0.5D"), ("sharp", "double(coalesce(sharpness, 0.5)) - 0.5D"), ("flag", "flag / 10.0D"))])))
    return preference.explain(parts).select("photo_id", F.array_join("likes", ",").alias("likes"), F.array_join("dislikes", ",").alias("dislikes"))


@register("face_tracks")
def face_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks within bursts; tests hold them against hand-made bursts."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    photos = view(spark, sf_dir, "photo").where("burst_id IS NOT NULL").select("photo_id", "burst_id", F.col("rank_in_burst").alias("frame"))
    faces = view(spark, sf_dir, "face").withColumn("vec_id", F.col("supplier") % 500).join(photos, "photo_id").join(vectors, "vec_id").withColumn("face_id", F.col("part_key") * 100 + F.col("line") * 10)
    return people.face_tracks(faces.select("burst_id", "face_id", "frame", *[F.col(c).cast("double").alias(c) for c in "xywh"], "embedding"))


@register("person_clusters")
def person_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person clusters of ten libraries; tests hold them against hand-made tracks."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tracks = v.selectExpr("label AS library", "vec_id AS track_id", "embedding", "array(vec_id, vec_id + 1000000) AS photos", "vec_id % 5 + 1 AS n_faces", "cast(NULL AS bigint) AS locked", "vec_id % 4 <> 0 AS reliable")
    return people.people(tracks.withColumn("library", F.col("library").cast("long")), "library", threshold=0.3)


@register("recompute_subjects")
def recompute_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces whose subject flag changes; tests hold the rule against hand-made photos."""
    f = view(spark, sf_dir, "face").selectExpr("photo_id", "part_key * 100 + line * 10 AS face_id", *[f"double({c}) AS {c}" for c in ("x", "y", "w", "h", "sharpness", "gaze")], "person_id IS NOT NULL AS named", "nonhuman = 1 OR artificial >= 0.55 AS not_person", "is_subject = 1 AS is_subject")
    return people.recompute_subjects(f)
