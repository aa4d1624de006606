"""Scores, issues, stars and in-burst ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import scoring
from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view

_MEASURES = {
    "exposure": "(photo_id * 53 % 1000) / 1000.0", "noise": "CASE WHEN photo_id % 8 = 0 THEN NULL ELSE (photo_id * 29 % 500) / 1000.0 END", "iqa": "CASE WHEN photo_id % 3 = 0 THEN NULL ELSE (photo_id * 41 % 1000) / 1000.0 END",
    "aesthetic": "(photo_id * 59 % 1000) / 1000.0", "composition": "CASE WHEN photo_id % 9 = 0 THEN NULL ELSE (photo_id * 61 % 1000) / 1000.0 END", "clipped_highlights": "(photo_id * 67 % 400) / 1000.0", "crushed_shadows": "(photo_id * 71 % 800) / 1000.0",
    "mean_luminance": "(photo_id * 73 % 1000) / 1000.0", "tilt_deg": "(photo_id * 79 % 240) / 10.0 - 12.0", "tilt_confidence": "(photo_id * 83 % 10) / 10.0", "sharpness_center": "CASE WHEN photo_id % 4 = 0 THEN NULL ELSE (photo_id * 43 % 1000) / 1000.0 END",
}
_M = ", ".join(f"{e} AS {c}" for c, e in _MEASURES.items())


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").selectExpr("photo_id", "scene_type", "burst_id", "taken_at", "sharpness", *[f"double({e}) AS {c}" for c, e in _MEASURES.items()])


def _c(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


_POSE = "CASE WHEN yaw IS NOT NULL OR pitch IS NOT NULL THEN 1 - least(greatest(abs(coalesce(yaw, 0)) - 15, 0) / 45.0 + greatest(abs(coalesce(pitch, 0)) - 15, 0) / 60.0, 1) END"
_PARTS = [(0.40, "CASE WHEN eyes_open IS NOT NULL THEN " + _c("eyes_open") + " END"), (0.20, "CASE WHEN smile IS NOT NULL THEN 0.4 + 0.6 * " + _c("smile") + " END"), (0.15, "CASE WHEN gaze IS NOT NULL THEN " + _c("gaze") + " END"), (0.10, _POSE), (0.15, "CASE WHEN sharpness IS NOT NULL THEN " + _c("sharpness") + " END")]
_EXPRESSION = "(" + " + ".join(f"coalesce({w}::DOUBLE * ({v}), 0)" for w, v in _PARTS) + ") / (" + " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE {w}::DOUBLE END" for w, v in _PARTS) + ")"
_LIVE = "nonhuman <> 1 AND artificial < 0.55"
_FACES = f"""face2 AS (SELECT photo_id, count(*) FILTER (is_subject = 1) AS subjects, avg({_EXPRESSION}) FILTER (is_subject = 1) AS face_score, count(*) FILTER (is_subject = 1 AND eyes_open < 0.45) AS closed,
 count(*) FILTER (is_subject <> 1 AND {_LIVE} AND greatest(w, 0) * greatest(h, 0) >= 0.003 AND coalesce(sharpness, 0) >= 0.35) AS bystanders,
 count(*) FILTER (is_subject = 1 AND {_LIVE} AND smile < 0.35 AND coalesce(sharpness >= 0.35, true) AND (coalesce(mouth_open >= 0.06, false) OR (eyes_open >= 0.45 AND eyes_open < 0.65))) AS bad FROM face GROUP BY 1)"""
_JOINED = f"m AS (SELECT photo_id, scene_type, burst_id, taken_at, sharpness, {_M} FROM photo), j AS (SELECT m.*, subjects, face_score, closed, bystanders, bad, CASE WHEN scene_type IS NOT NULL THEN scene_type WHEN coalesce(subjects, 0) = 0 THEN 'other' WHEN subjects <= 2 THEN 'portrait' ELSE 'group' END AS scene FROM m LEFT JOIN face2 USING (photo_id))"
_OVER = "((clipped_highlights >= 0.10 OR mean_luminance > 0.82) AND (coalesce(sharpness, 0) < 0.45 OR mean_luminance > 0.90))"
_UNDER = "(scene <> 'night' AND (crushed_shadows >= 0.40 OR mean_luminance < 0.07 OR (mean_luminance < 0.12 AND coalesce(sharpness, 0) < 0.40)))"
_ISSUES = f"""i AS (SELECT *, {_OVER} AS over, {_UNDER} AS under, coalesce(closed > 0, false) AS shut, coalesce(NOT {_OVER} AND NOT {_UNDER} AND sharpness < 0.35, false) AS blur, coalesce(NOT {_OVER} AND NOT {_UNDER} AND sharpness < 0.20, false) AS hblur,
 {_OVER} AND (clipped_highlights >= 0.25 OR mean_luminance > 0.90) AS hover, {_UNDER} AND (crushed_shadows >= 0.60 OR mean_luminance < 0.07) AS hunder FROM j)"""
_MASK = "(CASE WHEN shut THEN 1 ELSE 0 END + CASE WHEN blur THEN 2 ELSE 0 END + CASE WHEN over THEN 4 ELSE 0 END + CASE WHEN under THEN 8 ELSE 0 END + CASE WHEN tilt_confidence >= 0.2 AND abs(tilt_deg) BETWEEN 2 AND 10 THEN 16 ELSE 0 END + CASE WHEN coalesce(bystanders > 0, false) THEN 32 ELSE 0 END + CASE WHEN coalesce(noise >= CASE WHEN scene = 'night' THEN 0.30 ELSE 0.22 END, false) THEN 64 ELSE 0 END + CASE WHEN coalesce(bad > 0, false) THEN 128 ELSE 0 END)"
_TECH = "coalesce(iqa, 1 - CASE WHEN scene = 'night' THEN noise * 0.5 ELSE noise END)"
_V = {"face": "face_score", "sharpness": "sharpness", "aesthetic": "aesthetic", "exposure": "exposure", "technical": _TECH, "composition": "composition"}


def _weight(k: str) -> str:
    cases = " ".join(f"WHEN scene IN ({', '.join(repr(s) for s in scenes)}) THEN {w.get(k, 'NULL')}" for scenes, w in scoring.WEIGHTS.items() if scenes)
    return f"(CASE {cases} ELSE {scoring.WEIGHTS[()].get(k, 'NULL')} END)::DOUBLE"


_SUM = " + ".join(f"coalesce({_weight(k)} * {_c(v)}, 0) * CASE WHEN ({v}) IS NULL THEN 0 ELSE 1 END" for k, v in _V.items())
_TOTAL = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE coalesce({_weight(k)}, 0) END" for k, v in _V.items())
_PENALTY = "CASE WHEN shut THEN 0.25 ELSE 0 END + CASE WHEN hblur THEN 0.30 ELSE 0 END + CASE WHEN hover THEN 0.20 ELSE 0 END + CASE WHEN hunder THEN 0.20 ELSE 0 END"
_SCORED = f"{oracle_views('photo', 'face')}, {_FACES}, {_JOINED}, {_ISSUES}, s AS (SELECT *, least(greatest(coalesce(({_SUM}) / nullif({_TOTAL}, 0), 0.5) - ({_PENALTY}), 0), 1) AS q, {_MASK} AS mask, shut OR hblur OR hover OR hunder AS hard FROM i)"


@register("expression_scores", f"{oracle_views('face')} SELECT photo_id, part_key, line, round({_EXPRESSION}, 6) AS expression FROM face")
def expression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "face").select("photo_id", "part_key", "line", F.round(scoring.expression_score().cast("double"), 6).alias("expression"))


@register("face_features", f"{oracle_views('face')}, {_FACES} SELECT photo_id, subjects::BIGINT AS subjects, round(face_score, 6) AS face_score, closed::BIGINT AS closed, bystanders::BIGINT AS bystanders, bad::BIGINT AS bad FROM face2")
def face_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.face_features(view(spark, sf_dir, "face"))
    return got.select("photo_id", "subjects", F.round(F.col("face_score").cast("double"), 6).alias("face_score"), "closed", "bystanders", "bad")


@register("photo_scores", f"{_SCORED} SELECT photo_id, scene, round(q, 5) AS q, mask::INT AS issue_mask, hard AS hard_issue FROM s")
def photo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.score_photos(measured(spark, sf_dir), view(spark, sf_dir, "face"))
    return got.select("photo_id", "scene", F.round(F.col("q").cast("double"), 5).alias("q"), "issue_mask", "hard_issue")


@register("score_contributions", f"{_SCORED} SELECT photo_id, count(*) FILTER (d > 0)::BIGINT AS for_it, count(*) FILTER (d < 0)::BIGINT AS against_it FROM (" + " UNION ALL ".join(f"SELECT photo_id, CASE WHEN {_weight(k)} IS NOT NULL AND ({v}) IS NOT NULL THEN round({_weight(k)} / ({_TOTAL}) * ({_c(v)} - 0.5), 4) END AS d FROM s" for k, v in _V.items()) + ") GROUP BY 1")
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the components add to or take from a neutral score."""
    got = scoring.score_photos(measured(spark, sf_dir), view(spark, sf_dir, "face"))
    parts = F.filter("contributions", lambda x: ~x["key"].isin(*scoring.PENALTY))
    side = lambda sign: F.size(F.filter(parts, lambda x: x["delta"] * sign > 0)).cast("long")
    return got.select("photo_id", side(1).alias("for_it"), side(-1).alias("against_it"))


@register("star_ratings", f"{oracle_views('photo')} SELECT photo_id, least(CASE WHEN q < 0.20 THEN 0 WHEN q < 0.35 THEN 1 WHEN q < 0.50 THEN 2 WHEN q < 0.65 THEN 3 WHEN q < 0.80 THEN 4 ELSE 5 END + CASE WHEN best THEN 0.5 ELSE 0 END, CASE WHEN hard THEN 2.0 ELSE 5.0 END)::DOUBLE AS stars FROM (SELECT photo_id, coalesce(ai_score, 0.0) AS q, photo_id % 5 = 0 AS best, photo_id % 7 = 0 AS hard FROM photo)")
def star_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    return p.select("photo_id", exprs.star_rating(F.coalesce("ai_score", F.lit(0.0)), F.col("photo_id") % 5 == 0, F.col("photo_id") % 7 == 0).alias("stars"))


_COMPONENTS = [f"CASE WHEN {_weight(k)} IS NOT NULL THEN {_c(v)} + CASE WHEN ({v}) IS NULL THEN NULL ELSE 0 END END AS v_{k}" for k, v in _V.items()]


@register("burst_ranking", f"""{_SCORED}, c AS (SELECT s.*, round(q, 9) AS rq, {', '.join(_COMPONENTS)}, list_value(photo_id % 3 + 1.0, 1.0, photo_id % 2) AS e FROM s WHERE burst_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY rq DESC, coalesce(round(face_score, 9), 0) DESC, taken_at ASC NULLS FIRST, photo_id) - 1 AS rank, count(*) OVER b AS n, CASE WHEN count(sharpness_center) OVER b = count(*) OVER b THEN sharpness_center ELSE sharpness END AS measure FROM c WINDOW b AS (PARTITION BY burst_id)),
 p AS (SELECT a.photo_id, median(o.measure) AS others, bool_or(o.rank < a.rank AND list_cosine_similarity(a.e::DOUBLE[], o.e::DOUBLE[]) >= 0.93 AND {' AND '.join(f'coalesce(a.v_{k} <= o.v_{k} + 0.05, true)' for k in _V)}) AS redundant FROM r a JOIN r o ON a.burst_id = o.burst_id AND a.photo_id <> o.photo_id GROUP BY 1),
 f AS (SELECT r.*, coalesce(redundant, false) AS redundant, mask | CASE WHEN coalesce(measure < 0.85 * others, false) AND (mask & 12) = 0 THEN 2 ELSE 0 END AS m2, CASE WHEN coalesce(redundant, false) THEN greatest(rq - 0.03, 0) ELSE rq END AS q2 FROM r LEFT JOIN p USING (photo_id))
 SELECT photo_id, rank::INT AS rank, redundant, m2::INT AS issue_mask, round(q2, 5) AS q FROM f""")
def burst_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_photos(measured(spark, sf_dir), view(spark, sf_dir, "face")).where("burst_id IS NOT NULL")
    scored = scored.withColumn("q", F.round(F.col("q").cast("double"), 9)).withColumn("face_score", F.round(F.col("face_score").cast("double"), 9))
    scored = scored.withColumn("embedding", F.array((F.col("photo_id") % 3 + 1).cast("double"), F.lit(1.0), (F.col("photo_id") % 2).cast("double")))
    return scoring.rank_bursts(scored).select("photo_id", F.col("rank").cast("int").alias("rank"), "redundant", "issue_mask", F.round("q", 5).alias("q"))


@register("taste_fusion", f"{oracle_views('photo')} SELECT photo_id, round(CASE WHEN taste_score IS NULL THEN coalesce(ai_score, 0.5) ELSE 0.7 * coalesce(ai_score, 0.5) + 0.3 * taste_score END, 6) AS q FROM photo")
def taste_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").select("photo_id", F.round(scoring.fuse_taste(F.coalesce("ai_score", F.lit(0.5)), F.col("taste_score").cast("double"), 100), 6).alias("q"))


@register("bystander_faces", f"{oracle_views('face')} SELECT photo_id, count(*)::BIGINT AS n FROM face WHERE is_subject <> 1 AND {_LIVE} GROUP BY 1")
def bystander_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces that a removal of bystanders offers: all living ones that aren't subjects, whatever their size."""
    return view(spark, sf_dir, "face").where((F.col("is_subject") != 1) & ~scoring.not_a_person()).groupBy("photo_id").agg(F.count("*").alias("n"))


_AXIS = "greatest(exp(-0.5 * pow(least(abs({0} - 1 / 3.0::DOUBLE), abs({0} - 2 / 3.0::DOUBLE)) / 0.09, 2)), 0.8 * exp(-0.5 * pow(abs({0} - 0.5) / 0.06, 2)))"
_LEVEL = "CASE WHEN tilt_confidence >= 0.2 AND abs(tilt_deg) <= 10 THEN 1 - 0.85 * least(abs(tilt_deg) / 6.0, 1) END"


@register("composition_scores", f"""{oracle_views('photo', 'face')}, m AS (SELECT photo_id, {_M} FROM photo), u AS (SELECT photo_id, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2, avg(CASE WHEN x < 0.01 OR x + w > 0.99 OR y + h > 0.99 THEN 1.0 ELSE 0 END) AS cut FROM face WHERE is_subject = 1 AND {_LIVE} AND w > 0 AND h > 0 GROUP BY 1),
 p AS (SELECT photo_id, sqrt({_AXIS.format(_c('((x1 + x2) / 2)'))} * {_AXIS.format(_c('(y1 + 0.4 * (y2 - y1))'))}) AS t, CASE WHEN y2 - y1 < 0.08 THEN NULL WHEN y1 < 0.04 THEN y1 / 0.04 WHEN y1 <= 0.25 THEN 1 ELSE greatest(1 - 0.7 * (y1 - 0.25) / 0.35, 0.3) END AS hd, 1 - 0.8 * cut AS c, {_LEVEL} AS l FROM m JOIN u USING (photo_id))
 SELECT m.photo_id, round((0.35 * t + coalesce(0.15 * hd, 0) + 0.30 * c + coalesce(0.20 * l, 0)) / (0.65 + CASE WHEN hd IS NULL THEN 0 ELSE 0.15 END + CASE WHEN l IS NULL THEN 0 ELSE 0.20 END), 4) AS composition FROM m LEFT JOIN p ON p.photo_id = m.photo_id""")
def composition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    photos = measured(spark, sf_dir).select("photo_id", none.alias("saliency"), "tilt_deg", "tilt_confidence")
    return scoring.composition_scores(photos, view(spark, sf_dir, "face")).select("photo_id", F.round("composition", 4).alias("composition"))


@register("cover_scores", f"{oracle_views('face')} SELECT photo_id, part_key, line, round(least(sqrt(w * h), 0.3) * 0.5 * (0.3 + coalesce(sharpness, 0.5)) * greatest(1 - abs(yaw) / 75.0, 0.05) * greatest(1 - abs(coalesce(pitch, 0)) / 60.0, 0.1) * (0.02 + 0.98 * pow(least((part_key % 50) / 100.0 / 0.15, 0.05 / 0.06, 1.0), 3)), 6) AS score FROM face")
def cover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "face").selectExpr("*", "part_key % 50 / 100.0 AS luma", "0.05 AS contrast", "NULL AS det_score", "NULL AS occlusion", "NULL AS mean_luminance")
    return f.select("photo_id", "part_key", "line", F.round(scoring.cover_score(), 6).alias("score"))
