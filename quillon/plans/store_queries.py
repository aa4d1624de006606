"""People that a clustering found, capture metadata, backups, sidecars and runs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import assignment, runs
from quillon.plans.registry import register
from quillon.sources import backups, exif, files, scratch
from quillon.sources.views import oracle_views, view

_AFTER = 1_000_000
#: Faces with a made-up clustering, in the dialect that both engines share.
_FACES = {
    "face_id": "photo_id * 10 + line",
    "photo_id": "photo_id",
    "track_id": "supplier * 16 + part_key % 16",
    "person_id": "person_id",
    "locked": "(photo_id * 10 + line) % 20011 = 0",
    "is_subject": "is_subject = 1",
    "human": "CASE WHEN line = 7 THEN NULL ELSE supplier % 3 <> 0 OR (part_key + line) % 3 = 0 END",
}
_TRACKS = {
    "kind": "CASE track_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'new' WHEN 2 THEN 'weak' ELSE 'none' END",
    "number": "CASE track_id % 4 WHEN 0 THEN track_id % 39 + 1 WHEN 3 THEN -1 ELSE track_id % 997 END",
    "has_vector": "track_id % 7 <> 0",
}
_ELSEWHERE = {"person_id": "c_custkey", "named": "c_custkey % 3 = 0", "known": "4", "found": "c_custkey % 4", "photos": "c_custkey % 2", "locked": "c_custkey % 13 = 0"}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


@register("assigned_people", f"""{oracle_views('face')}, f AS (SELECT {_listed(_FACES)} FROM face), t0 AS (SELECT track_id, coalesce(bool_or(is_subject), false) AS subject, min(face_id) AS first FROM f GROUP BY 1),
 t AS (SELECT *, {_listed(_TRACKS)} FROM t0), e AS (SELECT {_listed(_ELSEWHERE)} FROM customer WHERE c_custkey < 40),
 g AS (SELECT track_id, first, CASE WHEN kind <> 'none' THEN kind || ' ' || number WHEN subject AND has_vector THEN 'single ' || track_id END AS judged, CASE WHEN kind = 'weak' AND subject AND has_vector THEN 'single ' || track_id END AS then_, CASE WHEN kind IN ('person', 'new') THEN kind || ' ' || number WHEN subject AND has_vector THEN 'single ' || track_id END AS target FROM t),
 c AS (SELECT f.*, judged AS grp FROM f JOIN g USING (track_id) WHERE judged IS NOT NULL UNION ALL SELECT f.*, then_ FROM f JOIN g USING (track_id) WHERE then_ IS NOT NULL),
 v AS (SELECT grp, count(human) AS known, count(*) FILTER (human) AS found, count(DISTINCT photo_id) AS photos, bool_or(locked) AS locked FROM c GROUP BY 1),
 w AS (SELECT v.grp, v.photos + coalesce(e.photos, 0) >= 2 AS spans FROM v LEFT JOIN e ON v.grp = 'person ' || e.person_id WHERE NOT coalesce(e.named, false) AND NOT v.locked AND NOT coalesce(e.locked, false) AND v.known + coalesce(e.known, 0) > 0 AND v.found + coalesce(e.found, 0) < 0.5 * (v.known + coalesce(e.known, 0))),
 o AS (SELECT g.*, coalesce(a.spans, b.spans) AS veto FROM g LEFT JOIN w a ON a.grp = g.judged LEFT JOIN w b ON b.grp = g.then_),
 n AS (SELECT target, min(first) + {_AFTER + 1} AS new_id FROM o WHERE veto IS NULL GROUP BY 1),
 r AS (SELECT o.track_id, o.veto, o.target, CASE WHEN o.veto IS NOT NULL OR o.target IS NULL THEN NULL WHEN o.target LIKE 'person %' THEN substr(o.target, 8)::BIGINT ELSE n.new_id END AS dest FROM o LEFT JOIN n ON n.target = o.target)
 SELECT f.face_id, f.photo_id, CASE WHEN f.locked THEN f.person_id ELSE r.dest END AS person_id, NOT f.locked AND coalesce(r.veto, false) AS nonhuman, NOT f.locked AND r.dest IS NOT NULL AND coalesce(r.target LIKE 'single %', false) AS singleton FROM f JOIN r USING (track_id)""")
def assigned_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = view(spark, sf_dir, "face").selectExpr(*[f"{e} AS {c}" for c, e in _FACES.items()])
    tracks = faces.select("track_id").distinct().selectExpr("track_id", *[f"{e} AS {c}" for c, e in _TRACKS.items()])
    elsewhere = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey < 40").selectExpr(*[f"{e} AS {c}" for c, e in _ELSEWHERE.items()])
    return assignment.assign_people(faces, tracks, elsewhere, _AFTER)


_SHOT = {
    "width": "CAST(width AS INT)",
    "height": "CAST(height AS INT)",
    "orientation": "CAST(1 + photo_id % 8 AS INT)",
    "taken_at": "taken_at",
    "offset_min": "CAST(offset_min AS INT)",
    "model": "CASE WHEN photo_id % 10 = 0 THEN NULL ELSE 'Camera ' || CAST(photo_id % 4 AS STRING) END",
    "lens": "lens",
    "focal": "CASE WHEN photo_id % 6 = 0 THEN NULL ELSE CAST(10 + photo_id % 190 AS DOUBLE) END",
    "iso": "CAST(100 * (1 + photo_id % 6) AS INT)",
    "gps_lat": "CAST(gps_lat AS DOUBLE)",
    "gps_lon": "CAST(gps_lon AS DOUBLE)",
}


@register("exif_fields", f"{oracle_views('photo')}, s AS (SELECT photo_id, {_listed(_SHOT)} FROM photo) SELECT * REPLACE (round(gps_lat, 4) AS gps_lat, round(gps_lon, 4) AS gps_lon) FROM s")
def exif_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written for all photos and read back."""
    shots = view(spark, sf_dir, "photo").selectExpr("photo_id", *[f"{e} AS {c}" for c, e in _SHOT.items()])
    read = exif.with_metadata(exif.with_headers(shots).select("photo_id", "content"))
    return read.select("photo_id", *[F.round(c, 4).alias(c) if c.startswith("gps_") else F.col(c) for c in _SHOT])


_BACKED_UP = ("customer", "nation", "orders", "region", "supplier")


@register("backup_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, NULL::VARCHAR AS problem FROM {t}" for t in _BACKED_UP))
def backup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables backed up and verified; the backup is scratch."""
    folder = scratch.new_path(spark, "backups")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BACKED_UP}
    return backups.verify(spark, folder, backups.back_up(spark, tables, folder, "1"))


_NOTES = {
    "rating": "user_rating",
    "label": "CASE WHEN color_label IS NULL THEN NULL ELSE color_label || ' <&> \"' || CAST(photo_id % 3 AS STRING) || '\"' END",
    "pick": "CAST(flag AS INT)",
}


@register("sidecar_round_trip", f"{oracle_views('photo')} SELECT photo_id, {_listed(_NOTES)}, CASE photo_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a & b|<c>' ELSE 'one' END AS keywords FROM photo")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar documents written for all photos and read back."""
    rows = view(spark, sf_dir, "photo").selectExpr("photo_id", *[f"{e} AS {c}" for c, e in _NOTES.items()], "CASE photo_id % 3 WHEN 0 THEN array() WHEN 1 THEN array('a & b', '<c>') ELSE array('one') END AS keywords")
    read = rows.select("photo_id", files.sidecar_values(files.sidecar_document(F.col("rating"), F.col("label"), F.col("pick"), F.col("keywords"))).alias("v"))
    return read.select("photo_id", "v.rating", "v.label", "v.pick", F.array_join("v.keywords", "|").alias("keywords"))


_STATUS = "CASE session_id % 4 WHEN 0 THEN 'interrupted' WHEN 1 THEN 'paused' WHEN 2 THEN 'interrupted' ELSE 'done' END"


@register("resumed_runs", f"{oracle_views('photo')}, l AS (SELECT session_id, count(*) AS asked, count(*) FILTER (analysis_version = 0) AS n_left FROM photo GROUP BY 1), s AS (SELECT *, {_STATUS} AS status, session_id % 5 AS resumes FROM l) SELECT session_id, n_left, CASE WHEN n_left = 0 THEN 'none' WHEN status = 'interrupted' AND resumes < 3 THEN 'resume' WHEN status = 'interrupted' THEN 'give up' WHEN status = 'paused' THEN 'wait' ELSE 'none' END AS action FROM s")
def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over sessions, of which some photos have no analysis yet."""
    asked = view(spark, sf_dir, "photo").select("session_id", "photo_id", "analysis_version")
    left = runs.left_over(asked, asked.where("analysis_version > 0"), ["photo_id"]).groupBy("session_id").agg(F.count("*").alias("n_left"))
    table = asked.select("session_id").distinct().join(left, "session_id", "left").selectExpr("session_id", "coalesce(n_left, 0) AS n_left", f"{_STATUS} AS status", "session_id % 5 AS resumes")
    return runs.resumable(table).select("session_id", "n_left", "action")


@register("batched_work", f"{oracle_views('photo')} SELECT photo_id, CASE WHEN photo_id % 100 = 0 THEN NULL ELSE photo_id * 2.0 END::DOUBLE AS value, CASE WHEN photo_id % 100 = 0 THEN 'ValueError: damaged' END AS error FROM photo")
def batched_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in batches over all photos, of which some make their batch fail."""

    def work(rows: list[dict]) -> list[float]:
        if any(r["photo_id"] % 100 == 0 for r in rows):
            raise ValueError("damaged")
        return [r["photo_id"] * 2.0 for r in rows]

    return runs.run_batches(view(spark, sf_dir, "photo").select("photo_id"), "photo_id", work)
