"""Catalog writes and maintenance as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import maintenance as m
from quillon.operators import ranking
from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").where("photo_id % 10 < 8").selectExpr("photo_id AS path", "mtime AS fast_key", "ai_score")


@register("catalog_upsert", f"{oracle_views('photo')}, o AS (SELECT photo_id AS path, mtime AS k, ai_score FROM photo WHERE photo_id % 10 < 8), n AS (SELECT photo_id AS path, mtime + CASE WHEN photo_id % 4 = 0 THEN 1 ELSE 0 END AS k FROM photo WHERE photo_id % 10 > 3) SELECT path, coalesce(n.k, o.k) AS fast_key, coalesce((n.k IS NULL OR n.k = o.k) AND ai_score IS NOT NULL, false) AS scored, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k <> o.k THEN 'updated' ELSE 'kept' END AS action FROM o FULL JOIN n USING (path)")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = view(spark, sf_dir, "photo").where("photo_id % 10 > 3").selectExpr("photo_id AS path", "mtime + CASE WHEN photo_id % 4 = 0 THEN 1 ELSE 0 END AS fast_key")
    got = m.upsert(_old(spark, sf_dir), new, ["path"], "fast_key", ["ai_score"])
    return got.select("path", "fast_key", F.col("ai_score").isNotNull().alias("scored"), "action")


@register("insert_membership", f"{oracle_views('photo')} SELECT DISTINCT session_id, photo_id FROM photo")
def insert_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("session_id", "photo_id")
    return m.insert_new(p.where("photo_id % 3 <> 0"), p.where("photo_id % 2 = 0").union(p.where("photo_id % 3 = 0")), ["session_id", "photo_id"])


@register("apply_metadata", f"{oracle_views('photo')} SELECT photo_id, CASE WHEN photo_id % 3 = 0 AND photo_id % 5 <> 0 THEN 'new' ELSE lens END AS lens FROM photo")
def apply_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("photo_id", "lens")
    return m.apply_metadata(p, p.where("photo_id % 3 = 0").select("photo_id", F.when(F.col("photo_id") % 5 != 0, "new").alias("lens")))


@register("ingest_faces", f"{oracle_views('face')} SELECT photo_id, person_id, line FROM face WHERE photo_id % 4 <> 0 UNION ALL SELECT photo_id, person_id, line + 100 FROM face WHERE photo_id % 4 = 0 AND line < 4 UNION ALL SELECT photo_id, person_id, line FROM face f WHERE photo_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM face g WHERE g.photo_id = f.photo_id AND g.line < 4)")
def ingest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "face").select("photo_id", "person_id", "line")
    return m.replace_by_key(f, f.where("photo_id % 4 = 0 AND line < 4").withColumn("line", F.col("line") + 100), "photo_id")


@register("merge_versions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"b\":\"2\",\"k\":\"9\"}' ELSE '{\"a\":\"1\",\"b\":\"2\",\"k\":\"9\"}' END AS merged FROM events")
def merge_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    old = F.when(F.col("event_id") % 3 == 0, F.lit("not json")).otherwise(F.lit('{"a":"1","k":"5"}'))
    return e.select("event_id", m.merge_versions(old, F.lit('{"b":"2","k":"9"}')).alias("merged"))


_FILES = "f AS (SELECT photo_id, session_id % 7 AS root_id, 'x' || photo_id % 251 AS stem, CASE WHEN lower(file_name) LIKE '%.jpg' THEN 'jpeg' WHEN file_name LIKE '%.heic' THEN 'heif' ELSE 'raw' END AS format FROM photo)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").select("photo_id", (F.col("session_id") % 7).alias("root_id"), F.concat(F.lit("X"), (F.col("photo_id") % 251).cast("string"), F.regexp_extract("file_name", r"\.[^.]*$", 0)).alias("rel_path"), m.file_format(F.col("file_name")).alias("format"))


@register("pair_files", f"{oracle_views('photo')}, {_FILES}, p AS (SELECT root_id, stem, arg_min(photo_id, (CASE format WHEN 'jpeg' THEN 0 ELSE 1 END, photo_id)) AS pair_id FROM f WHERE format <> 'raw' GROUP BY 1, 2) SELECT photo_id, pair_id FROM f JOIN p USING (root_id, stem) WHERE format = 'raw'")
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pair_files(_files(spark, sf_dir))


@register("export_members", f"{oracle_views('photo')}, i AS (SELECT photo_id AS pos, photo_id FROM photo WHERE pair_id IS NULL), c AS (SELECT i.pos, p.photo_id FROM i JOIN photo p ON p.pair_id = i.photo_id) SELECT pos, photo_id FROM c UNION ALL SELECT pos, photo_id FROM i WHERE pos NOT IN (SELECT pos FROM c)")
def export_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("photo_id", "pair_id")
    return m.export_members(p.where("pair_id IS NULL").select(F.col("photo_id").alias("pos"), "photo_id"), p.where("pair_id IS NOT NULL"), "raw")


@register("card_new_files", f"{oracle_views('photo')}, c AS (SELECT photo_id, lower(file_name) AS n, width AS s, photo_id % 700 AS k FROM photo) SELECT photo_id FROM c WHERE photo_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.photo_id % 50 = 1 AND o.n = c.n AND o.s = c.s) AND k NOT IN (SELECT k FROM c WHERE photo_id % 50 = 1)")
def card_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("photo_id", "file_name", F.col("width").alias("file_size"), (F.col("photo_id") % 700).cast("string").alias("content_key"))
    return m.unknown_files(p.where("photo_id % 2 = 0"), p.where("photo_id % 50 = 1")).select("photo_id")


@register("mark_presence", f"{oracle_views('photo')} SELECT photo_id, CASE WHEN photo_id % 9 = 4 THEN 1 ELSE 0 END AS missing FROM photo")
def mark_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("photo_id", F.col("photo_id").cast("string").alias("rel_path"), "missing")
    return m.mark_presence(p, p.where("photo_id % 9 <> 4")).select("photo_id", "missing")


@register("missing_steps", "SELECT CASE event_id % 4 WHEN 0 THEN 'embed,iqa,faces' WHEN 1 THEN 'iqa,faces' WHEN 2 THEN 'faces' ELSE 'iqa' END AS steps, count(*)::BIGINT AS n, min(event_id) AS first FROM events GROUP BY 1")
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    versions = F.expr("""CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"embed":"1"}' WHEN 2 THEN '{"embed":"1","iqa":"2"}' ELSE '{"embed":"1","skipped":{"faces":"abc"}}' END""")
    got = m.missing_steps(e.select(F.col("event_id").alias("photo_id"), versions.alias("model_versions")), ["embed", "iqa", "faces"], "abc")
    return got.select("steps", F.size("photo_ids").cast("long").alias("n"), F.element_at("photo_ids", 1).alias("first"))


@register("task_history", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'view') WHERE r <= 200 UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def task_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('view', 'error')")
    return m.recent(e.selectExpr("event_id AS task_id", "ts AS created_at", "CASE WHEN event_type = 'view' THEN 'done' ELSE 'running' END AS status")).select(F.col("task_id").alias("event_id"))


@register("sidecar_sync", f"{oracle_views('photo')} SELECT photo_id, CASE WHEN photo_id % 6 = 0 THEN 5 ELSE user_rating END AS rating, CASE WHEN photo_id % 2 <> 0 THEN CASE WHEN user_rating IS NULL AND color_label IS NULL THEN 'equal' ELSE 'catalog' END WHEN user_rating IS NOT DISTINCT FROM 5 AND color_label IS NOT DISTINCT FROM color_label THEN 'equal' WHEN photo_id % 3 = 0 THEN 'sidecar' ELSE 'catalog' END AS source  FROM photo")
def sidecar_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    cars = p.where("photo_id % 2 = 0").selectExpr("photo_id", "5 AS rating", "color_label AS label", "10L AS file_mtime", "CASE WHEN photo_id % 3 = 0 THEN 9L ELSE 10L END AS seen_mtime")
    return m.sync_sidecars(p.select("photo_id", F.col("user_rating").alias("rating"), F.col("color_label").alias("label")), cars).select("photo_id", "rating", "source")


@register("orphan_people", f"{oracle_views('face')} SELECT c_custkey AS person_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT person_id FROM face WHERE person_id IS NOT NULL)")
def orphan_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"))
    return m.orphans(c, view(spark, sf_dir, "face")).select("person_id")


@register("manual_overrides", f"{oracle_views('photo')} SELECT photo_id, CASE WHEN photo_id % 6 = 0 THEN -2 WHEN photo_id % 3 = 0 THEN -1 ELSE burst_id END AS burst_id FROM photo")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").select("photo_id", "burst_id")
    made = p.where("photo_id % 3 = 0").selectExpr("photo_id", "-1L AS burst_id", "1 AS made_at").union(p.where("photo_id % 6 = 0").selectExpr("photo_id", "-2L", "2"))
    return m.with_overrides(p, made, "photo_id", "burst_id")


@register("merge_people", f"{oracle_views('face')} SELECT CASE WHEN person_id IN (1, 2) THEN 3 ELSE person_id END AS person_id, count(*)::BIGINT AS n FROM face GROUP BY 1")
def merge_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.merge_people(view(spark, sf_dir, "face"), {1: 2, 2: 3}).groupBy("person_id").agg(F.count("*").alias("n"))


@register("max_suffix", "SELECT max(try_cast(regexp_extract('task-' || event_type || '-' || event_id, '-(\\d+)$', 1) AS BIGINT)) AS n FROM events")
def max_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(m.max_suffix(F.concat(F.lit("task-"), "event_type", F.lit("-"), F.col("event_id").cast("string"))).alias("n"))


@register("rejected_files", f"{oracle_views('photo')}, r AS (SELECT photo_id FROM photo WHERE flag = -1 AND pair_id IS NULL) SELECT photo_id AS group_id, photo_id, 1 AS is_primary FROM r UNION ALL SELECT pair_id, photo_id, 0 FROM photo WHERE pair_id IN (SELECT photo_id FROM r)")
def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rejected_with_companions(view(spark, sf_dir, "photo"))


@register("theta_candidates", f"{oracle_views('face')}, f AS (SELECT part_key * 1000 + line * 100 + supplier AS face_id, person_id, photo_id % 5000 AS track_id, photo_id % 300 AS session_id FROM face), t AS (SELECT DISTINCT * FROM f WHERE face_id % 100 = 0) SELECT DISTINCT t.face_id AS target_id, f.face_id FROM t JOIN f ON f.face_id <> t.face_id AND (f.person_id = t.person_id OR f.track_id = t.track_id OR (f.person_id IS NULL AND f.session_id = t.session_id))")
def theta_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "face").selectExpr("part_key * 1000 + line * 100 + supplier AS face_id", "person_id", "photo_id % 5000 AS track_id", "photo_id % 300 AS session_id")
    return m.theta_candidates(f.where("face_id % 100 = 0").distinct(), f)


@register("session_list", f"{oracle_views('photo')} SELECT c_custkey AS session_id, n_name AS root, count(photo_id)::BIGINT AS photo_count FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN photo ON session_id = c_custkey GROUP BY 1, 2")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("session_id"), "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("root"))
    counts = view(spark, sf_dir, "photo").groupBy("session_id").agg(F.count("*").alias("n"))
    return c.join(counts, "session_id", "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("session_id", "root", F.coalesce("n", F.lit(0)).alias("photo_count"))


@register("accept_ai", f"{oracle_views('photo')} SELECT photo_id, coalesce(round(ai_rating)::INT, user_rating) AS user_rating FROM photo")
def accept_ai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").select("photo_id", F.coalesce(F.round("ai_rating").cast("int"), "user_rating").alias("user_rating"))


@register("tag_normalize", "SELECT p_partkey, p_brand || ',' || p_name || ',tag' AS tags FROM part")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    messy = F.array(F.concat(F.lit("  "), "p_brand"), F.concat("p_name", F.lit("\t ")), F.col("p_brand"), F.lit(" "), F.lit("\x01tag"))
    return p.select("p_partkey", F.array_join(exprs.normal_tags(messy), ",").alias("tags"))


@register("photo_detail", f"{oracle_views('photo', 'burst')} SELECT p.photo_id, coalesce(n.n, 0)::BIGINT AS burst_size, b.scene_id FROM photo p LEFT JOIN (SELECT burst_id, count(*) AS n FROM photo GROUP BY 1) n ON n.burst_id = p.burst_id LEFT JOIN (SELECT DISTINCT burst_id, scene_id FROM burst) b ON b.burst_id = p.burst_id")
def photo_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide projection: scalar look-ups as left joins on unique keys."""
    p = view(spark, sf_dir, "photo").select("photo_id", "burst_id")
    sizes = p.where("burst_id IS NOT NULL").groupBy("burst_id").agg(F.count("*").alias("n"))
    return p.join(sizes, "burst_id", "left").join(view(spark, sf_dir, "burst").select("burst_id", "scene_id").distinct(), "burst_id", "left").select("photo_id", F.coalesce("n", F.lit(0)).alias("burst_size"), "scene_id")


@register("name_info", f"{oracle_views('photo', 'burst', 'scene')} SELECT p.photo_id, coalesce('event-' || s.event_id, 'session ' || p.session_id) AS event, b.scene_id FROM photo p LEFT JOIN (SELECT DISTINCT burst_id, scene_id FROM burst) b ON b.burst_id = p.burst_id LEFT JOIN (SELECT DISTINCT scene_id, event_id FROM scene) s ON s.scene_id = b.scene_id")
def name_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    titles = p.selectExpr("photo_id", "session_id", "'session ' || session_id AS title")
    return ranking.name_info(p, view(spark, sf_dir, "burst"), view(spark, sf_dir, "scene"), titles)


@register("thumbnail_queue", f"{oracle_views('photo')}, q AS (SELECT photo_id, mtime AS queued_at, CASE WHEN photo_id % 5 = 0 THEN mtime + photo_id % 7 END AS boosted_at, photo_id % 50 AS lane FROM photo) SELECT photo_id, (row_number() OVER (PARTITION BY lane ORDER BY boosted_at IS NULL, boosted_at DESC, queued_at, photo_id))::INT AS place FROM q")
def thumbnail_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "photo").selectExpr("photo_id", "mtime AS queued_at", "CASE WHEN photo_id % 5 = 0 THEN mtime + photo_id % 7 END AS boosted_at", "photo_id % 50 AS lane")
    return q.select("photo_id", F.row_number().over(Window.partitionBy("lane").orderBy(*ranking.thumbnail_order())).alias("place"))


_SETS = "a AS (SELECT photo_id FROM photo WHERE flag = 1), b AS (SELECT photo_id FROM photo WHERE user_rating >= 3)"


@register("set_operations", f"{oracle_views('photo')}, {_SETS} SELECT 'union' AS op, photo_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', photo_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', photo_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    a, b = p.where("flag = 1").select("photo_id"), p.where("user_rating >= 3").select("photo_id")
    named = lambda n, df: df.select(F.lit(n).alias("op"), "photo_id")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.subtract(b)))
