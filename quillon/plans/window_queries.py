"""Segments, rankings, joins in time and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import alignment, duplicates, ranking, scoring, search, segments
from quillon.plans.registry import register
from quillon.sources import scratch
from quillon.sources.views import oracle_views, view

_BETTER = "coalesce(ai_score, -1) DESC, coalesce(user_rating, 0) DESC, photo_id"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time units of users: an event and its length in ms."""
    return view(spark, sf_dir, "item").selectExpr("user_id AS session_id", "event_id AS id", "t AS start_at", "t + CAST(value * 1000 AS bigint) AS end_at", "event_id % 500 AS vec_id", "40.0 + event_id % 97 / 500.0 AS lat", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 10.0 END AS lon")


_UNITS = "u AS (SELECT user_id AS session_id, event_id AS id, t AS start_at, t + trunc(value * 1000)::BIGINT AS end_at, event_id % 500 AS vec_id, 40.0::DOUBLE + event_id % 97 / 500.0::DOUBLE AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 10.0::DOUBLE END AS lon FROM item)"


@register("scene_segments", f"""{oracle_views('item')}, {_UNITS}, l AS (SELECT u.*, start_at - lag(end_at) OVER w AS gap, list_cosine_similarity(e.embedding::DOUBLE[], lag(e.embedding::DOUBLE[]) OVER w) AS c
 FROM u JOIN embeddings e USING (vec_id) WINDOW w AS (PARTITION BY session_id ORDER BY start_at, id))
 SELECT session_id, id, (sum(CASE WHEN gap IS NOT NULL AND NOT (gap <= 36000000 AND c >= 0.05) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_at, id))::BIGINT AS scene_no FROM l""")
def scene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    units = _units(spark, sf_dir).join(vectors, "vec_id").withColumn("phash", F.lit(None).cast("long"))
    return segments.scenes(units, segments.GroupParams(scene_gap_ms=36_000_000, scene_cos=0.05)).select("session_id", "id", "scene_no")


@register("event_split", f"""{oracle_views('item')}, {_UNITS}, l AS (SELECT *, max(end_at) OVER b AS latest, last_value(CASE WHEN lon IS NOT NULL THEN lat END IGNORE NULLS) OVER b AS plat FROM u WINDOW b AS (PARTITION BY session_id ORDER BY start_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, coalesce(start_at - latest > 7200000, false) OR coalesce(lon IS NOT NULL AND plat IS NOT NULL AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2)))) > 5000, false) AS cut FROM l)
 SELECT session_id, id, (sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_at, id))::BIGINT AS event_no FROM c""")
def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.when(F.col("lon").isNotNull(), F.col("lat"))
    units = _units(spark, sf_dir).select("session_id", "id", "start_at", "end_at", lat.alias("first_lat"), F.col("lon").alias("first_lon"), lat.alias("last_lat"), F.col("lon").alias("last_lon"))
    return segments.events(units).select("session_id", "id", "event_no")


def _burst_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "item")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding"))
    # Neighbouring events share a vector, so that bursts exist.
    made = rows.selectExpr("1L AS session_id", "event_id AS id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE t END AS t", "'n' || event_id % 7 AS name", "event_id % 2 AS device", "CAST(event_id DIV 4 * 1000003 AS bigint) AS phash", "event_id DIV 6 % 500 AS vec_id")
    return made.join(vectors, "vec_id").drop("vec_id")


@register("burst_segments")
def burst_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy look-back segmentation of the global event order; tests compare it with an unchunked pass."""
    return segments.bursts(_burst_items(spark, sf_dir), segments.GroupParams(t_burst_ms=30_000))


@register("adaptive_t_burst", f"""{oracle_views('item')}, g AS (SELECT user_id % 5 AS k, greatest(200, greatest(0, t - lag(t) OVER (PARTITION BY user_id % 5 ORDER BY t, event_id)))::DOUBLE AS gap FROM item),
 p AS (SELECT k, gap, lead(gap) OVER (PARTITION BY k ORDER BY gap) AS hi, count(*) OVER (PARTITION BY k) AS n FROM g WHERE gap <= 20000),
 b AS (SELECT k, max(n) AS n, max(CASE WHEN gap >= 300 AND hi <= 10000 AND hi > gap THEN hi / gap END) AS ratio, arg_max(sqrt(gap * hi), (hi / gap, -gap)) FILTER (gap >= 300 AND hi <= 10000 AND hi > gap) AS mid FROM p GROUP BY k)
 SELECT d.k, CASE WHEN n >= 20 AND ratio >= 1.5 THEN least(greatest(floor(mid), 1000), 5000)::BIGINT ELSE 3000 END AS t_burst FROM (SELECT DISTINCT user_id % 5 AS k FROM item) d LEFT JOIN b USING (k)""")
def adaptive_t_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.adaptive_t_burst(view(spark, sf_dir, "item").selectExpr("user_id % 5 AS k", "event_id AS id", "t"), "k")


_OK = "coalesce(gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT (gps_lat = 0 AND gps_lon = 0), false)"


@register("first_last_fix", f"{oracle_views('photo')} SELECT burst_id, arg_min(gps_lat, (coalesce(taken_at, mtime), photo_id)) FILTER ({_OK}) AS first_lat, arg_min(gps_lon, (coalesce(taken_at, mtime), photo_id)) FILTER ({_OK}) AS first_lon, arg_max(gps_lat, (coalesce(taken_at, mtime), photo_id)) FILTER ({_OK}) AS last_lat, arg_max(gps_lon, (coalesce(taken_at, mtime), photo_id)) FILTER ({_OK}) AS last_lon FROM photo WHERE burst_id IS NOT NULL GROUP BY 1")
def first_last_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.first_last_fix(view(spark, sf_dir, "photo").where("burst_id IS NOT NULL"), "burst_id")


@register("haversine", "SELECT event_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(a2 - a1) / 2), 2) + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2)))), 3) AS m FROM (SELECT event_id, (event_id % 170 - 85)::DOUBLE AS a1, (event_id % 350 - 175)::DOUBLE AS o1, (user_id % 170 - 85)::DOUBLE AS a2, (user_id * 7 % 350 - 175)::DOUBLE AS o2 FROM events)")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "double(event_id % 170 - 85) AS a1", "double(event_id % 350 - 175) AS o1", "double(user_id % 170 - 85) AS a2", "double(user_id * 7 % 350 - 175) AS o2")
    return e.select("event_id", F.round(exprs.haversine_m(*(F.col(c) for c in ("a1", "o1", "a2", "o2"))), 3).alias("m"))


@register("event_names", f"""{oracle_views('photo')}, n AS (SELECT photo_id, epoch_ms(mtime + coalesce(offset_min, 0) * 60000) AS s, epoch_ms(mtime + photo_id % 100 * 3600000 + coalesce(offset_min, 0) * 60000) AS e FROM photo)
 SELECT photo_id, CASE WHEN s::DATE = e::DATE AND strftime(s, '%H:%M') = strftime(e, '%H:%M') THEN strftime(s, '%Y-%m-%d %H:%M') WHEN s::DATE = e::DATE THEN strftime(s, '%Y-%m-%d %H:%M') || '-' || strftime(e, '%H:%M') WHEN year(s) = year(e) THEN strftime(s, '%Y-%m-%d %H:%M') || '-' || strftime(e, '%m-%d %H:%M') ELSE strftime(s, '%Y-%m-%d %H:%M') || '-' || strftime(e, '%Y-%m-%d %H:%M') END AS name FROM n""")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").select("photo_id", exprs.event_name(F.col("mtime"), F.col("mtime") + F.col("photo_id") % 100 * 3_600_000, F.col("offset_min")).alias("name"))


@register("stack_collapse", f"""{oracle_views('photo')}, g AS (SELECT *, coalesce(burst_id, -photo_id - 1) AS g, coalesce(taken_at, mtime) AS t FROM photo), m AS (SELECT *, CASE WHEN lag(g) OVER (PARTITION BY session_id ORDER BY t, photo_id) IS NOT DISTINCT FROM g THEN 0 ELSE 1 END AS new FROM g),
 s AS (SELECT *, (sum(new) OVER (PARTITION BY session_id ORDER BY t, photo_id))::BIGINT AS stack FROM m) SELECT session_id, stack, arg_min(photo_id, (rank_in_burst, photo_id)) AS cover, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""")
def stack_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.stacks(view(spark, sf_dir, "photo"))


_SPANS = "s AS (SELECT session_id, id AS span_id, start_at, end_at FROM u WHERE id % 10 = 0), q AS (SELECT session_id, id, start_at + 20000 AS t FROM u)"


@register("as_of_scene", f"{oracle_views('item')}, {_UNITS}, {_SPANS} SELECT q.session_id, q.id, q.t, CASE WHEN q.t <= s.end_at THEN s.span_id END AS span_id FROM q ASOF LEFT JOIN s ON q.session_id = s.session_id AND q.t >= s.start_at")
def as_of_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    spans = units.where("id % 10 = 0").select("session_id", F.col("id").alias("span_id"), "start_at", "end_at")
    return segments.as_of(units.select("session_id", "id", (F.col("start_at") + 20_000).alias("t")), spans, "session_id")


@register("even_thinning", f"{oracle_views('item')}, r AS (SELECT user_id, event_id AS id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM item) SELECT user_id, id, t FROM r WHERE n <= 15 OR r IN (SELECT i * n // 15 FROM range(15) x(i))")
def even_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.even_thinning(view(spark, sf_dir, "item").selectExpr("user_id", "event_id AS id", "t"), "user_id", 15)


@register("keep_top_bursts", f"{oracle_views('photo')} SELECT photo_id, burst_id, row_number() OVER (PARTITION BY burst_id ORDER BY {_BETTER}) <= 2 AS kept FROM photo WHERE burst_id IS NOT NULL AND flag >= 0")
def keep_top_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_in_bursts(view(spark, sf_dir, "photo"), 2)


@register("keep_top_scenes", f"{oracle_views('photo', 'burst')}, d AS (SELECT p.*, scene_id, row_number() OVER (PARTITION BY burst_id ORDER BY {_BETTER}) AS depth FROM photo p JOIN (SELECT DISTINCT burst_id, scene_id FROM burst) b USING (burst_id) WHERE flag >= 0) SELECT photo_id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY depth, {_BETTER}) <= 3 AS kept FROM d")
def keep_top_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_in_scenes(view(spark, sf_dir, "photo"), view(spark, sf_dir, "burst"), 3)


@register("best_of_people", f"""{oracle_views('photo', 'face')}, b AS (SELECT person_id, photo_id, max(eyes_open) AS e FROM face WHERE person_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT b.*, burst_id, 0.6 * coalesce(e, 0.5) + 0.4 * coalesce(ai_score, 0.5) AS s FROM b JOIN photo USING (photo_id) WHERE flag >= 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY person_id, burst_id IS NULL, coalesce(burst_id, photo_id) ORDER BY s DESC, photo_id) AS r FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s DESC, photo_id) AS position FROM o WHERE r = 1) SELECT person_id, photo_id, round(s, 4) AS score, position::INT AS position FROM t WHERE position <= 10""")
def best_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_of_people(view(spark, sf_dir, "photo"), view(spark, sf_dir, "face").withColumn("expression", F.col("eyes_open")), 10)


@register("best_take", f"""{oracle_views('photo', 'face')}, b AS (SELECT burst_id, person_id, f.photo_id, rank_in_burst, max(eyes_open) AS e FROM face f JOIN photo p ON p.photo_id = f.photo_id WHERE person_id IS NOT NULL AND burst_id IS NOT NULL AND abs(coalesce(yaw, 0)) <= 25 AND abs(coalesce(pitch, 0)) <= 25 GROUP BY ALL)
 SELECT burst_id, person_id, photo_id, row_number() OVER (PARTITION BY burst_id, person_id ORDER BY e DESC, rank_in_burst, photo_id)::INT AS position FROM b""")
def best_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "photo").select("photo_id", "burst_id", "rank_in_burst")
    return ranking.best_take(view(spark, sf_dir, "face").join(photos, "photo_id").withColumn("expression", F.col("eyes_open")))


@register("cull_deck", f"{oracle_views('photo')}, r AS (SELECT burst_id, photo_id, count(*) OVER (PARTITION BY burst_id) AS n, row_number() OVER (PARTITION BY burst_id ORDER BY rank_in_burst, photo_id)::INT AS r FROM photo WHERE burst_id IS NOT NULL) SELECT burst_id, photo_id, r FROM r WHERE n >= 2 AND r <= 3")
def cull_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cull_deck(view(spark, sf_dir, "photo"), 3)


@register("donor_ranking", f"""{oracle_views('photo', 'face')}, c AS (SELECT DISTINCT p.photo_id, person_id, session_id, mtime AS t, coalesce(ai_score, 0.0) AS score FROM face f JOIN photo p ON p.photo_id = f.photo_id WHERE person_id IS NOT NULL)
 SELECT a.photo_id AS target_id, a.person_id, c.photo_id, row_number() OVER (PARTITION BY a.photo_id, a.person_id ORDER BY (c.session_id = a.session_id) DESC, c.score DESC, abs(floor((c.t - a.t) / 60000.0)), c.photo_id)::INT AS position FROM c a JOIN c ON c.person_id = a.person_id AND c.photo_id <> a.photo_id WHERE a.photo_id % 100 = 0""")
def donor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors of the photos that are being retouched: a stated set of targets against all photos."""
    p = view(spark, sf_dir, "photo").select("photo_id", "session_id", F.col("mtime").alias("t"), F.coalesce("ai_score", F.lit(0.0)).alias("score"))
    c = scratch.materialize(view(spark, sf_dir, "face").where("person_id IS NOT NULL").select("photo_id", "person_id").join(p, "photo_id").distinct(), "donors", freed=True)
    return ranking.donors(c.where("photo_id % 100 = 0"), c)


@register("best_box_match", f"""{oracle_views('face')}, f AS (SELECT photo_id, part_key * 10 + line AS id, x, y, w, h FROM face), p AS (SELECT a.id AS locked_id, b.id AS face_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h AS aa, b.w * b.h AS bb FROM f a JOIN f b ON a.photo_id = b.photo_id AND a.id <> b.id)
 SELECT locked_id, round(max(i / (aa + bb - i)), 5) AS iou FROM p WHERE i / (aa + bb - i) >= 0.2001 GROUP BY 1""")
def best_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "face").selectExpr("photo_id", "part_key * 10 + line AS id", "x", "y", "w", "h")
    shifted = f.select("photo_id", F.col("id").alias("locked_id"), *[F.col(c).alias("a" + c) for c in "xywh"])
    other = f.select("photo_id", F.col("id").alias("face_id"), *[F.col(c).alias("b" + c) for c in "xywh"])
    pairs = shifted.join(other, "photo_id").where("locked_id <> face_id").withColumn("iou", ranking.iou("a", "b")).where("iou >= 0.2001")
    return pairs.groupBy("locked_id").agg(F.round(F.max("iou"), 5).alias("iou"))


@register("union_boxes", f"{oracle_views('face')} SELECT photo_id, round((min(x) + max(x + w)) / 2, 6) AS cx, round((min(y) + max(y + h)) / 2, 6) AS cy FROM face GROUP BY 1")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.union_boxes(view(spark, sf_dir, "face")).select("photo_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


_CLEAN = "coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0)"


@register("vector_search", f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 11), c AS (SELECT vec_id, {_CLEAN} AS c FROM embeddings, q), s AS (SELECT least(0.6, avg(c) + 2 * stddev_pop(c)) AS cut FROM c) SELECT vec_id, round(c, 4) AS similarity, round(1 / (1 + exp(-(112.67 * c - 16.5))), 4) AS score FROM c, s WHERE c >= cut")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.ranked(e, e.where("vec_id = 11").first().embedding, "vec_id", "embedding", confident=0.6)


@register("vector_search_min_score", f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 11), c AS (SELECT vec_id, {_CLEAN} AS c FROM embeddings, q) SELECT vec_id, round(c, 4) AS similarity, round(1 / (1 + exp(-(112.67 * c - 16.5))), 4) AS score FROM c WHERE 1 / (1 + exp(-(112.67 * c - 16.5))) >= 0.9 ORDER BY c DESC, vec_id LIMIT 20")
def vector_search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.ranked(e, e.where("vec_id = 11").first().embedding, "vec_id", "embedding", min_score=0.9, limit=20)


@register("vector_search_summary", f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 11), c AS (SELECT {_CLEAN} AS c FROM embeddings, q) SELECT count(*)::BIGINT AS searched, 0::BIGINT AS unindexed, max(c) < 0.6 AS low_confidence, round(least(0.6, avg(c) + 2 * stddev_pop(c)), 4) AS min_similarity FROM c")
def vector_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.summary(e, e.where("vec_id = 11").first().embedding, "embedding", confident=0.6)


@register("face_search", f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5), c AS (SELECT vec_id, round({_CLEAN}, 4) AS similarity FROM embeddings, q) SELECT * FROM c WHERE similarity >= 0.25 ORDER BY similarity DESC, vec_id LIMIT 10")
def face_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search.nearest_centroids(e, e.where("vec_id = 5").first().embedding, "vec_id", "embedding")


def _dup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: content key, size and a 64-bit hash of the whole text, some bits of which differ between copies."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hash64 = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    return d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_key"), F.col("n_chars").alias("file_size"), hash64.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 3 AS int))")).alias("phash"), F.lit(4000).alias("width"), (F.lit(3000) + F.col("doc_id") % 2 * 10).alias("height"), (F.col("doc_id") % 3 != 0).alias("has_time"))


_DUP = "d AS (SELECT doc_id AS id, sha256(text) AS content_key, n_chars AS file_size, xor(('0x' || substr(md5(text), 1, 15))::BIGINT, 1::BIGINT << (doc_id % 3)::INT) AS phash, 4000 AS width, 3000 + doc_id % 2 * 10 AS height, doc_id % 3 <> 0 AS has_time FROM documents)"
_NEAR = "n AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM d a JOIN d b ON a.id < b.id AND bit_count(xor(a.phash, b.phash)) <= 4 AND NOT (a.has_time AND b.has_time) AND abs(a.width * b.height - a.height * b.width) <= 0.01 * greatest(a.width * b.height, a.height * b.width))"
_EXACT = "x AS (SELECT id, min(id) OVER w AS g, count(*) OVER w AS c FROM d WINDOW w AS (PARTITION BY content_key, file_size))"


@register("exact_duplicates", f"WITH {_DUP}, {_EXACT} SELECT id, g AS group_id FROM x WHERE c > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(_dup_items(spark, sf_dir))


@register("near_duplicate_pairs", f"WITH {_DUP}, {_NEAR} SELECT a, b FROM n")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_pairs(_dup_items(spark, sf_dir))


@register("duplicate_groups", f"""WITH RECURSIVE {_DUP}, {_NEAR}, {_EXACT}, e AS (SELECT a, b FROM n UNION SELECT b, a FROM n UNION SELECT id, g FROM x WHERE c > 1 AND id <> g UNION SELECT g, id FROM x WHERE c > 1 AND id <> g),
 r AS (SELECT DISTINCT a AS id, a AS t FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.t) SELECT r.id, min(t) AS group_id, CASE WHEN max(c) > 1 THEN 'exact' ELSE 'near' END AS kind FROM r JOIN x ON x.id = r.id GROUP BY 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_groups(_dup_items(spark, sf_dir))


@register("duplicate_changes", f"WITH {_DUP}, {_EXACT} SELECT id, CASE WHEN c > 1 THEN g END AS group_id, CASE WHEN c > 1 THEN 'exact' END AS kind FROM x WHERE (CASE WHEN c > 1 THEN g END, CASE WHEN c > 1 THEN 'exact' END) IS DISTINCT FROM (CASE WHEN id % 4 = 0 THEN id END, CASE WHEN id % 4 = 0 THEN 'exact' END)")
def duplicate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _dup_items(spark, sf_dir)
    new = duplicates.exact_groups(items).withColumn("kind", F.lit("exact"))
    old = items.where("id % 4 = 0").select("id", F.col("id").alias("group_id"), F.lit("exact").alias("kind"))
    return duplicates.changes(old, new)


@register("leave_one_out_blur", f"{oracle_views('photo')} SELECT a.photo_id, round(median(b.sharpness), 6) AS others, coalesce(a.sharpness < 0.85 * median(b.sharpness), false) AS blurred FROM photo a JOIN photo b ON a.burst_id = b.burst_id AND a.photo_id <> b.photo_id GROUP BY a.photo_id, a.sharpness")
def leave_one_out_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo").where("burst_id IS NOT NULL").select("burst_id", "photo_id", "sharpness")
    other = p.select("burst_id", F.col("photo_id").alias("o"), F.col("sharpness").alias("s"))
    got = p.join(other, "burst_id").where("photo_id <> o").groupBy("photo_id", "sharpness").agg(F.median("s").alias("m"))
    return got.select("photo_id", F.round("m", 6).alias("others"), F.coalesce(F.col("sharpness") < scoring.BLURRY_IN_BURST * F.col("m"), F.lit(False)).alias("blurred"))


def _devices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two devices that saw the same things, the second clock 90 s behind, with some noise."""
    e = view(spark, sf_dir, "item").selectExpr("event_id AS id", "t", "event_id * 2654435761 % 4611686018427387904 AS phash", "cast(null AS array<double>) AS embedding")
    return e, e.selectExpr("id", "t - 90000 - id % 7 * 100 AS t", "phash", "embedding")


_DEVICES = "e AS (SELECT event_id AS id, t, event_id * 2654435761 % 4611686018427387904 AS h FROM item)"
_MUTUAL = f"{_DEVICES}, p AS (SELECT a.id AS a, b.id AS b, a.t AS ta, b.t - 90000 - b.id % 7 * 100 AS tb, 1 - bit_count(xor(a.h, b.h)) / 64.0 AS s FROM e a JOIN e b ON bit_count(xor(a.h, b.h)) <= 8 AND abs(a.t - (b.t - 90000 - b.id % 7 * 100)) <= 3600000), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, tb, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, ta, a) AS rb FROM p), m AS (SELECT ta AS t, ta - tb AS delta FROM r WHERE ra = 1 AND rb = 1)"


@register("mutual_matches", f"{oracle_views('item')}, {_MUTUAL} SELECT t, delta FROM m")
def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.mutual_matches(*_devices(spark, sf_dir), alignment.AlignParams(max_offset_ms=3_600_000))


@register("densest_offset", f"{oracle_views('item')}, {_MUTUAL}, c AS (SELECT delta, count(*) OVER (ORDER BY delta RANGE BETWEEN CURRENT ROW AND 120000 FOLLOWING) AS n FROM m) SELECT arg_max(delta, (n, -delta)) AS low, max(n)::BIGINT AS n FROM c")
def densest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = alignment.AlignParams(max_offset_ms=3_600_000)
    return alignment.densest_window(alignment.mutual_matches(*_devices(spark, sf_dir), p), p)


@register("offset_peaks")
def offset_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets between devices of ten people, whose matches agree but for one in five; tests hold the rule."""
    e = view(spark, sf_dir, "item").selectExpr("user_id % 10 AS low", "user_id % 10 + 1 AS high", "t", "CASE WHEN event_id % 5 = 0 THEN event_id * 2654435761 % 86400000 - 43200000 ELSE user_id % 10 * 60000 + event_id * 977 % 5000 END AS delta")
    got = alignment.offset_peaks(e, ["low", "high"])
    return got.select("low", "high", "offset", "support", F.round("confidence", 6).alias("confidence"))


@register("gps_anchors", f"""{oracle_views('item')}, g AS (SELECT user_id AS device, CASE WHEN event_id % 4 = 0 THEN NULL WHEN user_id % 3 = 0 THEN event_id * 977 % 60000 ELSE 5000 + event_id * 977 % 3000 END AS d FROM item), l AS (SELECT device, list_sort(list(d) FILTER (d IS NOT NULL)) AS v FROM g GROUP BY 1),
 m AS (SELECT *, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE v[len(v) // 2] + (v[len(v) // 2 + 1] - v[len(v) // 2]) // 2 END AS m FROM l WHERE len(v) >= 3), n AS (SELECT *, list_filter(v, lambda x: abs(x - m) <= 5000) AS near FROM m)
 SELECT device, CASE WHEN len(near) % 2 = 1 THEN near[len(near) // 2 + 1] ELSE near[len(near) // 2] + (near[len(near) // 2 + 1] - near[len(near) // 2]) // 2 END AS "offset", round(len(near) / len(v) * (len(near) / (len(near) + 2.0)), 6) AS confidence, len(near)::BIGINT AS evidence FROM n WHERE len(near) >= 3 AND len(near) * 4 >= len(v) * 3""")
def gps_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = view(spark, sf_dir, "item").selectExpr("user_id AS device", "CASE WHEN event_id % 4 = 0 THEN NULL WHEN user_id % 3 = 0 THEN event_id * 977 % 60000 ELSE 5000 + event_id * 977 % 3000 END AS gps_delta")
    got = alignment.gps_anchors(photos)
    return got.select("device", "offset", F.round("confidence", 6).alias("confidence"), "evidence")


@register("corrected_time", f"{oracle_views('photo')} SELECT photo_id, coalesce(taken_at + coalesce(o.offset_ms, 0), mtime) AS corrected_at FROM photo p LEFT JOIN (SELECT DISTINCT session_id, device_id, device_id * 1000 + session_id % 10 AS offset_ms FROM photo WHERE device_id < 3) o ON o.session_id = p.session_id AND o.device_id = p.device_id")
def corrected_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "photo")
    offsets = p.where("device_id < 3").select("session_id", "device_id", (F.col("device_id") * 1000 + F.col("session_id") % 10).alias("offset_ms")).distinct()
    return alignment.corrected_time(p, offsets).select("photo_id", "corrected_at")


@register("interval_overlap", f"{oracle_views('item')}, {_UNITS} SELECT id, session_id FROM u WHERE start_at <= 1704844800000 AND end_at >= 1704758400000")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that touch a window of dates."""
    return _units(spark, sf_dir).where((F.col("start_at") <= 1704844800000) & (F.col("end_at") >= 1704758400000)).select("id", "session_id")


@register("window_count", f"{oracle_views('item')} SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 3600000 FOLLOWING))::BIGINT AS n FROM item")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(0, 3_600_000)
    return view(spark, sf_dir, "item").select("event_id", F.count("*").over(w).alias("n"))


