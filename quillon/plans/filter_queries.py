"""Predicates, sort orders, pages and joins of the photo query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import filters as f
from quillon.operators.filters import PhotoQuery
from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view


def catalog(spark: SparkSession, sf_dir: str) -> f.Catalog:
    return f.Catalog(*(view(spark, sf_dir, n) for n in ("photo", "face", "photo_tag", "burst", "scene")))


def _selected(name: str, q: PhotoQuery, where: str, *views: str) -> None:
    """A filter query: the ids of all photos that q selects, against a WHERE clause on p."""
    sql = f"{oracle_views('photo', *views)} SELECT photo_id, session_id FROM photo p WHERE {where}"
    register(name, sql)(lambda spark, sf_dir: f.filtered(catalog(spark, sf_dir), q).select("photo_id", "session_id"))


_S = "f.is_subject = 1"
_selected("filter_rating_gte", PhotoQuery(rating_gte=4), "user_rating >= 4")
_selected("filter_flag_not_rejected", PhotoQuery(flag="not_rejected"), "flag >= 0")
_selected("filter_flag_picked", PhotoQuery(flag="picked"), "flag = 1")
_selected("filter_color_label", PhotoQuery(color_label="green"), "color_label = 'green'")
_selected("filter_ai_rating_gte", PhotoQuery(ai_rating_gte=3.5), "ai_rating >= 3.5")
_selected("filter_issues_none", PhotoQuery(issues_none=True), "analysis_version > 0 AND coalesce(issues, 0) = 0")
_selected("filter_issues_any", PhotoQuery(issues_any=("blurry", "noisy")), "(coalesce(issues, 0) & 66) <> 0")
_selected("filter_burst_best_only", PhotoQuery(burst_best_only=True), "burst_id IS NULL OR rank_in_burst = 0")
_selected("filter_burst_and_scene_type", PhotoQuery(burst_id=1231, scene_type="group"), "burst_id = 1231 AND scene_type = 'group'")
_selected("filter_persons_any", PhotoQuery(persons=(2, 3, 3)), f"EXISTS (SELECT 1 FROM face f WHERE f.photo_id = p.photo_id AND f.person_id IN (2, 3) AND {_S})", "face")
_selected("filter_persons_all", PhotoQuery(persons=(2, 3, 3), person_mode="all", include_background=True), "photo_id IN (SELECT photo_id FROM face WHERE person_id IN (2, 3) GROUP BY photo_id HAVING count(DISTINCT person_id) = 2)", "face")
_selected("filter_person_state", PhotoQuery(persons=(2, 5), person_state=("eyes_open", "smiling")), f"EXISTS (SELECT 1 FROM face f WHERE f.photo_id = p.photo_id AND f.person_id IN (2, 5) AND f.eyes_open >= 0.55 AND f.smile >= 0.5 AND {_S})", "face")
_selected("filter_person_state_alone", PhotoQuery(person_state=("looking", "subject")), f"EXISTS (SELECT 1 FROM face f WHERE f.photo_id = p.photo_id AND f.gaze >= 0.6 AND {_S})", "face")
_selected("filter_exclude_persons", PhotoQuery(exclude_persons=(1, 2, 3)), f"NOT EXISTS (SELECT 1 FROM face f WHERE f.photo_id = p.photo_id AND f.person_id IN (1, 2, 3) AND {_S})", "face")
_selected("filter_exclude_background", PhotoQuery(exclude_persons=(1, 2), include_background=True), "NOT EXISTS (SELECT 1 FROM face f WHERE f.photo_id = p.photo_id AND f.person_id IN (1, 2))", "face")
_selected("filter_edits_and_duplicates", PhotoQuery(has_edits=True, duplicates=False), "coalesce(has_edits, 0) = 1 AND dup_group_id IS NULL")
_selected("filter_event", PhotoQuery(event_id=112), "burst_id IN (SELECT b.burst_id FROM burst b JOIN scene s ON s.scene_id = b.scene_id WHERE s.event_id = 112)", "burst", "scene")
_selected("filter_faces_between", PhotoQuery(faces_min=1, faces_max=2), "(SELECT sum(is_subject) FROM face f WHERE f.photo_id = p.photo_id) BETWEEN 1 AND 2", "face")
_selected("filter_lens", PhotoQuery(lenses=("Lens 1mm", "Lens 5mm")), "lens IN ('Lens 1mm', 'Lens 5mm')")
_selected("filter_taken_range", PhotoQuery(taken_from=883612800000, taken_to=915148799999), "taken_at BETWEEN 883612800000 AND 915148799999")
_selected("filter_tags_any", PhotoQuery(tags=("tag3", " tag3 ", "tag7")), "photo_id IN (SELECT photo_id FROM photo_tag WHERE tag IN ('tag3', 'tag7'))", "photo_tag")
_selected("filter_tags_all", PhotoQuery(tags=("tag3", "tag7"), tags_all=True), "photo_id IN (SELECT photo_id FROM photo_tag WHERE tag IN ('tag3', 'tag7') GROUP BY photo_id HAVING count(DISTINCT tag) = 2)", "photo_tag")
_selected("filter_only_ids", PhotoQuery(only_ids=(1, 5, 9, 77, 1000, -3)), "photo_id IN (1, 5, 9, 77, 1000, -3)")
_selected("filter_only_ids_empty", PhotoQuery(only_ids=()), "1 = 0")
_selected("filter_device_or_none", PhotoQuery(devices=(2, 4), device_none=True), "device_id IN (2, 4) OR device_id IS NULL")
_selected("filter_sharp_sharp", PhotoQuery(sharp="sharp"), "sharpness >= 0.35 AND (coalesce(issues, 0) & 2) = 0")
_selected("filter_sharp_blurry", PhotoQuery(sharp="blurry"), "(coalesce(issues, 0) & 2) <> 0 OR sharpness < 0.35")
_selected("filter_sharp_unknown", PhotoQuery(sharp="unknown"), "sharpness IS NULL AND (coalesce(issues, 0) & 2) = 0")


@register("filter_sort_limit", f"{oracle_views('photo')} SELECT photo_id, taken_at, user_rating, flag, issues FROM photo WHERE user_rating >= 3 AND flag >= 0 AND (coalesce(issues, 0) & 66) <> 0 ORDER BY trunc(coalesce(ai_score, -0.001) * 1000000)::BIGINT DESC, photo_id LIMIT 500")
def filter_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: predicates, sentinel order and a page (the limit is the feature)."""
    q = PhotoQuery(rating_gte=3, flag="not_rejected", issues_any=("blurry", "noisy"), sort="ai")
    rows = f.filtered(f.Catalog(view(spark, sf_dir, "photo")), q)
    return rows.orderBy(*f.ordering(q.sort)).limit(q.page_size).select("photo_id", "taken_at", "user_rating", "flag", "issues")


_ORDERS = {
    "taken_at": "coalesce(taken_at, 9223372036854775807)", "-taken_at": "coalesce(taken_at, -9223372036854775807) DESC", "name": "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "rating": "coalesce(user_rating, -1) DESC", "ai": "trunc(coalesce(ai_score, -0.001) * 1000000)::BIGINT DESC", "taste": "trunc(coalesce(taste_score, -0.001) * 1000000)::BIGINT DESC",
}


def _sorted(sort: str, order: str) -> None:
    """Places of all photos in their session's order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("session_id").orderBy(*f.ordering(sort)))
        return view(spark, sf_dir, "photo").select("session_id", "photo_id", place.cast("long").alias("place"))

    register(f"sort_{sort.replace('-', 'desc_')}", f"{oracle_views('photo')} SELECT session_id, photo_id, row_number() OVER (PARTITION BY session_id ORDER BY {order}, photo_id) AS place FROM photo")(query)


for _sort, _order in _ORDERS.items():
    _sorted(_sort, _order)

_KEY = "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("keyset_next_page", f"{oracle_views('photo')}, k AS (SELECT photo_id, flag, {_KEY} AS key FROM photo) SELECT photo_id, key FROM k WHERE flag >= 0 AND (key > 'img_0123.jpg' OR (key = 'img_0123.jpg' AND photo_id > 4000)) ORDER BY key, photo_id LIMIT 200")
def keyset_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = PhotoQuery(flag="not_rejected", sort="name", limit=199, cursor=f.encode_cursor("img_0123.jpg", 4000))
    return f.page_rows(f.Catalog(view(spark, sf_dir, "photo")), q).select("photo_id", F.col("sort_key").alias("key"))


@register("smart_collections", f"{oracle_views('photo')} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM photo WHERE {w}" for n, w in (("best_per_group", "burst_id IS NULL OR rank_in_burst = 0"), ("has_closed_eyes", "(coalesce(issues, 0) & 1) <> 0"), ("undecided", "flag = 0"), ("edited", "coalesce(has_edits, 0) = 1"), ("duplicates", "dup_group_id IS NOT NULL"))))
def smart_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All saved queries are counted in one scan."""
    photo = view(spark, sf_dir, "photo")
    counts = []
    for name, q in f.COLLECTIONS.items():
        (predicate,) = f.plain_predicates(q)
        counts.append(F.count_if(predicate).alias(name))
    return photo.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in f.COLLECTIONS])))


@register("multi_get", f"{oracle_views('photo')} SELECT photo_id, pos FROM photo JOIN (VALUES (9, 0), (3, 1), (7, 3), (-1, 4)) v(id, pos) ON id = photo_id")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = f.multi_get(view(spark, sf_dir, "photo"), [9, 3, 9, 7, -1])
    return got.select("photo_id", F.when(F.col("pos") > 1, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"))


@register("companions", f"{oracle_views('photo')} SELECT p.photo_id, coalesce(string_agg(c.photo_id::VARCHAR, ',' ORDER BY c.photo_id), '') AS companions FROM photo p LEFT JOIN photo c ON c.pair_id = p.photo_id WHERE p.pair_id IS NULL GROUP BY p.photo_id")
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.with_companions(view(spark, sf_dir, "photo")).select("photo_id", F.array_join("companions", ",").alias("companions"))


@register("sharp_states", f"{oracle_views('photo')} SELECT CASE WHEN (coalesce(issues, 0) & 2) <> 0 OR sharpness < 0.35 THEN 'blurry' WHEN sharpness IS NULL THEN 'unknown' ELSE 'sharp' END AS state, count(*)::BIGINT AS n FROM photo GROUP BY 1")
def sharp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").groupBy(f.sharp_state(F.col("sharpness"), F.col("issues")).alias("state")).agg(F.count("*").alias("n"))


@register("issue_names", f"{oracle_views('photo')} SELECT photo_id, concat_ws(',', " + ", ".join(f"CASE WHEN (coalesce(issues, 0) & {b}) <> 0 THEN '{n}' END" for n, b in exprs.ISSUES.items()) + ") AS issues FROM photo")
def issue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "photo").select("photo_id", F.array_join(exprs.issue_names(F.coalesce("issues", F.lit(0))), ",").alias("issues"))


@register("similar_faces", f"{oracle_views('photo', 'face')} SELECT photo_id, session_id FROM photo WHERE photo_id IN (SELECT f.photo_id FROM face f JOIN embeddings e ON e.vec_id = f.vec_id CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id IN (3, 8)) WHERE list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[]) >= 0.38)")
def similar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    wanted = tuple(tuple(r.embedding) for r in vectors.where("vec_id IN (3, 8)").collect())
    # A face's vector is compared once, not once for every face that has it.
    cat = catalog(spark, sf_dir)
    close = vectors.where(F.array_max(F.array(*[exprs.cosine(F.col("embedding"), F.array(*map(F.lit, v))) for v in wanted])) >= f.FACE_SIMILARITY)
    return cat.photo.join(cat.face.join(close, "vec_id", "left_semi"), "photo_id", "left_semi").select("photo_id", "session_id")


@register("string_functions", "SELECT c_custkey, trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')) AS clean, levenshtein(c_mktsegment, 'HOUSEHELD')::INT AS distance, lower(regexp_replace(c_name || '.tar.GZ', '\\.[^.]*$', '')) AS stem FROM customer")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", exprs.clean_query(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("clean"), F.levenshtein("c_mktsegment", F.lit("HOUSEHELD")).alias("distance"), exprs.stem_key(F.concat("c_name", F.lit(".tar.GZ"))).alias("stem"))


@register("json_functions", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_valid(props) AS ok FROM events")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))
