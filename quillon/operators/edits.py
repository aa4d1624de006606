"""Manual edits of a catalog as table rewrites, and the wide reads that show their effect.

Requests are tables too, so thousands of edits are one join. A request that breaks its rule is left out whole and the
rows that it names stay as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a photo's columns are where they are unknown.
UNKNOWN = {"format": "", "file_size": 0, "flag": 0, "thumb_state": 0, "issues": 0, "analysis_version": 0, "has_edits": 0, "missing": 0}
#: The columns of a photo row, in the order of the wide read; those of other tables are looked up.
PROJECTION = (
    "photo_id", "root_path", "rel_path", "file_name", "format", "file_size", "width", "height", "taken_at", "camera", "lens", "focal", "aperture", "shutter", "iso",
    "user_rating", "ai_rating", "flag", "color_label", "burst_id", "thumb_state", "fast_key", "taken_at_offset_min", "ai_score", "issues", "rank_in_burst", "burst_size",
    "scene_type", "face_count", "subject_face_count", "analysis_version", "has_edits", "edit_hash", "device_id", "device_kind", "missing", "dup_group_id", "dup_kind", "taste_score",
)


def project(photos: DataFrame, roots: DataFrame, bursts: DataFrame, devices: DataFrame, taste: DataFrame) -> DataFrame:
    """The 39 columns of a photo row. Every look-up is a left join on a unique key; columns that photos lacks are null strings.

    roots: root_id, root_path; bursts: burst_id, burst_size; devices: device_id, device_kind; taste: photo_id, taste_score.
    """
    own = [c for c in PROJECTION if c not in ("root_path", "burst_size", "device_kind", "taste_score")]
    rows = photos.select("root_id", *[F.col(c) if c in photos.columns else F.lit(None).cast("string").alias(c) for c in own])
    wide = rows.join(roots, "root_id", "left").join(bursts, "burst_id", "left").join(devices, "device_id", "left").join(taste, "photo_id", "left")
    return wide.select(*[F.coalesce(c, F.lit(UNKNOWN[c])).alias(c) if c in UNKNOWN else F.col(c) for c in PROJECTION])


def duplicates_of(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """photo_id, group_id, member_id, exact: a row per member of each asked photo's duplicate group, itself included; a
    photo without a group has one row of nulls. photos: photo_id, dup_group_id, dup_kind."""
    asked = photos.join(ids.select("photo_id").distinct(), "photo_id", "left_semi").select("photo_id", F.col("dup_group_id").alias("group_id"))
    members = photos.where("dup_group_id IS NOT NULL").select(F.col("dup_group_id").alias("group_id"), F.col("photo_id").alias("member_id"), F.coalesce(F.col("dup_kind") == "exact", F.lit(False)).alias("exact"))
    return asked.join(members, "group_id", "left").select("photo_id", "group_id", "member_id", "exact")


def split_bursts(photos: DataFrame, cuts: DataFrame) -> DataFrame:
    """photos with the cut photo of a burst, and all later ones by (taken_at, photo_id), in the burst `new_id`. Cuts at a
    burst's first photo, or at a photo that isn't in it, are left out. cuts: burst_id, at_photo_id, new_id; one a burst."""
    place = F.struct(F.coalesce("taken_at", F.lit(-(1 << 62))).alias("t"), F.col("photo_id").alias("p"))
    of_cut = photos.join(cuts.select("burst_id", "at_photo_id", "new_id"), "burst_id")
    found = of_cut.groupBy("burst_id", "new_id").agg(F.min(place).alias("first"), F.min(F.when(F.col("photo_id") == F.col("at_photo_id"), place)).alias("cut")).where("cut > first")
    moved = (place >= F.col("cut")) & F.col("cut").isNotNull()
    columns = [F.when(moved, F.col("new_id")).otherwise(F.col("burst_id")).alias(c) if c == "burst_id" else F.col(c) for c in photos.columns]
    return photos.join(found.drop("first"), "burst_id", "left").select(*columns)


def merge_bursts(bursts: DataFrame, merges: DataFrame) -> DataFrame:
    """burst_id, into, scene_id of every burst: the bursts of a merge go into its earliest by (start_at, burst_id), and all
    their scenes into that one's scene, else the smallest. Merges of one burst, or across sessions, are left out.

    bursts: burst_id, session_id, scene_id, start_at; merges: group_id, burst_id, each burst and scene in one merge.
    """
    asked = merges.select("group_id", "burst_id").distinct().join(bursts, "burst_id")
    first = F.struct(F.coalesce("start_at", F.lit(0)), F.col("burst_id"))
    same = (F.count("session_id") == F.count("*")) & (F.min("session_id") == F.max("session_id")) | (F.count("session_id") == 0)
    groups = asked.groupBy("group_id").agg(F.min_by("burst_id", first).alias("into"), F.coalesce(F.min_by("scene_id", first), F.min("scene_id")).alias("scene_into"), F.count("*").alias("n"), same.alias("same")).where("n >= 2 AND same")
    taken = asked.join(groups, "group_id")
    target = taken.select("burst_id", "into", F.col("scene_into").alias("own_scene"))
    scenes = taken.where("scene_id IS NOT NULL").groupBy("scene_id").agg(F.min("scene_into").alias("scene_into"))
    both = bursts.select("burst_id", "scene_id").join(target, "burst_id", "left").join(scenes, "scene_id", "left")
    return both.select("burst_id", F.coalesce("into", "burst_id").alias("into"), F.coalesce("own_scene", "scene_into", "scene_id").alias("scene_id"))


def new_people(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """faces with the chosen ones assigned to new people and locked. A new person with two faces in one photo, or with a
    face that doesn't exist, is left out. faces: face_id, photo_id, person_id, person_locked; chosen: new_id, face_id."""
    wanted = chosen.select("new_id", "face_id").distinct()
    met = wanted.join(faces.select("face_id", "photo_id"), "face_id", "left").groupBy("new_id").agg(F.count("*").alias("n"), F.count_distinct("photo_id").alias("photos")).where("n = photos")
    made = wanted.join(met.select("new_id"), "new_id", "left_semi")
    new = {"person_id": F.coalesce("new_id", "person_id"), "person_locked": F.when(F.col("new_id").isNotNull(), 1).otherwise(F.col("person_locked"))}
    return faces.join(made, "face_id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in faces.columns])


def recount_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """people anew from their faces: the cover is the face with the best score, the smaller id on ties; a singleton with a
    name or faces in two photos is one no more; people without a name or a face go.

    people: person_id, name, singleton; faces: face_id, photo_id, person_id, cover_score.
    """
    best = F.struct("cover_score", -F.col("face_id"))
    held = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.max_by("face_id", best).alias("cover_face_id"), F.min("photo_id").alias("low"), F.max("photo_id").alias("high"))
    both = people.join(held, "person_id", "left").where("name IS NOT NULL OR cover_face_id IS NOT NULL")
    real = F.col("cover_face_id").isNotNull() & (F.col("name").isNotNull() | (F.col("low") < F.col("high")))
    return both.select("person_id", "name", "cover_face_id", F.when(real, 0).otherwise(F.col("singleton")).alias("singleton"))


def set_tags(tags: DataFrame, photos: DataFrame, ids: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """photo_id, tag after tags were taken from the photos in ids and others given to them; a tag in both lists is given.
    Ids that aren't photos are passed over."""
    chosen = ids.select("photo_id").distinct().join(photos.select("photo_id"), "photo_id", "left_semi")
    marked = tags.select("photo_id", "tag").join(chosen.withColumn("chosen", F.lit(True)), "photo_id", "left")
    rest = marked.where(~(F.coalesce("chosen", F.lit(False)) & F.col("tag").isin(remove))).select("photo_id", "tag") if remove else tags.select("photo_id", "tag")
    given = chosen.select("photo_id", F.explode(F.array(*[F.lit(t) for t in add])).alias("tag")) if add else rest.limit(0)
    return rest.unionByName(given).distinct()


def settle(tasks: DataFrame, now: Column) -> DataFrame:
    """tasks with those that were running when the process ended marked as interrupted. tasks: task_id, status,
    finished_at."""
    running = F.coalesce(F.col("status") == "running", F.lit(False))
    new = {"status": F.when(running, "interrupted").otherwise(F.col("status")), "finished_at": F.when(running, now).otherwise(F.col("finished_at"))}
    return tasks.select(*[new[c].alias(c) if c in new else F.col(c) for c in tasks.columns])


def relocate(photos: DataFrame, old_root: int, new_root: int, found: DataFrame) -> DataFrame:
    """photos with a root's files looked for in another folder: those whose path stands there move and are present, the
    others stay and are missing. photos: root_id, rel_path, missing; found: rel_path."""
    there = found.select(F.col("rel_path"), F.lit(True).alias("there")).distinct()
    of_root = F.coalesce(F.col("root_id") == old_root, F.lit(False))
    moved = of_root & F.coalesce("there", F.lit(False))
    new = {"root_id": F.when(moved, new_root).otherwise(F.col("root_id")), "missing": F.when(moved, 0).when(of_root, 1).otherwise(F.col("missing"))}
    return photos.join(there, "rel_path", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in photos.columns])
