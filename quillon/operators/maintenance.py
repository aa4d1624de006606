"""Catalog writes as table rewrites: upserts, ingest, pairing, recounts, presence, planning of missing work."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators.grouped import blocks, crossed, spread, tiles
from quillon.sources import scratch

# Fixed values.
PRIMARY = {"jpeg": 0, "heif": 1}
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "heic": "heif", "heif": "heif", "avif": "avif", "tif": "tiff", "tiff": "tiff", "nef": "raw", "cr2": "raw", "cr3": "raw", "arw": "raw", "dng": "raw", "raf": "raw", "orf": "raw", "rw2": "raw"}
HISTORY = 200


def file_format(name: Column) -> Column:
    """The image format by extension; null for other files."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for f in dict.fromkeys(FORMATS.values()):
        out = F.when(ext.isin(*[e for e, v in FORMATS.items() if v == f]), F.lit(f)).otherwise(out)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed_by: str, reset: list[str]) -> DataFrame:
    """old with new merged in by natural key; `action` says inserted, updated, kept.

    A row is updated if its change column differs: new columns replace the old, and derived ones in `reset` become null.
    """
    values = [c for c in new.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias("n_" + c) for c in values], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    both = o.join(n, keys, "full")
    differs = F.col("_new") & ~F.col(changed_by).eqNullSafe(F.col("n_" + changed_by))
    action = F.when(F.col("_old").isNull(), "inserted").when(differs, "updated").otherwise("kept")
    taken = F.col("_old").isNull() | F.coalesce(differs, F.lit(False))
    columns = [F.when(taken & F.lit(c in values), F.col("n_" + c) if c in values else F.col(c)).when(taken & F.lit(c in reset), F.lit(None)).otherwise(F.col(c)).alias(c) for c in old.columns if c not in keys]
    return both.select(*keys, *columns, action.alias("action"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose key it lacks; repeated new keys count once."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def apply_metadata(photos: DataFrame, metadata: DataFrame, key: str = "photo_id") -> DataFrame:
    """photos with the metadata's known values; null ones leave the old."""
    values = [c for c in metadata.columns if c != key]
    m = metadata.select(key, *[F.col(c).alias("m_" + c) for c in values])
    return photos.join(m, key, "left").select(*[F.coalesce("m_" + c, c).alias(c) if c in values else F.col(c) for c in photos.columns])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of any key in new, and all rows of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_versions(old: Column, new: Column) -> Column:
    """JSON objects of strings merged, the new winning; invalid or null JSON counts as empty."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    before, after = parse(old), parse(new)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k)), after)))))


def pair_files(files: DataFrame) -> DataFrame:
    """photo_id, pair_id of raw files that share folder and base name with a primary, the best ranked of those."""
    rank = F.when(F.col("format") == "jpeg", 0).when(F.col("format") == "heif", 1)
    keyed = files.withColumn("stem", exprs.stem_key(F.col("rel_path"))).withColumn("rank", rank)
    primary = keyed.where("rank IS NOT NULL").groupBy("root_id", "stem").agg(F.min_by("photo_id", F.struct("rank", "photo_id")).alias("pair_id"))
    return keyed.where("format = 'raw'").join(primary, ["root_id", "stem"]).select("photo_id", "pair_id")


def export_members(ids: DataFrame, pairs: DataFrame, member: str) -> DataFrame:
    """pos, photo_id: what an export writes for each id: jpeg (itself), raw (its companions), both; unpaired ones always
    themselves."""
    if member == "jpeg":
        return ids.select("pos", "photo_id")
    held = ids.join(pairs.select(F.col("photo_id").alias("companion"), F.col("pair_id").alias("photo_id")), "photo_id", "left")
    companions = held.where("companion IS NOT NULL").select("pos", F.col("companion").alias("photo_id"))
    selves = ids if member == "both" else ids.join(companions.select("pos").distinct(), "pos", "left_anti")
    return selves.select("pos", "photo_id").unionByName(companions)


def unknown_files(card: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a card that the catalog has neither by name and size nor by content."""
    a = card.join(known.select(F.lower("file_name").alias("_n"), F.col("file_size").alias("_s")), (F.lower("file_name") == F.col("_n")) & (F.col("file_size") == F.col("_s")), "left_anti")
    return a.join(known.where("content_key IS NOT NULL").select(F.col("content_key").alias("_k")), F.col("content_key") == F.col("_k"), "left_anti")


def mark_presence(photos: DataFrame, present: DataFrame) -> DataFrame:
    """photos with missing set by whether a scan found their path."""
    found = present.select("rel_path").distinct().withColumn("_found", F.lit(1))
    return photos.drop("missing").join(found, "rel_path", "left").withColumn("missing", F.when(F.col("_found").isNull(), 1).otherwise(0)).drop("_found")


def missing_steps(analysis: DataFrame, ready: list[str], fingerprint: str) -> DataFrame:
    """steps, photo_ids: photos by the steps that their versions lack and that weren't skipped under this model set."""
    versions = F.from_json("model_versions", "map<string,string>")
    skipped = F.from_json(F.get_json_object("model_versions", "$.skipped"), "map<string,string>")
    lacking = [F.when(F.coalesce(F.element_at(versions, s).isNull(), F.lit(True)) & ~F.coalesce(F.element_at(skipped, s) == fingerprint, F.lit(False)), F.lit(s)) for s in ready]
    rows = analysis.withColumn("steps", F.array_join(F.array(*lacking), ",")).where("steps <> ''")
    return rows.groupBy("steps").agg(F.array_sort(F.collect_list("photo_id")).alias("photo_ids"))


def fingerprint(models: list[str]) -> str:
    """FNV-1a of a set of models, whatever their order."""
    h = 0xCBF29CE484222325
    for byte in "\n".join(sorted(set(models))).encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def recent(tasks: DataFrame, most: int = HISTORY) -> DataFrame:
    """Tasks with the finished ones beyond the newest `most` pruned: a top-k, of which each task keeps `most` rows."""
    done = tasks.where("status = 'done'").orderBy(F.desc("created_at"), "task_id").limit(most)
    return tasks.where("status <> 'done'").unionByName(done)


def sync_sidecars(catalog: DataFrame, sidecars: DataFrame) -> DataFrame:
    """photo_id, rating, label, source: a changed sidecar wins, else a changed catalog row is to be written out.

    catalog: photo_id, rating, label, db_mtime; sidecars: photo_id, rating, label, file_mtime, seen_mtime.
    """
    s = sidecars.select("photo_id", F.col("rating").alias("s_rating"), F.col("label").alias("s_label"), "file_mtime", "seen_mtime")
    both = catalog.join(s, "photo_id", "left")
    newer = F.coalesce(F.col("file_mtime") != F.col("seen_mtime"), F.lit(False))
    differs = ~(F.col("rating").eqNullSafe(F.col("s_rating")) & F.col("label").eqNullSafe(F.col("s_label")))
    source = F.when(newer & differs, "sidecar").when(differs, "catalog").otherwise("equal")
    return both.select("photo_id", F.when(newer, F.col("s_rating")).otherwise(F.col("rating")).alias("rating"), F.when(newer, F.col("s_label")).otherwise(F.col("label")).alias("label"), source.alias("source"))


def orphans(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Unnamed people without a face."""
    return people.where("name IS NULL").join(faces.select("person_id").distinct(), "person_id", "left_anti")


def with_overrides(assigned: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Assignments with the latest manual override of each key, if any (split, merge, reassign)."""
    latest = overrides.groupBy(key).agg(F.max_by(value, "made_at").alias("_o"), F.lit(True).alias("_has"))
    return assigned.join(latest, key, "left").withColumn(value, F.when(F.col("_has"), F.col("_o")).otherwise(F.col(value))).drop("_o", "_has")


def merge_people(faces: DataFrame, merges: dict[int, int]) -> DataFrame:
    """faces with merged people renamed, chains followed to their end."""
    ends = {}
    for a in merges:
        b, seen = merges[a], {a}
        while b in merges and b not in seen:
            seen.add(b)
            b = merges[b]
        ends[a] = b
    if not ends:
        return faces
    renamed = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
    return faces.withColumn("person_id", F.coalesce(F.element_at(renamed, F.col("person_id").cast("int")).cast("long"), F.col("person_id")))


def max_suffix(names: Column) -> Column:
    """Largest number after the last dash of names."""
    return F.max(F.regexp_extract(names, r"-(\d+)$", 1).try_cast("long"))


def rejected_with_companions(photos: DataFrame) -> DataFrame:
    """group_id, photo_id, is_primary: rejected photos and the files that go with them, the primary first."""
    primary = photos.where("flag = -1 AND pair_id IS NULL").select(F.col("photo_id").alias("group_id"), "photo_id", F.lit(1).alias("is_primary"))
    others = photos.where("pair_id IS NOT NULL").select(F.col("pair_id").alias("group_id"), "photo_id", F.lit(0).alias("is_primary")).join(primary.select("group_id"), "group_id", "left_semi")
    return primary.unionByName(others)


def theta_candidates(targets: DataFrame, faces: DataFrame) -> DataFrame:
    """target_id, face_id of faces that share person or track with a target, or are unassigned in its session.

    The disjunction is a union of equi joins, so no nested loop runs. Each pair comes from one of them only, by its least
    common key there, so pairs are never brought together to be made distinct. An id may have several rows. Faces with
    the same keys are one row of a join, as are targets: keys are compared once for all of them.
    """
    kept = faces.where("face_id IS NOT NULL").select("face_id", "person_id", "track_id", F.when(F.col("person_id").isNull(), F.col("session_id")).alias("session_id"))
    b = _keys_of(spread(kept, "face_id", times=32), "b").sortWithinPartitions(*["b_" + k for k in _KEYS])
    b = scratch.materialize(b, "faces", freed=True)
    a = scratch.materialize(_keys_of(targets.where("face_id IS NOT NULL"), "a"), "targets", freed=True).withColumnRenamed("face_id", "target_id")
    least = lambda k: F.coalesce(F.array_min(F.array_intersect(f"a_{k}s", f"b_{k}s")) == F.col("k"), F.lit(True))
    single = lambda k: F.coalesce(F.col(f"a_{k}") == F.col(f"b_{k}"), F.lit(False))
    several = lambda k: F.arrays_overlap(*[F.coalesce(f"{x}_{k}s", F.when(F.col(f"{x}_{k}").isNotNull(), F.array(f"{x}_{k}")), F.array().cast(dict(t.dtypes)[f"{x}_{k}s"])) for x, t in (("a", a), ("b", b))])
    shared = lambda k: F.when(F.col(f"a_{k}s").isNull() & F.col(f"b_{k}s").isNull(), single(k)).otherwise(several(k))
    every = lambda x, k: F.explode(F.coalesce(f"{x}_{k}s", F.array(f"{x}_{k}"))).alias("k")
    found = []
    for i, k in enumerate(_KEYS):
        earlier = [f"{n}{s}" for n in _KEYS[:i] for s in ("", "s")]
        of = lambda x: ["k", f"{x}_{k}s", *[f"{x}_{n}" for n in earlier]]
        rows = lambda t, x, id: t.select(id, f"{x}_{k}s", *[f"{x}_{n}" for n in earlier], every(x, k)).where("k IS NOT NULL")
        left = tiles(rows(a, "a", "target_id"), of("a"), ["target_id"], "wanted")
        right = blocks(rows(b, "b", "face_id"), of("b"), ["face_id"], "held")
        pairs = right.join(left, "k").where(least(k))
        for n in _KEYS[:i]:
            pairs = pairs.where(~shared(n))
        found.append(crossed(pairs, _others, f"target_id {dict(a.dtypes)['target_id']}, face_id {dict(b.dtypes)['face_id']}"))
    return found[0].union(found[1]).union(found[2])


def _others(held: pa.StructArray, left: pa.Array, wanted: pa.StructArray, right: pa.Array) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([wanted.field(0).take(right), held.field(0).take(left)], ["target_id", "face_id"])
    other = pc.not_equal(made.column(0), made.column(1))
    return made if pc.all(other).as_py() else made.filter(other)


_KEYS = ("person_id", "track_id", "session_id")


def _keys_of(rows: DataFrame, side: str) -> DataFrame:
    """face_id and for each key the only value of its rows, or else the list of several."""
    sets = rows.groupBy("face_id").agg(*[F.collect_set(k).alias(k) for k in _KEYS])
    return sets.select("face_id", *[F.when(F.size(k) == 1, F.col(k)[0]).alias(f"{side}_{k}") for k in _KEYS], *[F.when(F.size(k) > 1, F.col(k)).alias(f"{side}_{k}s") for k in _KEYS])
