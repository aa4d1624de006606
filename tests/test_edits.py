import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import alignment, edits, ranking


def rows(df, *by):
    return sorted((tuple(r[c] for c in by or df.columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def photos(spark):
    return spark.createDataFrame([(1, 10, 5, "a"), (2, 10, None, "b"), (3, 10, 7, "c"), (4, 10, 7, "d"), (5, 11, 1, "e"), (6, None, 2, "f")], "photo_id long, burst_id long, taken_at long, extra string")


def test_split_takes_the_cut_photo_and_later_ones(spark, photos):
    cut = lambda *c: edits.split_bursts(photos, spark.createDataFrame(list(c), "burst_id long, at_photo_id long, new_id long"))
    assert rows(cut((10, 3, 99)), "photo_id", "burst_id") == [(1, 10), (2, 10), (3, 99), (4, 99), (5, 11), (6, None)]
    before = rows(photos, "photo_id", "burst_id")
    assert rows(cut((10, 2, 99)), "photo_id", "burst_id") == before  # an unknown time comes first
    assert rows(cut((11, 3, 99), (12, 1, 98)), "photo_id", "burst_id") == before
    assert cut().columns == photos.columns


def test_merge_goes_to_the_earliest_and_takes_the_scenes(spark):
    bursts = spark.createDataFrame([(1, 7, 50, 9), (2, 7, 40, 3), (3, 7, None, 5), (4, 7, 50, 20), (5, 8, 60, 1)], "burst_id long, session_id long, scene_id long, start_at long")
    merge = lambda *m: rows(edits.merge_bursts(bursts, spark.createDataFrame(list(m), "group_id long, burst_id long")))
    assert merge((1, 1), (1, 2), (1, 3)) == [(1, 2, 40), (2, 2, 40), (3, 2, 40), (4, 4, 40), (5, 5, 60)]
    assert merge((1, 3), (1, 4)) == [(1, 1, 50), (2, 2, 40), (3, 3, 50), (4, 3, 50), (5, 5, 60)]
    alone = [(1, 1, 50), (2, 2, 40), (3, 3, None), (4, 4, 50), (5, 5, 60)]
    assert merge((1, 1), (1, 5)) == alone and merge((1, 1), (1, 1)) == alone and merge() == alone


def test_new_people_have_one_face_a_photo(spark):
    faces = spark.createDataFrame([(1, 1, 5, 0), (2, 1, None, 0), (3, 2, 5, 1), (4, 3, None, 0)], "face_id long, photo_id long, person_id long, person_locked int")
    made = lambda *c: rows(edits.new_people(faces, spark.createDataFrame(list(c), "new_id long, face_id long")), "face_id", "person_id", "person_locked")
    assert made((9, 1), (9, 3), (9, 3)) == [(1, 9, 1), (2, None, 0), (3, 9, 1), (4, None, 0)]
    assert made((9, 1), (9, 2), (8, 4), (7, 77)) == [(1, 5, 0), (2, None, 0), (3, 5, 1), (4, 8, 1)]


def test_recount_promotes_and_removes(spark):
    people = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "Ann", 1), (4, None, 1), (5, "Bob", 1)], "person_id long, name string, singleton int")
    faces = spark.createDataFrame([(1, 1, 1, 0.5), (2, 2, 1, 0.5), (3, 1, 2, None), (4, 9, 3, 0.1), (5, 9, None, 1.0)], "face_id long, photo_id long, person_id long, cover_score double")
    assert rows(edits.recount_people(people, faces)) == [(1, None, 1, 0), (2, None, 3, 1), (3, "Ann", 4, 0), (5, "Bob", None, 1)]


def test_tags_are_taken_and_given(spark, photos):
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (5, "x")], "photo_id long, tag string")
    ids = photos.where("photo_id < 3").union(photos.where("photo_id = 1").withColumn("photo_id", F.lit(77).cast("long")))
    assert rows(edits.set_tags(tags, photos, ids, ["y", "z"], ["x", "y"])) == [(1, "y"), (1, "z"), (2, "y"), (2, "z"), (5, "x")]
    assert rows(edits.set_tags(tags, photos, ids, [], [])) == rows(tags)
    assert rows(edits.set_tags(tags, photos, ids, [], ["x"])) == [(1, "y"), (5, "x")]


def test_running_tasks_are_interrupted(spark):
    tasks = spark.createDataFrame([("a", "running", None), ("b", "done", 3), ("c", None, None)], "task_id string, status string, finished_at long")
    assert rows(edits.settle(tasks, F.lit(9).cast("long"))) == [("a", "interrupted", 9), ("b", "done", 3), ("c", None, None)]


def test_relocated_files_move_or_are_missing(spark):
    p = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 0), (3, 2, "a", 0), (4, None, "a", 0)], "photo_id long, root_id int, rel_path string, missing int")
    found = spark.createDataFrame([("a",), ("a",)], "rel_path string")
    assert rows(edits.relocate(p, 1, 5, found), "photo_id", "root_id", "missing") == [(1, 5, 0), (2, 1, 1), (3, 2, 0), (4, None, 0)]


def test_duplicates_of_lists_members(spark):
    p = spark.createDataFrame([(1, 9, "exact"), (2, 9, "near"), (3, None, None)], "photo_id long, dup_group_id long, dup_kind string")
    assert rows(edits.duplicates_of(p, p.where("photo_id <> 2"))) == [(1, 9, 1, True), (1, 9, 2, False), (3, None, None, None)]


def test_projection_has_every_column_and_its_defaults(spark):
    photos = spark.createDataFrame([(1, 2, None, 4, 5)], "photo_id long, root_id long, flag int, burst_id long, device_id long")
    one = lambda *r, s: spark.createDataFrame([r], s)
    got = edits.project(photos, one(2, "/r", s="root_id long, root_path string"), one(4, 3, s="burst_id long, burst_size long"), one(6, "phone", s="device_id long, device_kind string"), one(1, 0.5, s="photo_id long, taste_score double")).first().asDict()
    assert len(got) == 39 and (got["root_path"], got["burst_size"], got["device_kind"], got["taste_score"], got["flag"], got["lens"]) == ("/r", 3, None, 0.5, 0, None)


def test_donor_scores_by_hand(spark):
    schema = "photo_id long, person_id long, measured boolean, area double, shine double, roughness double, sharpness double, yaw double, pitch double, roll double"
    c = spark.createDataFrame([(1, 1, True, 0.2, 0.01, 0.1, 0.5, 0.0, 0.0, 0.0), (2, 1, True, 0.4, 0.0, 0.0, None, 10.0, 0.0, 0.0), (3, 1, False, 9.0, None, None, None, None, None, None), (4, 2, True, 1.0, None, None, None, 0.0, 0.0, 0.0)], schema)
    got = rows(ranking.donor_scores(c.where("photo_id IN (1, 4)"), c))
    # Photo 2: area 0.4 against a median of 0.3 counts in full, sharpness is unknown, the pose is half its limit away.
    assert got == [(1, 1, 2, round((0.35 + 0.25 + 0.2 + 0.2 * 0.5) * (1 - 0.15), 3)), (1, 1, 3, None)]


def test_offsets_beyond_a_week_are_refused(spark):
    schema = "session_id long, device_id long, offset_ms long"
    e = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7)], schema).withColumn("source", F.lit("auto")).withColumn("confidence", F.lit(0.6))
    made = spark.createDataFrame([(1, 1, 604_800_001), (1, 2, None), (1, 3, -604_800_000)], schema)
    assert rows(alignment.with_offset(e, made), "device_id", "offset_ms", "source") == [(1, 5, "auto"), (3, -604_800_000, "manual")]


def test_donor_scores_are_made_where_candidates_are(spark):
    schema = "photo_id long, person_id long, measured boolean, area double, shine double, roughness double, sharpness double, yaw double, pitch double, roll double"
    c = spark.createDataFrame([(i, i % 2, True, 0.2, 0.01, 0.1, 0.5, 0.0, 0.0, 0.0) for i in range(200)], schema)
    got = ranking.donor_scores(c.where("photo_id % 50 = 0"), c)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [x for x in plan if "Join" in x]
    assert "BroadcastHashJoin" in joins[0] and got.count() == 4 * 99  # no sort or shuffle that a large person would gather in


def test_donor_scores_of_unknown_angles_and_little_disk(spark, tmp_path):
    r = random.Random(4)
    angle = lambda: r.choice([None, float("nan"), 0.0, 5.0, -12.5, 40.0])
    made = [(i, r.choice([1, 1, None]), r.random() < 0.8, 0.2, 0.01, 0.1, 0.5, angle(), angle(), angle()) for i in range(400)]
    c = spark.createDataFrame(made, "photo_id long, person_id int, measured boolean, area double, shine double, roughness double, sharpness double, yaw double, pitch double, roll double")
    worth = 0.35 * (1 / 1.3) + 0.25 * (1 - 0.01 / 0.05) + 0.2 * (1 - 0.1 / 0.3) + 0.2 * (1 / 1.5)

    def score(d, t):
        turns = [1.0 if math.isnan(a - b) else min(abs(a - b) / most, 1.0) for a, b, most in zip(d[7:], t[7:], (20, 15, 20)) if a is not None and b is not None]
        return round(worth * (1 - 0.3 * max(turns, default=0.0)), 3) if d[2] else None

    want = {(t[0], t[1], d[0]): score(d, t) for t in made if t[0] % 3 == 0 and t[1] for d in made if d[1] == t[1] and d[0] != t[0]}
    got = ranking.donor_scores(c.where("photo_id % 3 = 0"), c)
    assert {tuple(x)[:3]: x.score for x in got.collect()} == pytest.approx(want) and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(photo_id" not in plan  # candidates aren't dealt out anew
