import random

import pytest

from quillon.operators import filters as f
from quillon.operators.filters import Catalog, PhotoQuery

PHOTO = "photo_id long, session_id long, taken_at long, file_name string, user_rating int, flag int, color_label string, ai_score double, ai_rating double, taste_score double, issues int, analysis_version int, burst_id long, rank_in_burst int, scene_type string, device_id long, lens string, has_edits int, dup_group_id long, sharpness double, pair_id long"


@pytest.fixture(scope="module")
def cat(spark):
    r = random.Random(11)
    maybe = lambda x: None if r.random() < 0.2 else x
    photos = [
        (i, i % 3, maybe(r.randrange(20)), r.choice(["a.jpg", "A.jpg", "b.JPG", "É.jpg", "é.jpg", "z"]), maybe(r.randint(0, 5)), r.choice([-1, 0, 1]), maybe(r.choice(f.COLORS)), maybe(round(r.random(), 7)), maybe(r.randint(0, 10) / 2), maybe(r.random()), maybe(r.randrange(256)), r.randrange(2), maybe(r.randrange(30)), r.randrange(4),
         maybe("group"), maybe(r.randrange(4)), maybe("L" + str(r.randrange(3))), maybe(r.randrange(2)), maybe(i // 10), maybe(r.random()), None)
        for i in range(300)
    ]
    faces = [(r.randrange(300), maybe(r.randrange(5)), maybe(r.random()), maybe(r.random()), maybe(r.random()), r.randrange(2)) for _ in range(500)]
    tags = [(r.randrange(300), f"t{r.randrange(4)}") for _ in range(400)]
    return Catalog(
        spark.createDataFrame(photos, PHOTO).cache(), spark.createDataFrame(faces, "photo_id long, person_id long, eyes_open double, smile double, gaze double, is_subject int").cache(), spark.createDataFrame(tags, "photo_id long, tag string").cache(),
        spark.createDataFrame([(b, b // 3) for b in range(30)], "burst_id long, scene_id long"), spark.createDataFrame([(s, s // 2) for s in range(10)], "scene_id long, event_id long"),
    )


def ids(df):
    return sorted(r.photo_id for r in df.collect())


def plain(cat, keep):
    return sorted(p.photo_id for p in cat.photo.collect() if keep(p))


def test_person_semantics(cat):
    faces = cat.face.collect()

    def of(p, person, states=lambda x: True, subject=True):
        return any(x.photo_id == p.photo_id and x.person_id == person and (x.is_subject == 1 or not subject) and states(x) for x in faces)

    smiling = lambda x: x.smile is not None and x.smile >= 0.5 and x.eyes_open is not None and x.eyes_open >= 0.55
    assert ids(f.filtered(cat, PhotoQuery(persons=(1, 2)))) == plain(cat, lambda p: of(p, 1) or of(p, 2))
    assert ids(f.filtered(cat, PhotoQuery(persons=(1, 2, 2), person_mode="all"))) == plain(cat, lambda p: of(p, 1) and of(p, 2))
    assert ids(f.filtered(cat, PhotoQuery(persons=(1,), person_state=("smiling", "eyes_open")))) == plain(cat, lambda p: of(p, 1, smiling))
    assert ids(f.filtered(cat, PhotoQuery(exclude_persons=(1,), person_state=("smiling",), include_background=True))) == plain(cat, lambda p: not of(p, 1, subject=False) and any(x.photo_id == p.photo_id and (x.smile or 0) >= 0.5 for x in faces))


@pytest.mark.parametrize("sort", list(f.SORTS))
@pytest.mark.parametrize("limit", [7, 50])
def test_pages_join_up_to_the_whole_order(cat, sort, limit):
    def key(p):
        k = {
            "taken_at": p.taken_at if p.taken_at is not None else f.LAST, "-taken_at": -(p.taken_at if p.taken_at is not None else f.FIRST), "name": p.file_name.translate(str.maketrans(f.exprs.UPPER, f.exprs.LOWER)),
            "rating": -(p.user_rating if p.user_rating is not None else -1), "ai": -int((p.ai_score if p.ai_score is not None else -0.001) * 1e6), "taste": -int((p.taste_score if p.taste_score is not None else -0.001) * 1e6),
        }[sort]
        return k, p.photo_id

    q, got = PhotoQuery(session_id=1, sort=sort, limit=limit), []
    total = None
    while True:
        page = f.page(cat, q)
        got += [r.photo_id for r in page.rows]
        total = page.total if total is None else total
        assert page.total == total
        if page.next_cursor is None:
            break
        q = PhotoQuery(session_id=1, sort=sort, limit=limit, cursor=page.next_cursor)
    expected = [p.photo_id for p in sorted((p for p in cat.photo.collect() if p.session_id == 1), key=key)]
    assert got == expected and total == len(expected)


def test_sharp_states_part_the_photos(cat):
    parts = [ids(f.filtered(cat, PhotoQuery(sharp=s))) for s in ("sharp", "blurry", "unknown")]
    assert sorted(sum(parts, [])) == list(range(300))


@pytest.mark.parametrize("wrong", [{"flag": "x"}, {"sort": "size"}, {"issues_any": ("fog",)}, {"taken_from": 2, "taken_to": 1}, {"face_similarity": 1.2}, {"person_mode": "none"}, {"color_label": "pink"}, {"sharp": "very"}, {"person_state": ("asleep",)}])
def test_bad_queries(wrong):
    with pytest.raises(ValueError):
        PhotoQuery(**wrong)


def test_cursors():
    assert f.decode_cursor(f.encode_cursor("né", 4), "name") == ("né", 4)
    for bad in ("zz", "7b7d", f.encode_cursor("a", 1)):
        with pytest.raises(ValueError):
            f.decode_cursor(bad, "rating")
    assert PhotoQuery(limit=0).page_size == 1 and PhotoQuery(limit=10**6).page_size == f.MAX_LIMIT


def test_filters_reach_the_scan(spark, tmp_path, cat):
    cat.photo.write.parquet(str(tmp_path / "p"))
    q = f.filtered(Catalog(spark.read.parquet(str(tmp_path / "p"))), PhotoQuery(rating_gte=4, flag="picked")).select("photo_id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_rating,4)" in plan and "EqualTo(flag,1)" in plan and "file_name" not in plan.split("ReadSchema")[1]
