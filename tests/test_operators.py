import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators import alignment, duplicates, maintenance, people, preference, ranking, rollups, search
from quillon.operators.graph import connected_components
from quillon.operators.grouped import map_groups
from quillon.plans import text_plan
from quillon.sources import files


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(5, 5), (None, 3)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    nodes = {x for e in edges for x in e if x is not None}
    assert got == {x: top(x) for x in nodes if top(x) != x}


def test_map_groups_streams_groups(spark):
    df = spark.range(10_000).selectExpr("id % 37 AS k", "id AS v")
    got = map_groups(df, ["k"], ["v"], lambda c: {"k": c["k"][:1], "n": [len(c["v"])], "sorted": [c["v"] == sorted(c["v"])]}, "k long, n long, sorted boolean").collect()
    assert {r.k: r.n for r in got} == {k: 10_000 // 37 + (k < 10_000 % 37) for k in range(37)} and all(r.sorted for r in got)


ITEM = "id long, content_key string, file_size long, phash long, width int, height int, has_time boolean"


def test_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(63) for _ in range(12)]
    items = []
    for i in range(200):
        h = r.choice(seeds)
        for _ in range(r.randrange(6)):
            h ^= 1 << r.randrange(63)
        items.append((i, r.choice(["a", "b", None, str(i)]), r.choice([1, 2, None]), r.choice([h, h, None]), r.choice([4000, 4030, 3000, 0]), 3000, r.random() < 0.5))

    def near(x, y):
        a, b = x[4] * y[5], x[5] * y[4]
        return None not in (x[3], y[3]) and not (x[6] and y[6]) and (x[3] ^ y[3]).bit_count() <= 4 and min(x[4], y[4]) > 0 and abs(a - b) <= 0.01 * max(a, b)

    pairs = {(x[0], y[0]) for x in items for y in items if x[0] < y[0] and near(x, y)}
    df = spark.createDataFrame(items, ITEM)
    found = [(p.a, p.b) for p in duplicates.near_pairs(df).collect()]
    assert sorted(found) == sorted(pairs) and pairs
    exact = {(x[0], y[0]) for x in items for y in items if x[0] < y[0] and None not in (x[1], x[2]) and x[1:3] == y[1:3]}
    group = list(range(200))
    for _ in range(200):
        for a, b in pairs | exact:
            group[a] = group[b] = min(group[a], group[b])
    exact_ids = {i for p in exact for i in p}
    linked = {i for p in pairs | exact for i in p}
    got = {g.id: (g.group_id, g.kind) for g in duplicates.duplicate_groups(df).collect()}
    assert got == {i: (group[i], "exact" if i in exact_ids else "near") for i in linked}


def test_search(spark):
    rows = [(i, [float(i % 5), 1.0, i / 50]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    q = [1.0, 1.0, 0.0]
    got = search.ranked(df, q, "id", "v", confident=2.0).collect()
    cos = {i: float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) for i, v in rows if v and len(v) == 3 and any(v)}
    cut = np.mean(list(cos.values())) + 2 * np.std(list(cos.values()))
    assert [r.id for r in got] == sorted((i for i in cos if cos[i] >= cut), key=lambda i: (-np.float64(np.float32(cos[i])), i)) or not got
    s = search.summary(df, q, "v").first()
    assert (s.searched, s.unindexed, s.low_confidence) == (60, 3, False)
    assert [r.id for r in search.ranked(df, q, "id", "v", min_score=0.5, limit=5).collect()] == [r.id for r in search.ranked(df, q, "id", "v", min_score=0.5).collect()][:5]
    assert search.summary(df.limit(0), q, "v").first().searched == 0


def test_search_needs_thirty(spark):
    df = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "id long, v array<float>")
    assert search.ranked(df, [1.0, 0.0], "id", "v").count() == 10


def test_tracks_and_people():
    a, b = np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])
    box = lambda x: (x, 0.1, 0.2, 0.2)
    assert people.tracks_of([0, 0, 1, 1], [box(0.1), box(0.6), box(0.6), box(0.1)], [a, b, b, a]) == [0, 1, 1, 0]
    assert people.tracks_of([0, 1, 2], [box(0.1), box(0.12), box(0.7)], [None, None, None]) == [0, 0, 1]
    assert people.tracks_of([0, 1], [box(0.1), box(0.7)], [a, a]) == [0, 0]
    t = lambda v, p, **k: people.Track(v, frozenset(p), **k)
    near = a + 0.1 * b
    assert people.cluster_tracks([t(a, {1}), t(near, {2}), t(b, {3})]) == [("new", 0), ("new", 0), ("none", -1)]
    assert people.cluster_tracks([t(a, {1}), t(near, {1})]) == [("none", -1), ("none", -1)]  # one photo can't hold a person twice
    assert people.cluster_tracks([t(a, {1}), t(near, {2})], {7: a}) == [("person", 7), ("person", 7)]
    assert people.cluster_tracks([t(a, {1}, locked=9), t(near, {2})]) == [("person", 9), ("person", 9)]
    assert people.cluster_tracks([t(a, {1}, reliable=False), t(near, {2}, reliable=False)]) == [("weak", 0), ("weak", 0)]
    assert people.cluster_tracks([t(a, {1}), t(a, {2}), t(near, {3}, reliable=False), t(None, {4})]) == [("new", 0), ("new", 0), ("new", 0), ("none", -1)]


def test_subjects():
    big, small = [0.4, 0.4, 0.2, 0.2], [0.02, 0.02, 0.02, 0.02]
    assert people.subject_flags([big, small], [0.8, 0.8], [None, None], [False, False]) == [True, False]
    row = [[0.05 + 0.18 * i, 0.4, 0.12, 0.15] for i in range(5)]
    assert people.subject_flags(row, [0.7] * 5, [None] * 5, [False] * 5) == [True] * 5
    assert people.subject_flags([], [], [], []) == []


def test_alignment():
    r = random.Random(6)
    p = alignment.AlignParams()
    true = [(i * 400_000, 90_000 + r.randrange(-2_000, 2_000)) for i in range(12)]
    noise = [(r.randrange(5_000_000), r.randrange(-80_000_000, 80_000_000)) for _ in range(6)]
    peak = lambda rows: alignment.peak_of(*(np.array(c) for c in zip(*rows)), p)
    centre, support, sure = peak(true + noise)
    assert abs(centre - 90_000) < 2_000 and support == 12 and sure > 0.5
    assert peak(noise) is None and peak(true[:2]) is None
    assert alignment.chained({1: (500, 0.9)}, {(1, 2): (100, 0.8), (2, 3): (-40, 0.7)}, {1: 5, 2: 5, 3: 5, 4: 5}) == {1: (500, 0.9), 2: (600, 0.8), 3: (560, 0.7)}
    assert alignment.chained({}, {(1, 2): (100, 0.8)}, {1: 3, 2: 9}) == {2: (0, 1.0), 1: (-100, 0.8)}
    # The surest path, not the shortest.
    assert alignment.chained({1: (0, 1.0)}, {(1, 3): (7, 0.2), (1, 2): (10, 0.9), (2, 3): (20, 0.8)}, {1: 1, 2: 1, 3: 1}) == {1: (0, 1.0), 2: (10, 0.9), 3: (30, 0.8)}


def test_peaks_and_chains_of_tables(spark):
    r = random.Random(6)
    rows = [(1, 2, i * 400_000, 90_000 + r.randrange(-2_000, 2_000)) for i in range(12)] + [(1, 3, r.randrange(5_000_000), r.randrange(-80_000_000, 80_000_000)) for i in range(6)]
    found = alignment.offset_peaks(spark.createDataFrame(rows, "low long, high long, t long, delta long"), ["low", "high"]).collect()
    assert [(x.low, x.high, x.support) for x in found] == [(1, 2, 12)]
    anchors = spark.createDataFrame([(5, 1, 500, 0.9)], "session_id long, device long, offset long, confidence double")
    pairs = spark.createDataFrame([(5, 1, 2, 100, 0.8), (5, 2, 3, -40, 0.7), (6, 1, 2, 100, 0.8)], "session_id long, low long, high long, delta long, confidence double")
    counts = spark.createDataFrame([(5, d, 5) for d in (1, 2, 3, 4)] + [(6, 1, 3), (6, 2, 9)], "session_id long, device long, n long")
    got = {(x.session_id, x.device): (x.offset, x.confidence) for x in alignment.chained_offsets(anchors, pairs, counts).collect()}
    assert got == {(5, 1): (500, 0.9), (5, 2): (600, 0.8), (5, 3): (560, 0.7), (6, 2): (0, 1.0), (6, 1): (-100, 0.8)}
    by_hand = spark.createDataFrame([(5, 2, 7), (5, 3, None), (5, 9, 1)], "session_id long, device_id long, offset_ms long")
    kept = alignment.with_offset(spark.createDataFrame([(5, 2, 600, "gps", 0.8), (5, 3, 560, "gps", 0.7), (6, 1, 3, "visual", 0.6)], "session_id long, device_id long, offset_ms long, source string, confidence double"), by_hand)
    assert sorted(tuple(x) for x in kept.collect()) == [(5, 2, 7, "manual", 1.0), (5, 9, 1, "manual", 1.0), (6, 1, 3, "visual", 0.6)]


def test_preference(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    x[r.random(x.shape) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 3]) + r.normal(size=400) * 0.3 > 0
    fold = np.arange(400) // 2 % 5
    out = preference.train(x, y, fold, r.random(400))
    assert out.used and out.auc > 0.9 and out.weights[0] > 0.5 and out.weights[3] < -0.5 and abs(out.weights[1]) < 0.2
    assert not preference.train(x[:40], y[:40], fold[:40], r.random(40)).used
    assert not preference.train(x, r.random(400) < 0.5, fold, r.random(400)).used
    assert preference.train(x, y, fold, np.where(y, 1.0, 0.0)).used is False  # no better than the generic score
    rows = spark.range(400).selectExpr("1L AS k", "id AS photo_id", "id < 50 AS positive")
    picked = preference.stratified(rows, "k", 100).collect()
    assert len(picked) == 100 and sum(p.positive for p in picked) == 50
    few = preference.stratified(rows.where("photo_id >= 40"), "k", 100).collect()
    assert len(few) == 100 and sum(p.positive for p in few) == 10 and preference.stratified(rows, "k", 1000).count() == 400


def test_fit_is_the_least_penalised_loss():
    r = np.random.default_rng(2)
    x, y = np.c_[r.normal(size=(90, 3)), np.ones(90)], r.random(90) < 0.3
    w = preference.fit(x, y, 0.03)

    def loss(w):
        each = np.log1p(np.exp(-np.where(y, 1, -1) * (x @ w)))
        return each[y].mean() / 2 + each[~y].mean() / 2 + 0.015 * (w[:3] ** 2).sum()

    assert all(loss(w) <= loss(w + 0.01 * r.normal(size=4)) for _ in range(200))


def test_names():
    assert ranking.unique_names(["a.jpg", "A.jpg", "a_1.jpg", "b", "b"], {"B"}) == ["a.jpg", "A_1.jpg", "a_1_1.jpg", "b_1", "b_2"]
    assert ranking.fill_template("{name}-{seq}-{x}", {"name": "{seq}", "seq": "7"}) == "{seq}-7-{x}"
    assert ranking.sanitize_name('a/b:c*"d". ') == "a_b_c__d_" and ranking.sanitize_name("..") == "_"


def test_medians_and_moments(spark):
    df = spark.createDataFrame([([5, 1, 3],), ([4, 1],), ([-4, -1],), ([],)], "v array<long>")
    assert [r[0] for r in df.select(rollups.lower_median("v" and __import__("pyspark").sql.functions.col("v"))).collect()] == [3, 2, -3, None]
    col = __import__("pyspark").sql.functions.col
    ts = spark.createDataFrame([([0, 50, 100, 101, 150, 202],), ([],)], "v array<long>")
    assert [r[0] for r in ts.select(rollups.moments(col("v"), 100)).collect()] == [3, 0]


def test_files(spark, tmp_path):
    for name in ("a.JPG", "b.nef", "sub/c.heic", "sub/.trash/d.jpg", "e.txt", "skip/f.png"):
        p = tmp_path / "photos" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
    got = files.scan_dir(spark, str(tmp_path / "photos"), exclude=["skip", ".tr*"]).collect()
    assert {(r.rel_path, r.format, r.file_size) for r in got} == {("a.JPG", "jpeg", 5), ("b.nef", "raw", 5), ("sub/c.heic", "heif", 10)}
    assert files.scan_dir(spark, str(tmp_path / "photos"), recursive=False).count() == 2


def test_codecs(spark, tmp_path):
    v = [1.0, -2.5, 0.0999755859375]
    assert files.decode_f16(files.encode_f16(v)) == v and files.decode_f16(b"x") is None and files.encode_f16(None) is None
    df = files.from_f16(files.with_f16(spark.createDataFrame([(1, v), (2, None)], "id long, v array<float>"), "v", "raw"), "raw", "back")
    assert [r.back for r in df.orderBy("id").collect()] == [v, None]
    for kind in ("<f2", "<f4"):
        np.save(tmp_path / f"{kind[1:]}.npy", np.arange(6).reshape(2, 3).astype(kind))
    got = files.read_vectors(spark, str(tmp_path)).orderBy("path", "row").collect()
    assert [list(r.vector) for r in got] == [[0, 1, 2], [3, 4, 5]] * 2
    with pytest.raises(ValueError):
        files.parse_npy(b"junk")


XMP = """<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmp:Rating="4" xmp:Label="Red" xmpDM:pick="1">{}</rdf:Description></rdf:RDF></x:xmpmeta>"""


def test_sidecars(spark):
    bag = lambda name, *words: f"<{name}><rdf:Bag>" + "".join(f"<rdf:li>{w}</rdf:li>" for w in words) + f"</rdf:Bag></{name}>"
    texts = [XMP.format(bag("dc:subject", "sea", "sun")), XMP.format(bag("lr:hierarchicalSubject", "place|coast|beach"))]
    col = __import__("pyspark").sql.functions.col
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(files.sidecar_values(col("x"))).collect()]
    assert (got[0].rating, got[0].label, got[0].keywords) == (4, "Red", ["sea", "sun"]) and got[1].keywords == ["beach"]


def test_fingerprint():
    assert maintenance.fingerprint(["b", "a", "a"]) == maintenance.fingerprint(["a", "b"]) != maintenance.fingerprint(["a"])


def test_dice(spark):
    f = __import__("pyspark").sql.functions
    got = [r[0] for r in spark.createDataFrame([("abca", "aab"), ("", "x"), ("ab", "ba")], "a string, b string").select(exprs.multiset_dice(f.col("a"), f.col("b"))).collect()]
    assert got == [pytest.approx(6 / 7), 0.0, 1.0]


LATEST = dt.date(2024, 5, 15)  # a Wednesday


@pytest.mark.parametrize(
    "said, first, last",
    [("photos from today", "2024-05-15", "2024-05-15"), ("last week", "2024-05-06", "2024-05-12"), ("this week", "2024-05-13", "2024-05-19"), ("past 3 days", "2024-05-13", "2024-05-15"), ("last month", "2024-04-01", "2024-04-30"), ("this month", "2024-05-01", "2024-05-31"), ("last year", "2023-01-01", "2023-12-31"), ("2024-02-28 to 2024-03-01", "2024-02-28", "2024-03-01"), ("上周", "2024-05-06", "2024-05-12"), ("昨天", "2024-05-14", "2024-05-14")],
)
def test_dates(said, first, last):
    assert tuple(map(str, text_plan.day_range(text_plan.normalize(said), LATEST))) == (first, last)


def test_text_to_plan():
    people_known = {1: "Alice", 2: "Roberto"}
    read = lambda s: text_plan.parse(s, LATEST, people_known)
    plan = read("Show Alice and Robertto smiling, four stars or better!")
    assert plan.calls == (text_plan.Call("filter", {"persons": (1, 2), "person_mode": "all", "rating_gte": 4, "person_state": ("smiling",)}),)
    plan = read("keep the best three photos of each burst and reject the rest")
    assert plan.calls[-1] == text_plan.Call("group_keep_top", {"n": 3, "reject_rest": True, "target": "current_filter"}) and plan.needs_confirmation
    plan = read("reject blurry photos from last week")
    assert plan.calls[0].args["issues_any"] == ("blurry",) and plan.calls[1].args == {"flag": -1, "target": "current_filter"}
    assert read("not blurry, unedited").calls[0].args == {"issues_none": True, "has_edits": False}
    assert read("五星照片").calls[0].args == {"rating_gte": 5} and text_plan.han_number("二十三") == 23
    assert text_plan.normalize("Ｔｏｐ　２，best FIVE") == "top 2 best 5"
    for calls in ([], [text_plan.Call("explode")], [text_plan.Call("filter", {"flag": "x"})], [text_plan.Call("export"), text_plan.Call("filter", {})], [text_plan.Call("group_keep_top", {"n": 0})]):
        with pytest.raises(ValueError):
            text_plan.validate(calls)


def shuffles_of_pairs(df):
    """Exchanges above a join in the executed plan: what they move are pairs."""
    df.write.format("noop").mode("overwrite").save()
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [k for k, x in enumerate(lines) if "Join " in x]
    return [x for x in lines[: joins[0]] if any(n in x for n in ("Aggregate", "Window", "Sort", "Repartition"))]


def test_donors_of_ties_nulls_and_strangers(spark):
    r = random.Random(3)
    made = [(i, r.choice([1, 1, 2, None]), r.choice([None, 1, 2, 3]), None if r.random() < 0.1 else r.randrange(10) * 60_000 + r.choice([0, 59_999]), r.choice([None, 0.0, -0.0, 0.5, float("nan"), r.random()])) for i in range(300)]
    c = spark.createDataFrame(made, "photo_id long, person_id int, session_id int, t long, score double")
    t = c.where("photo_id % 7 = 0").union(spark.createDataFrame([(1000, 2, 3, 61_000, 0.0), (1001, 9, 1, 0, 0.0)], c.schema))

    def rank(target, x):
        mate = 2 if x[2] is None or target[2] is None else int(x[2] != target[2])
        score = (2, 0) if x[4] is None else (0, 0) if x[4] != x[4] else (1, -x[4])
        minutes = -1 if x[3] is None or target[3] is None else abs((x[3] - target[3]) // 60_000)
        return mate, score, minutes, x[0]

    want = []
    for target in [tuple(x) for x in t.collect() if x.person_id]:
        found = sorted((x for x in made if x[1] == target[1] and x[0] != target[0]), key=lambda x: rank(target, x))
        want += [(target[0], target[1], x[0], k) for k, x in enumerate(found, 1)]
    got = ranking.donors(t, c)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan.splitlines()[0]  # no pair is shuffled or sorted
    before = ranking.ROWS_A_BATCH, ranking.PAIRS_A_SHARE
    try:
        ranking.PAIRS_A_SHARE = 500  # several shares a person
        assert sorted(tuple(x) for x in ranking.donors(t, c).collect()) == sorted(want)
    finally:
        ranking.ROWS_A_BATCH, ranking.PAIRS_A_SHARE = before
    assert ranking.donors(t.where("false"), c).count() == 0


def test_theta_candidates_of_ids_with_several_rows(spark):
    r = random.Random(5)
    made = [(r.randrange(120), r.choice([None, 1, 2, 3, 4]), r.choice([None, *range(12)]), r.choice([None, *range(6)])) for _ in range(200)]
    f = spark.createDataFrame(made, "face_id long, person_id int, track_id int, session_id int")
    eq = lambda a, b: a is not None and a == b
    want = {(a[0], b[0]) for a in made if a[0] % 5 == 0 for b in made if a[0] != b[0] and (eq(a[1], b[1]) or eq(a[2], b[2]) or b[1] is None and eq(a[3], b[3]))}
    got = maintenance.theta_candidates(f.where("face_id % 5 = 0").distinct(), f)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert not shuffles_of_pairs(got)


def test_theta_candidates_of_a_common_person_pack_well(spark, tmp_path):
    f = spark.range(20_000).selectExpr("id * 7919 AS face_id", "1 AS person_id", "cast(null AS int) AS track_id", "2 AS session_id")
    maintenance.theta_candidates(f, f.where("face_id % 100 = 0")).write.parquet(path := str(tmp_path / "pairs"))
    n = spark.read.parquet(path).distinct().count()
    assert n == 200 * 20_000 - 200  # each face once with each target but itself
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < n / 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_donors_in_stretches_pack_well_and_photos_are_dealt_once(spark, tmp_path):
    c = spark.range(30_000).selectExpr("id AS photo_id", "cast(id % 2 AS int) AS person_id", "cast(id % 5000 AS int) AS session_id", "id * 60000 AS t", "cast((id * 7919) % 30011 AS double) AS score")
    t = c.where("photo_id % 100 = 0")
    before = ranking.GROUP, ranking.STRETCH
    got = ranking.donors(t, c)
    got.write.parquet(path := str(tmp_path / "pairs"))
    n = spark.read.parquet(path).count()
    assert n == 300 * 14_999
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2 * n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # shares are broadcast
    few = c.where("photo_id < 900").withColumn("score", F.expr("score % 7")).withColumn("session_id", F.expr("nullif(session_id % 4, 0)"))
    want = sorted(tuple(x) for x in ranking.donors(few.where("photo_id % 20 < 2"), few).collect())
    try:
        ranking.GROUP, ranking.STRETCH = 7, 16
        assert sorted(tuple(x) for x in ranking.donors(few.where("photo_id % 20 < 2"), few).collect()) == want
    finally:
        ranking.GROUP, ranking.STRETCH = before
