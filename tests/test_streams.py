from quillon.streaming import changes as c

EVENT = "seq long, t long, kind string, key long, count long, payload string, id long"
CHANGE = "session_id long, old_flag int, new_flag int, old_rating int, new_rating int, old_member boolean, new_member boolean"


def test_coalescing(spark):
    rows = [(1, 0, "update", 7, None, "a", None), (2, 50, "update", 7, None, "b", None), (3, 60, "added", 1, 3, None, None), (4, 70, "added", 1, 4, None, None), (5, 80, "ids", 1, None, None, 9), (6, 81, "ids", 1, None, None, 5), (7, 82, "ids", 1, None, None, 9), (8, 90, "done", 1, None, "x", None), (9, 91, "done", 1, None, "y", None), (10, 120, "update", 7, None, "c", None)]
    got = [(r.tick, r.kind, r.n, r.payload, r.ids) for r in c.coalesce_events(spark.createDataFrame(rows, EVENT)).orderBy("first_seq").collect()]
    assert got == [(0, "update", None, "b", None), (0, "added", 7, None, None), (0, "ids", None, None, [9, 5]), (0, "done", None, "x", None), (0, "done", None, "y", None), (1, "update", None, "c", None)]


CHANGES = [(1, None, 0, None, None, False, True), (1, 0, 1, None, 4, True, True), (1, 1, -1, 4, None, True, True), (2, None, 1, None, 5, False, True), (2, 1, None, 5, None, True, False)]


def test_counters_retract(spark):
    got = {r.session_id: tuple(r)[1:] for r in c.counter_deltas(spark.createDataFrame(CHANGES, CHANGE)).collect()}
    assert got == {1: (1, 0, 1, 0), 2: (0, 0, 0, 0)}


def test_counter_stream(spark, tmp_path):
    for k, part in enumerate((CHANGES[:2], CHANGES[2:])):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = c.stream_counters(stream, "counters_test", str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {r.session_id: tuple(r)[1:] for r in spark.table("counters_test").collect()} == {1: (1, 0, 1, 0), 2: (0, 0, 0, 0)}


def test_coalesced_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0, "added", 1, 3, None, None), (2, 10, "added", 1, 4, None, None)], EVENT).write.parquet(str(tmp_path / "in"))
    seen = []
    c.stream_coalesced(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), lambda df: seen.extend(df.collect()), str(tmp_path / "state")).awaitTermination(120)
    assert [r.n for r in seen] == [7]


def debounced(ts, quiet, wait):
    out, first, last, n = [], None, None, 0
    for t in sorted(ts):
        if first is not None and (t - last >= quiet or t - first >= wait):
            out.append((min(last + quiet, first + wait), n))
            first, n = None, 0
        first = t if first is None else first
        last, n = t, n + 1
    return out + [(min(last + quiet, first + wait), n)]


def test_debounce(spark):
    ts = [0, 300, 900, 1_500, 2_200, 2_900, 3_500, 4_000, 9_000, 20_000, 20_100]
    got = c.debounce(spark.createDataFrame([(1, t) for t in ts], "root_id long, t long")).orderBy("fire_at").collect()
    assert [(r.fire_at, r.n) for r in got] == debounced(ts, c.DEBOUNCE_MS, c.MAX_WAIT_MS)


def test_retraining(spark):
    ts = [i * 1_000 for i in range(60)] + [500_000, 500_001]
    got = [(r.t, r.pending) for r in c.retrain_times(spark.createDataFrame([(t,) for t in ts], "t long")).collect()]
    assert got == [(49_000, 50), (59_000 + c.RETRAIN_IDLE_MS, 10)]


def test_retraining_of_all_users(spark):
    """The query takes every user's events, each by themselves; a null key is a key too."""
    from quillon.plans.stream_queries import retrain_times
    from quillon.sources.views import view

    sf = "/root/testdata/sf0.001"
    events = {}
    for r in view(spark, sf, "item").select("user_id", "t").collect():
        events.setdefault(r.user_id, []).append(r.t)
    expected = sorted((u, r.t, r.pending) for u, ts in list(events.items())[:3] for r in c.retrain_times(spark.createDataFrame([(t,) for t in ts], "t long")).collect())
    got = retrain_times(spark, sf)
    assert got.columns == ["user_id", "t", "pending"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r for r in rows if r[0] in list(events)[:3]) == expected
    assert len({r[0] for r in rows}) > 1
    labels = spark.createDataFrame([(k, i * 1_000) for k in (1, None) for i in range(12)], "who long, t long")
    assert sorted(((r.who, r.t, r.pending) for r in c.retrain_times(labels, "who").collect()), key=str) == sorted([(1, 11_000 + c.RETRAIN_IDLE_MS, 12), (None, 11_000 + c.RETRAIN_IDLE_MS, 12)], key=str)


def test_retrain_stream(spark, tmp_path):
    spark.createDataFrame([(1, i) for i in range(120)] + [(2, 1)], "user_id long, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, t long").parquet(str(tmp_path / "in"))
    query = c.stream_retrain(stream).writeStream.format("memory").queryName("retrain_test").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.user_id, r.pending) for r in spark.table("retrain_test").collect()) == [(1, 50), (1, 50)]
