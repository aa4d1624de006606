import math
import random

from quillon.operators import segments as s

SCHEMA = "session_id long, id long, t long, name string, device long, phash long, embedding array<float>"


def rows_of(seed, n):
    r, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice([200, 400, 900, 2_500, 8_000, 29_000, 31_000, 60_000])
        base = r.randrange(3)
        out.append((1, i, None if r.random() < 0.1 else t, r.choice("abC"), r.choice([None, 1, 1, 2]), base * 0x0F0F0F0F0F0F + (1 << r.randrange(60)) * r.randrange(2), None if r.random() < 0.3 else [1.0 if base == k else r.random() * 0.4 for k in range(3)]))
    return out


def one_pass(rows, p):
    order = sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[3].lower(), x[1]))
    columns = {n: [x[k] for x in order] for k, n in enumerate(("session_id", "id", "t", "name", "device", "phash", "embedding"))}
    number = s.segment(columns, p.t_burst_ms, p)
    first = {}
    for n, x in zip(number, order):
        first.setdefault(n, x[1])
    return {x[1]: first[n] for n, x in zip(number, order)}


def test_cut_sessions_equal_one_pass(spark):
    p = s.GroupParams(t_burst_ms=3_000)
    for seed in range(6):
        rows = rows_of(seed, 90)
        got = {r.id: r.burst_id for r in s.bursts(spark.createDataFrame(rows, SCHEMA), p).collect()}
        assert got == one_pass(rows, p)
        assert 10 < len(set(got.values())) < 90


def test_burst_rules():
    def burst(*rows, **p):
        columns = {n: [x[k] for x in rows] for k, n in enumerate(("t", "device", "phash", "embedding"))}
        return s.segment(columns, 3_000, s.GroupParams(**p))

    a, b = [1.0, 0.0], [0.0, 1.0]
    assert burst((0, 1, None, a), (1_000, 1, None, a), (5_000, 1, None, b)) == [0, 0, 1]
    assert burst((0, 1, None, a), (20_000, 1, None, a), (60_000, 1, None, a)) == [0, 0, 1]  # strict likeness reaches 30 s
    assert burst((0, 1, None, a), (1_000, 1, None, b), (2_000, 1, None, a)) == [0, 0, 0]  # an odd frame at cadence is absorbed
    assert burst((0, 1, None, a), (1_000, 2, None, b), (2_000, 1, None, a)) == [0, 1, 0]  # not another camera's
    assert burst((0, None, None, a), (1_000, None, None, b), (2_000, None, None, a)) == [0, 1, 0]  # nor an unknown one's
    assert burst((None, 1, None, a), (None, 1, None, a), (None, 1, None, b)) == [0, 0, 1]
    assert burst((0, 1, 0, None), (1_000, 1, (1 << 20) - 1, None)) == [0, 1]
    assert burst((0, 1, None, None), (1_000, 1, None, None)) == [0, 1]


def test_adaptive_interval(spark):
    def t_burst(gaps):
        t, rows = 0, [(1, 0, 0)]
        for i, g in enumerate(gaps, 1):
            t += g
            rows.append((1, i, t))
        return s.adaptive_t_burst(spark.createDataFrame(rows, "k long, id long, t long"), "k").first().t_burst

    assert t_burst([300] * 5) == 3_000
    assert t_burst([400] * 15 + [4_000] * 10) == int(math.sqrt(400 * 4_000))
    assert t_burst([400] * 15 + [9_900] * 10) == int(math.sqrt(400 * 9_900))
    assert t_burst([1_000 + 10 * i for i in range(25)]) == 3_000
    assert t_burst([100] * 15 + [250] * 10) == 3_000


def test_scenes_and_events(spark):
    units = [(1, 0, 0, 1_000, [1.0, 0.0], None), (1, 1, 500_000, 600_000, [0.9, 0.1], None), (1, 2, 601_000, 602_000, [0.0, 1.0], None), (1, 3, 610_000, 611_000, None, 5), (1, 4, 612_000, 613_000, None, 7), (1, 5, 5_000_000, 5_000_001, None, 7)]
    got = s.scenes(spark.createDataFrame(units, "session_id long, id long, start_at long, end_at long, embedding array<double>, phash long")).orderBy("id").collect()
    assert [r.scene_no for r in got] == [0, 0, 1, 1, 1, 2]
    h = 3_600_000
    spans = [(1, 0, 0, 9 * h, 50.0, 8.0, 50.0, 8.0), (1, 1, h, 2 * h, None, None, None, None), (1, 2, 10 * h, 10 * h, 50.01, 8.0, 50.01, 8.0), (1, 3, 10 * h + 1, 11 * h, 51.0, 8.0, 51.0, 8.0), (1, 4, 14 * h, 14 * h, None, None, None, None)]
    got = s.events(spark.createDataFrame(spans, "session_id long, id long, start_at long, end_at long, first_lat double, first_lon double, last_lat double, last_lon double")).orderBy("id").collect()
    assert [r.event_no for r in got] == [0, 0, 0, 1, 2]


def test_ranges_of_one_session_equal_one_pass(spark, monkeypatch):
    p = s.GroupParams(t_burst_ms=3_000)
    for size, gaps in ((7, None), (23, None), (200, None), (23, 500)):
        monkeypatch.setattr(s, "ROWS_A_RANGE", size)
        for seed in range(2):
            rows = rows_of(seed, 150)
            if gaps:  # like rows close together: links cross most borders of ranges
                rows = [(1, i, None if r[2] is None else i * gaps, *r[3:5], 7, [1.0, 0.0, 0.1 * (i % 30 == 0)]) for i, r in enumerate(rows)]
            more = [(2, 1000 + r[1], *r[2:]) for r in rows[:40]]
            made = s.bursts(spark.createDataFrame(rows + more, SCHEMA), p)
            got = {r.id: r.burst_id for r in made.collect()}
            assert got == one_pass(rows, p) | one_pass(more, p)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # which sorts a session in one task
