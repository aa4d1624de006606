"""Bursts, scenes and events of time-ordered photos.

Scenes and events are single window passes. Bursts are a greedy look-back over time order: a cut wherever no link
reaches across splits a session into stretches that are segmented independently and give the same result as one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators.grouped import Columns
from quillon.sources import scratch


@dataclass(frozen=True)
class GroupParams:
    t_burst_ms: int | None = None
    t_slow_ms: int = 30_000
    theta_burst: float = 0.85
    theta_strict: float = 0.92
    theta_drift: float = 0.75
    w_embedding: float = 0.6
    lookback: int = 8
    max_fill: int = 2
    scene_gap_ms: int = 600_000
    scene_cos: float = 0.7
    scene_hash: float = 0.75
    scene_near_ms: int = 60_000
    event_gap_ms: int = 7_200_000
    event_distance_m: float = 5_000.0


#: Strictness presets: (theta_burst, theta_strict, theta_drift).
PRESETS = {"loose": (0.80, 0.88, 0.68), "normal": (0.85, 0.92, 0.75), "strict": (0.90, 0.95, 0.82)}
DEFAULT_T_BURST = 3_000


def preset(name: str) -> GroupParams:
    a, b, c = PRESETS[name]
    return GroupParams(theta_burst=a, theta_strict=b, theta_drift=c)


def adaptive_t_burst(items: DataFrame, key: str) -> DataFrame:
    """key, t_burst: the middle of the widest relative jump between neighbouring gaps of a key's times.

    Gaps are at least 200 ms and at most 20 s; with fewer than 20 of them, or no jump of half as much again between
    300 ms and 10 s, it is 3 s. The result lies in 1 to 5 s.
    """
    gap = F.greatest(F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t", "id")), F.lit(0))
    gaps = items.where("t IS NOT NULL").withColumn("gap", F.greatest(gap, F.lit(200)).cast("double")).where("gap <= 20000")
    pairs = gaps.withColumn("hi", F.lead("gap").over(Window.partitionBy(key).orderBy("gap")))
    usable = (F.col("gap") >= 300) & (F.col("hi") <= 10_000) & (F.col("hi") > F.col("gap"))
    ratio = F.when(usable, F.col("hi") / F.col("gap"))
    # The first of equal jumps: that between the smallest gaps.
    best = pairs.groupBy(key).agg(F.count("*").alias("n"), F.max(ratio).alias("ratio"), F.max_by(F.sqrt(F.col("gap") * F.col("hi")), F.struct(ratio, -F.col("gap"))).alias("mid"))
    found = F.when((F.col("n") >= 20) & (F.col("ratio") >= 1.5), F.least(F.greatest(F.floor("mid"), F.lit(1_000)), F.lit(5_000)))
    every = items.select(key).distinct()
    return every.join(best, key, "left").select(key, F.coalesce(found, F.lit(DEFAULT_T_BURST)).cast("long").alias("t_burst"))


def likeness(rows: Columns, p: GroupParams) -> tuple[np.ndarray, Callable[[int, int], float]]:
    """[row, lag]: how alike a row and that so many rows before it are (NaN before the first row), for all lags of the
    look-back at once; and the same of any two rows."""
    n = len(rows["t"])
    length = np.array([0 if v is None else len(v) for v in rows["embedding"]])
    unit = np.zeros((n, max(1, int(length.max(initial=0)))), np.float32)
    for i, v in enumerate(rows["embedding"]):
        if length[i]:
            unit[i, : length[i]] = v
    size = np.linalg.norm(unit, axis=1)
    hashed = np.array([x is not None for x in rows["phash"]])
    bits = np.array([0 if x is None else x & 0xFFFFFFFFFFFFFFFF for x in rows["phash"]], np.uint64)

    def between(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        across = size[i] * size[j]
        cos = np.divide(np.einsum("ij,ij->i", unit[i], unit[j]), across, out=np.zeros(len(i)), where=across >= 1e-12)
        same = 1.0 - np.bitwise_count(bits[i] ^ bits[j]) / 64.0
        seen, known = (length[i] > 0) & (length[i] == length[j]), hashed[i] & hashed[j]
        return np.where(seen & known, p.w_embedding * cos + (1 - p.w_embedding) * same, np.where(seen, cos, np.where(known, same, 0.0)))

    lags = max(p.lookback, 1)
    out = np.full((n, lags), np.nan)
    for lag in range(1, min(lags, n - 1) + 1):
        out[lag:, lag - 1] = between(np.arange(lag, n), np.arange(n - lag))
    return out, lambda i, j: float(between(np.array([i]), np.array([j]))[0])


def links(rows: Columns, t_burst: int, p: GroupParams) -> tuple[np.ndarray, Callable[[int, int], float], np.ndarray]:
    """likeness(), and where [row, lag] a row links to the one that so many rows lie before it."""
    alike, between = likeness(rows, p)
    t = np.array([np.nan if x is None else x for x in rows["t"]], float)
    linked = np.zeros(alike.shape, bool)
    for lag in range(1, min(alike.shape[1], len(t) - 1) + 1):
        apart, s = np.abs(t[lag:] - t[:-lag]), alike[lag:, lag - 1]
        near = ((apart <= t_burst) & (s >= p.theta_burst)) | ((apart <= p.t_slow_ms) & (s >= p.theta_strict))
        linked[lag:, lag - 1] = np.where(np.isnan(apart), s >= p.theta_strict, near)
    return alike, between, linked


def segment(rows: Columns, t_burst: int, p: GroupParams) -> list[int]:
    """Burst number of each row of one chunk in time order, numbered by first row.

    All links within the look-back are found first, as a matrix of lags. Then labels run forward: a row takes the label of
    the likest linked row whose burst has not drifted from its first row, else a label of its own.
    """
    n = len(rows["t"])
    if not n:
        return []
    alike, between, linked = links(rows, t_burst, p)
    t = np.array([np.nan if x is None else x for x in rows["t"]], float)
    label = np.arange(n)  # a burst is named by its first row
    order = np.argsort(np.where(linked, -alike, np.inf), axis=1, kind="stable")  # nearer rows win ties
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        drifted: set[int] = set()
        for lag in order[i, : linked[i].sum()].tolist():
            first = int(label[i - lag - 1])
            if first not in drifted:
                if between(first, i) >= p.theta_drift:
                    label[i] = first
                    break
                drifted.add(first)
    _fill_gaps(label, t, rows["device"], t_burst, p)
    _, first, number = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number].tolist()


def _fill_gaps(label: np.ndarray, t: np.ndarray, device: list, t_burst: int, p: GroupParams) -> None:
    """Islands between two rows of one burst join it, if they are whole bursts, short, and one known camera kept up the
    cadence over them. Overlapping islands: the earliest counts."""
    n = len(label)
    by_label = np.argsort(label, kind="stable")
    follows = np.full(n, -1)  # the next row of the same burst
    same = label[by_label][1:] == label[by_label][:-1]
    follows[by_label[:-1][same]] = by_label[1:][same]
    steady = np.r_[False, np.diff(t) <= t_burst]  # NaN: unsteady
    breaks = np.cumsum(np.r_[0, ~steady])
    last = np.zeros(n, np.int64)
    np.maximum.at(last, label, np.arange(n))
    resume = 0
    for before in np.flatnonzero((follows > np.arange(n) + 1) & (follows - np.arange(n) <= p.max_fill + 1)).tolist():
        after = int(follows[before])
        if before + 1 < resume:
            continue
        resume = after
        inside = label[before + 1 : after]
        whole = (inside > before).all() and (last[inside] < after).all()
        if whole and breaks[after + 1] == breaks[before + 1] and len(cameras := set(device[before : after + 1])) == 1 and None not in cameras:
            label[before + 1 : after] = label[before]


def bursts(items: DataFrame, p: GroupParams = GroupParams(), key: str = "session_id") -> DataFrame:
    """key, id, burst_id (the id of the burst's first row).

    items: key, id, t (ms or null), name, device, phash (long), embedding. Rows are ordered by (t, lower name, id), those
    without a time last; items is read several times. The order is dealt out in ranges of bounded length, however long a
    session is. A stretch between two places that no link crosses has the same bursts by itself, so a range settles all
    but its first and last stretch; those meet their continuation in the neighbouring ranges afterwards.
    """
    limits = None if p.t_burst_ms is not None else adaptive_t_burst(items, key)
    rows = items.withColumn("t_burst", F.lit(p.t_burst_ms).cast("long")) if limits is None else items.join(limits, key)
    rows = rows.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), "t", F.lower("name").alias("name"), "device", "phash", F.col("embedding").cast("array<float>").alias("embedding"), "t_burst")
    ranges = max(1, -(-items.select(key).count() // ROWS_A_RANGE))
    order = [F.col(key), F.col("t").asc_nulls_last(), F.col("name"), F.col("id")]
    kind = dict(rows.dtypes)
    wide = f"t {kind['t']}, device {kind['device']}, phash {kind['phash']}, embedding array<float>, t_burst long"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).drop_columns(["name"])
            batches.clear()
            yield from _settled(table, key, TaskContext.get().partitionId(), p)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches, ["chain", key]):
            yield from stretch.select([key, "id"]).append_column("burst_id", _named(stretch, p)).combine_chunks().to_batches()

    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = scratch.materialize(dealt.mapInArrow(settle, f"{key} long, id long, burst_id long, settled boolean, part int, at int, tail boolean, {wide}"), "bursts")
    # A range with a cut ends the stretch that came from before and begins the one that goes on.
    cut = {r.part for r in found.where("tail").select("part").distinct().collect()}
    before = list(accumulate((int(k in cut) for k in range(ranges)), initial=0))[:ranges]
    chains = F.broadcast(items.sparkSession.createDataFrame(list(enumerate(before)), "part int, before int"))
    rest = found.where("NOT settled").join(chains, "part").withColumn("chain", F.col("before") + F.col("tail").cast("int"))
    rest = rest.select("chain", key, "part", "at", "id", "t", "device", "phash", "embedding", "t_burst").repartition("chain", key).sortWithinPartitions("chain", key, "part", "at")
    return found.where("settled").select(key, "id", "burst_id").union(rest.mapInArrow(join, f"{key} long, id long, burst_id long"))


#: Rows of a range of the order, about.
ROWS_A_RANGE = 40_000


def _changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where one of the keys differs from the row before; null is a value."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        x = table.column(k)
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        known = pc.is_valid(x).to_numpy(zero_copy_only=False)
        v = pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
        out |= (v[1:] != v[:-1]) | (known[1:] != known[:-1])
    return (np.flatnonzero(out) + 1).tolist()


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *_changes(batch, keys), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> Columns:
    """The columns that segment() reads; vectors stay views of one array."""
    vectors = table.column("embedding").combine_chunks()
    ends, known = vectors.offsets.to_numpy(), pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    values = vectors.values.to_numpy(zero_copy_only=False)
    return {k: table.column(k).to_pylist() for k in ("t", "device", "phash")} | {"embedding": [values[a:b] if seen else None for a, b, seen in zip(ends, ends[1:], known)]}


def _named(rows: pa.Table, p: GroupParams) -> pa.Array:
    """Each row's burst, by the id of its first row; rows of one session in order."""
    number = np.array(segment(_columns(rows), rows.column("t_burst")[0].as_py(), p))
    _, first = np.unique(number, return_index=True)
    return rows.column("id").combine_chunks().take(pa.array(first[number]))


def _settled(table: pa.Table, key: str, part: int, p: GroupParams) -> Iterator[pa.RecordBatch]:
    """Rows of a range, named between its first and last cut; the others keep what they need to be named later."""
    n, back = table.num_rows, max(p.lookback, 1)
    starts = [0, *_changes(table, [key]), n]
    cuts = starts[1:-1]
    for a, b in dict.fromkeys([(starts[0], starts[1]), (starts[-2], starts[-1])]):
        piece = table.slice(a, b - a)
        linked = links(_columns(piece), piece.column("t_burst")[0].as_py(), p)[2]
        reach = np.arange(b - a) - np.where(linked.any(axis=1), linked.shape[1] - np.argmax(linked[:, ::-1], axis=1), 0)
        free = np.minimum.accumulate(reach[::-1])[::-1] >= np.arange(b - a)
        # Unknown: links of the first rows to the range before, and of the rows of the range after to the last ones.
        free[: back if a == 0 else 0] = False
        free[max(0, b - a - back + 1) if b == n else b - a :] = False
        cuts += (np.flatnonzero(free) + a).tolist()
    head, tail = (min(cuts), max(cuts)) if cuts else (n, n)
    names = [_named(table.slice(max(a, head), min(b, tail) - max(a, head)), p) for a, b in zip(starts, starts[1:]) if max(a, head) < min(b, tail)]
    at = np.arange(n)
    inside = pa.array((at >= head) & (at < tail))
    burst = pa.chunked_array([pa.nulls(head, pa.int64()), *names, pa.nulls(n - max(head, tail), pa.int64())], pa.int64())
    wide = {c: pc.if_else(inside, pa.scalar(None, table.schema.field(c).type), table.column(c).combine_chunks()) for c in ("t", "device", "phash", "t_burst")}
    vectors = table.column("embedding").combine_chunks()
    wide["embedding"] = pa.concat_arrays([vectors.slice(0, head), pa.nulls(max(0, tail - head), vectors.type), vectors.slice(tail)])
    out = {key: table.column(key), "id": table.column("id"), "burst_id": burst, "settled": inside, "part": pa.array(np.full(n, part, np.int32)), "at": pa.array(at.astype(np.int32)), "tail": pa.array(at >= tail)}
    made = pa.table(out | {c: wide[c] for c in ("t", "device", "phash", "embedding", "t_burst")})
    yield from made.combine_chunks().to_batches(max_chunksize=8192)


def _numbered(rows: DataFrame, cut: Column, order: Window, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(F.when(cut, 1).otherwise(0)).over(order))


def scenes(units: DataFrame, p: GroupParams = GroupParams(), key: str = "session_id") -> DataFrame:
    """units with scene_no: neighbouring bursts (by start, id) with a short gap and like content share a scene."""
    order = Window.partitionBy(key).orderBy("start_at", "id")
    gap = F.col("start_at") - F.lag("end_at").over(order)
    cos = exprs.cosine(F.lag("embedding").over(order), F.col("embedding"))
    bits = exprs.hamming(F.lag("phash").over(order), F.col("phash"))
    alike = F.when(cos.isNotNull(), cos >= p.scene_cos).when(bits.isNotNull(), 1.0 - bits / 64.0 >= p.scene_hash).otherwise(gap <= p.scene_near_ms)
    return _numbered(units, gap.isNotNull() & ~((gap <= p.scene_gap_ms) & alike), order, "scene_no")


def events(units: DataFrame, p: GroupParams = GroupParams(), key: str = "session_id") -> DataFrame:
    """units with event_no: a new event begins after a long gap to the latest end so far, or far from the last known place.

    units: key, id, start_at, end_at, first_lat, first_lon, last_lat, last_lon. Neither running value is reset at a cut.
    """
    order = Window.partitionBy(key).orderBy("start_at", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("start_at") - F.max("end_at").over(before) > p.event_gap_ms
    place = F.last(F.when(F.col("last_lat").isNotNull(), F.struct("last_lat", "last_lon")), ignorenulls=True).over(before)
    far = exprs.haversine_m(place["last_lat"], place["last_lon"], F.col("first_lat"), F.col("first_lon")) > p.event_distance_m
    return _numbered(units, F.coalesce(late, F.lit(False)) | F.coalesce(far, F.lit(False)), order, "event_no")


def first_last_fix(photos: DataFrame, key: str) -> DataFrame:
    """The first and the last valid fix per key in time order."""
    ok = exprs.valid_fix(F.col("gps_lat"), F.col("gps_lon"))
    at = F.when(ok, F.struct(F.coalesce("taken_at", "mtime").alias("t"), F.col("photo_id")))
    fix = F.struct("gps_lat", "gps_lon")
    got = photos.groupBy(key).agg(F.min_by(fix, at).alias("first"), F.max_by(fix, at).alias("last"))
    return got.select(key, F.col("first.gps_lat").alias("first_lat"), F.col("first.gps_lon").alias("first_lon"), F.col("last.gps_lat").alias("last_lat"), F.col("last.gps_lon").alias("last_lon"))


def stacks(photos: DataFrame, key: str = "session_id") -> DataFrame:
    """Display stacks: neighbours in time order with one burst collapse to the best of them (gaps and islands)."""
    order = Window.partitionBy(key).orderBy(F.coalesce("taken_at", "mtime"), "photo_id")
    group = F.coalesce("burst_id", -F.col("photo_id") - 1)
    marked = photos.withColumn("g", group).withColumn("new", F.when(F.lag(group).over(order).eqNullSafe(group), 0).otherwise(1)).withColumn("stack", F.sum("new").over(order))
    return marked.groupBy(key, "stack").agg(F.min_by("photo_id", F.struct("rank_in_burst", "photo_id")).alias("cover"), F.count("*").alias("n"))


def as_of(times: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """times with span_id: the last span of the key that starts at or before t, if t is within it.

    One sort of the union of both sides per key: no range join.
    """
    both = times.select(key, F.col("t"), F.col("id"), F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("long").alias("end_at"), F.lit(1).alias("side")).unionByName(spans.select(key, F.col("start_at").alias("t"), F.lit(None).cast("long").alias("id"), "span_id", "end_at", F.lit(0).alias("side")))
    order = Window.partitionBy(key).orderBy("t", "side", "span_id", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("span_id", "end_at")), ignorenulls=True).over(order)
    found = both.withColumn("last", last).where("side = 1")
    return found.select(key, "id", "t", F.when(F.col("t") <= F.col("last.end_at"), F.col("last.span_id")).alias("span_id"))


def even_thinning(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows per key, evenly spread in time order: rows floor(i * n / most)."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy("t", "id")) - 1).withColumn("n", F.count("*").over(w))
    # Row r is taken if some i has floor(i * n / most) = r.
    i = F.ceil(F.col("r") * most / F.col("n"))
    taken = (F.col("n") <= most) | ((i < most) & (F.floor(i * F.col("n") / most) == F.col("r")))
    return ranked.where(taken).drop("r", "n")
