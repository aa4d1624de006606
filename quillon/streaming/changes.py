"""Change streams: coalesced events, retracting counters, debounced triggers, retraining.

The batch functions and the streams share their aggregations: a stream is the same plan over micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values.
TICK_MS, DEBOUNCE_MS, MAX_WAIT_MS = 100, 800, 3_000
RETRAIN_LABELS, RETRAIN_IDLE_LABELS, RETRAIN_IDLE_MS = 50, 10, 120_000


def coalesce_events(events: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    """Events of a tick merged by kind: tick, kind, key, n, payload, ids.

    events: seq, t (ms), kind, key, count, payload, id. `update` kinds keep the last payload of a key; `added` ones sum
    their counts; `ids` ones collect their ids in order of first arrival; `done` ones pass through, each by itself.
    """
    rows = events.withColumn("tick", F.floor(F.col("t") / tick_ms)).withColumn("one", F.when(F.col("kind") == "done", F.col("seq")))
    # An id counts where it arrives first in its tick.
    first = rows.groupBy("tick", "kind", "key", "one", "id").agg(F.min("seq").alias("at"), F.sum("count").alias("count"), F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("last"))
    out = first.groupBy("tick", "kind", "key", "one").agg(F.sum("count").alias("n"), F.max_by("payload", "last").alias("payload"), F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))), lambda x: x["id"]).alias("ids"), F.min("at").alias("first_seq"))
    return out.select("tick", "kind", "key", F.when(F.col("kind") == "added", F.col("n")).alias("n"), F.when(F.col("kind") != "ids", F.col("payload")).alias("payload"), F.when(F.col("kind") == "ids", F.col("ids")).alias("ids"), "first_seq")


def counter_deltas(changes: DataFrame) -> DataFrame:
    """session_id, photos, picked, rejected, rated: what change rows with old and new values add and take back.

    changes: session_id, old_flag, new_flag, old_rating, new_rating, old_member, new_member (whether the photo belonged
    to the session before and after).
    """

    def delta(test: Callable[[str], Column]) -> Column:
        side = lambda s: F.when(F.col(f"{s}_member") & F.coalesce(test(s), F.lit(False)), 1).otherwise(0)
        return F.sum(side("new") - side("old"))

    return changes.groupBy("session_id").agg(delta(lambda s: F.lit(True)).alias("photos"), delta(lambda s: F.col(f"{s}_flag") == 1).alias("picked"), delta(lambda s: F.col(f"{s}_flag") == -1).alias("rejected"), delta(lambda s: F.col(f"{s}_rating").isNotNull()).alias("rated"))


def stream_counters(changes: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running counters of a change stream, as a table in memory (complete mode)."""
    writer = counter_deltas(changes).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def stream_coalesced(events: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch coalesced and handed to a sink; the sink sees a batch again after a failure."""
    writer = events.writeStream.foreachBatch(lambda batch, _: sink(coalesce_events(batch)))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def debounce(signals: DataFrame, quiet_ms: int = DEBOUNCE_MS, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """root_id, fire_at, n: a trailing debounce of signals (root_id, t): fires once a root has been quiet, or has waited
    longest; the longest wait is counted from the first signal that is still pending.

    Plain gaps are cut by a window; within a run without gaps the wait opens the next firing greedily.
    """
    order = Window.partitionBy("root_id").orderBy("t")
    runs = signals.withColumn("new", F.when(F.col("t") - F.lag("t").over(order) < quiet_ms, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    held = runs.groupBy("root_id", "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # A firing is (first pending, last pending, signals); one that has waited max_wait_ms fires before the next signal.
    start = F.expr("named_struct('fired', cast(array() AS array<struct<fire_at: bigint, n: bigint>>), 'open', cast(null AS bigint), 'last', cast(null AS bigint), 'n', cast(0 AS bigint))")
    entry = lambda at, n: F.array(F.struct(at.alias("fire_at"), n.alias("n")))
    state = lambda fired, first, last, n: F.struct(fired.alias("fired"), first.alias("open"), last.alias("last"), n.alias("n"))
    step = lambda s, t: F.when(s["open"].isNull(), state(s["fired"], t, t, F.lit(1).cast("long"))).when(t - s["open"] >= max_wait_ms, state(F.concat(s["fired"], entry(s["open"] + max_wait_ms, s["n"])), t, t, F.lit(1).cast("long"))).otherwise(state(s["fired"], s["open"], t, s["n"] + 1))
    end = lambda s: F.concat(s["fired"], entry(F.least(s["last"] + quiet_ms, s["open"] + max_wait_ms), s["n"]))
    return held.select("root_id", F.inline(F.aggregate("ts", start, step, end)))


def retrain_times(labels: DataFrame, key_col: str | None = None) -> DataFrame:
    """t, pending: when a model is retrained by a stream of labels (t, one by one): at once with 50 new labels, or with 10
    once the user has paused for two minutes. With key_col (a long), that of each key by its own labels alone."""
    ts = F.array_sort(F.collect_list("t")).alias("ts")
    keyed = labels.select(F.col(key_col).cast("long").alias("key"), "t").groupBy("key") if key_col else labels.groupBy(F.lit(0).cast("long").alias("key"))
    # No label gives no row, with or without keys.
    ordered = keyed.agg(ts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, ts in zip(rows["key"].astype("Int64"), rows["ts"]):
                pending, last, out = 0, None, []
                for t in ts:
                    if last is not None and t - last >= RETRAIN_IDLE_MS and pending >= RETRAIN_IDLE_LABELS:
                        out.append((last + RETRAIN_IDLE_MS, pending))
                        pending = 0
                    pending, last = pending + 1, t
                    if pending >= RETRAIN_LABELS:
                        out.append((t, pending))
                        pending = 0
                if pending >= RETRAIN_IDLE_LABELS:
                    out.append((last + RETRAIN_IDLE_MS, pending))
                found = pd.DataFrame(out, columns=["t", "pending"]).astype("int64")
                found.insert(0, "key", pd.array([key] * len(out), dtype="Int64"))
                yield found

    fired = ordered.mapInPandas(run, "key long, t long, pending long")
    return fired.withColumnRenamed("key", key_col) if key_col else fired.drop("key")


def stream_retrain(labels: DataFrame) -> DataFrame:
    """The same rule as state per user with a processing-time timer: user_id, pending at each retraining.

    labels: a stream of user_id, t.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else 0
        fired = []
        if state.hasTimedOut:
            if pending >= RETRAIN_IDLE_LABELS:
                fired.append(pending)
            state.remove()
        else:
            pending += sum(len(b) for b in batches)
            while pending >= RETRAIN_LABELS:
                fired.append(RETRAIN_LABELS)
                pending -= RETRAIN_LABELS
            state.update((pending,))
            state.setTimeoutDuration(RETRAIN_IDLE_MS)
        yield pd.DataFrame({"user_id": [key[0]] * len(fired), "pending": fired}).astype("int64")

    return labels.groupBy("user_id").applyInPandasWithState(step, "user_id long, pending long", "pending long", "append", GroupStateTimeout.ProcessingTimeTimeout)
