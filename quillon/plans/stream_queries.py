"""Change streams as batch queries; tests run the streams themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import register
from quillon.sources.views import oracle_views, view
from quillon.streaming import changes


@register("coalesced_events", f"""{oracle_views('item')}, e AS (SELECT event_id AS seq, floor(t / 60000.0)::BIGINT AS tick, CASE event_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'added' ELSE 'done' END AS kind, user_id % 3 AS key, event_id % 7 AS n FROM item)
 SELECT tick, kind, key, CASE WHEN kind = 'added' THEN sum(n)::BIGINT END AS n, arg_max(seq, seq)::VARCHAR AS payload FROM e GROUP BY tick, kind, key, CASE WHEN kind = 'done' THEN seq END""")
def coalesced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "item").selectExpr("event_id AS seq", "t", "CASE event_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'added' ELSE 'done' END AS kind", "user_id % 3 AS key", "event_id % 7 AS count", "string(event_id) AS payload", "cast(NULL AS bigint) AS id")
    return changes.coalesce_events(e, 60_000).select("tick", "kind", "key", "n", "payload")


@register("counter_deltas", f"{oracle_views('item')}, c AS (SELECT user_id AS session_id, event_id % 3 - 1 AS of, event_id // 3 % 3 - 1 AS nf, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 3 END AS o, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 4 END AS nr, event_id % 6 <> 0 AS om, event_id % 8 <> 0 AS nm FROM item) SELECT session_id, (count(*) FILTER (nm) - count(*) FILTER (om))::BIGINT AS photos, (count(*) FILTER (nm AND nf = 1) - count(*) FILTER (om AND of = 1))::BIGINT AS picked, (count(*) FILTER (nm AND nf = -1) - count(*) FILTER (om AND of = -1))::BIGINT AS rejected, (count(nr) FILTER (nm) - count(o) FILTER (om))::BIGINT AS rated FROM c GROUP BY 1")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "item").selectExpr("user_id AS session_id", "event_id % 3 - 1 AS old_flag", "event_id DIV 3 % 3 - 1 AS new_flag", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 3 END AS old_rating", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 4 END AS new_rating", "event_id % 6 <> 0 AS old_member", "event_id % 8 <> 0 AS new_member")
    return changes.counter_deltas(c)


@register("debounced", f"{oracle_views('item')}, d AS (SELECT user_id % 4 AS root_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id % 4 ORDER BY t) < 800000 THEN 0 ELSE 1 END AS new FROM item), r AS (SELECT *, sum(new) OVER (PARTITION BY root_id ORDER BY t) AS run FROM d) SELECT root_id, max(t) + 800000 AS fire_at, count(*)::BIGINT AS n FROM r GROUP BY root_id, run")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a longest wait the firings are the ends of gap-free runs; tests cover the wait."""
    return changes.debounce(view(spark, sf_dir, "item").select((F.col("user_id") % 4).alias("root_id"), "t"), 800_000, 10**15)


@register("retrain_times")
def retrain_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retraining by each person's labels: a sequence a person, all events."""
    return changes.retrain_times(view(spark, sf_dir, "item").select("user_id", "t"), "user_id")
