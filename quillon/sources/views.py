"""A media catalog seen through the driver's star-schema tables.

Each view is a list of (column, SQL expression) over one table, in the dialect that Spark and the oracle share, apart
from {ms}, the epoch milliseconds of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PHOTO = {
    "photo_id": "o_orderkey",
    "session_id": "o_custkey",
    "taken_at": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {ms:o_orderdate} + (o_orderkey * 7919) % 86400 * 1000 END",
    "offset_min": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 480 ELSE -300 END",
    "mtime": "{ms:o_orderdate} + o_orderkey % 50000 * 1000",
    "file_name": "CASE o_orderkey % 3 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'img_' ELSE 'Dsc' END || lpad(CAST(o_orderkey % 500 AS STRING), 4, '0') || CASE o_orderkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.nef' WHEN 2 THEN '.heic' ELSE '.jpg' END",
    "user_rating": "CASE WHEN o_orderkey % 29 = 0 THEN 5 ELSE nullif(CAST(substr(o_orderpriority, 1, 1) AS INT), 5) END",
    "flag": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END",
    "color_label": "CASE o_orderkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' ELSE NULL END",
    "ai_score": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 500000.0 END",
    "ai_rating": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 50000.0) / 2.0 END",
    "taste_score": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderkey * 31 % 1000) / 1000.0 END",
    "issues": "CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 13 = 1 THEN NULL ELSE o_orderkey % 256 END",
    "analysis_version": "CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END",
    "burst_id": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey * 10 + o_orderkey % 3 END",
    "rank_in_burst": "o_orderkey % 4",
    "scene_type": "CASE o_orderkey % 5 WHEN 0 THEN 'portrait' WHEN 1 THEN 'group' WHEN 2 THEN 'landscape' WHEN 3 THEN 'night' ELSE NULL END",
    "device_id": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 6 END",
    "lens": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Lens ' || CAST(o_orderkey % 8 AS STRING) || 'mm' END",
    "has_edits": "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 < 3 THEN 1 ELSE 0 END",
    "dup_group_id": "CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey - o_orderkey % 100 ELSE NULL END",
    "missing": "CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END",
    "meta_done": "CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE 1 END",
    "pair_id": "CASE WHEN o_orderkey % 12 = 5 THEN o_orderkey - 1 ELSE NULL END",
    "sharpness": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 37 % 1000) / 1000.0 END",
    "width": "4000 + o_orderkey % 3 * 1000",
    "height": "3000 + o_orderkey % 2 * 10",
    "gps_lat": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 41 = 1 THEN 0.0 ELSE 40.0 + (o_orderkey * 13 % 1000) / 5000.0 END",
    "gps_lon": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 41 = 1 THEN 0.0 ELSE 10.0 + (o_orderkey * 17 % 1000) / 5000.0 END",
}
_FACE = {
    "photo_id": "l_orderkey",
    "person_id": "nullif(l_suppkey % 40, 0)",
    "eyes_open": "l_discount * 10.0",
    "smile": "l_tax * 12.5",
    "gaze": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 50.0 END",
    "yaw": "(l_partkey % 90) - 45.0",
    "pitch": "CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_partkey % 60) - 30.0 END",
    "sharpness": "CASE WHEN l_linenumber = 5 THEN NULL ELSE (l_partkey * 7 % 100) / 100.0 END",
    "is_subject": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "artificial": "CASE WHEN l_partkey % 25 = 0 THEN 0.7 ELSE 0.1 END",
    "nonhuman": "CASE WHEN l_suppkey % 40 = 7 THEN 1 ELSE 0 END",
    "mouth_open": "CASE WHEN l_linenumber = 4 THEN NULL ELSE (l_partkey % 20) / 100.0 END",
    "x": "(l_partkey % 70) / 100.0",
    "y": "(l_suppkey * 3 % 70) / 100.0",
    "w": "0.02 + (l_linenumber % 5) / 25.0",
    "h": "0.03 + (l_linenumber % 4) / 20.0",
    "vec_id": "l_partkey % 500",
    "track_id": "l_suppkey % 8",
    "part_key": "l_partkey",
    "line": "l_linenumber",
    "supplier": "l_suppkey",
    "price": "l_extendedprice",
}
_TAG = {"photo_id": "l_orderkey", "tag": "'tag' || CAST(l_partkey % 12 AS STRING)"}
_BURST = {"burst_id": "c_custkey * 10 + k", "scene_id": "c_custkey * 10 + k - k % 2", "session_id": "c_custkey"}
_SCENE = {"scene_id": "c_custkey * 10 + k", "event_id": "c_custkey % 50 * 10 + k", "session_id": "c_custkey"}
_ITEM = {"event_id": "event_id", "user_id": "user_id", "t": "{ms:ts}", "kind": "event_type", "value": "value"}

_FROM = {
    "photo": ("orders", _PHOTO, ""),
    "face": ("lineitem", _FACE, ""),
    "photo_tag": ("lineitem", _TAG, ""),
    "burst": ("customer", _BURST, " CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) b"),
    "scene": ("customer", _SCENE, " CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 2) s"),
    "item": ("events", _ITEM, ""),
}


def _expand(expression: str, ms: str) -> str:
    while "{ms:" in expression:
        head, _, rest = expression.partition("{ms:")
        column, _, tail = rest.partition("}")
        expression = head + ms.format(column) + tail
    return expression


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, _ = _FROM[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "burst":
        rows = rows.selectExpr("c_custkey", "explode(array(0, 1, 2)) AS k")
    if name == "scene":
        rows = rows.selectExpr("c_custkey", "explode(array(0, 2)) AS k")
    return rows.selectExpr(*[f"{_expand(e, 'unix_millis(cast({} AS timestamp))')} AS {c}" for c, e in columns.items()])


def oracle_views(*names: str) -> str:
    """The same views as common table expressions of the oracle."""
    parts = []
    for name in names:
        table, columns, joined = _FROM[name]
        listed = ", ".join(f"{_expand(e, '(epoch_us({}) // 1000)')} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {listed} FROM {table}{joined})")
    return "WITH " + ", ".join(parts)
