"""The declarative photo query: conjunctive predicates, sort keys, keyset pages.

A query is validated once and becomes one DataFrame: plain predicates are one conjunction that reaches the scan, and
predicates on faces, tags and scenes are semi or anti joins whose own side is filtered first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs

# Fixed values.
EYES_OPEN_MIN, SMILE_MIN, GAZE_MIN, BLURRY_BELOW = 0.55, 0.5, 0.6, 0.35
FACE_SIMILARITY = 0.38
DEFAULT_LIMIT, MAX_LIMIT = 500, 5000
LAST, FIRST = 2**63 - 1, -(2**63 - 1)
COLORS = ("red", "yellow", "green", "blue", "purple")
FLAGS = {"picked": 1, "rejected": -1, "unflagged": 0}
#: Sort keys: (descending, text).
SORTS = {"taken_at": (False, False), "-taken_at": (True, False), "name": (False, True), "rating": (True, False), "ai": (True, False), "taste": (True, False)}
STATES = {"eyes_open": f"eyes_open >= {EYES_OPEN_MIN}", "smiling": f"smile >= {SMILE_MIN}", "looking": f"gaze >= {GAZE_MIN}", "subject": "is_subject = 1"}
SUBJECT = "is_subject = 1"


@dataclass(frozen=True)
class PhotoQuery:
    session_id: int | None = None
    rating_gte: int = 0
    flag: str = "any"
    color_label: str | None = None
    ai_rating_gte: float | None = None
    issues_none: bool = False
    issues_any: tuple[str, ...] = ()
    burst_best_only: bool = False
    burst_id: int | None = None
    scene_type: str | None = None
    persons: tuple[int, ...] = ()
    person_mode: str = "any"
    person_state: tuple[str, ...] = ()
    include_background: bool = False
    exclude_persons: tuple[int, ...] = ()
    has_edits: bool | None = None
    duplicates: bool | None = None
    event_id: int | None = None
    faces_min: int | None = None
    faces_max: int | None = None
    lenses: tuple[str, ...] = ()
    taken_from: int | None = None
    taken_to: int | None = None
    tags: tuple[str, ...] = ()
    tags_all: bool = False
    sharp: str | None = None
    only_ids: tuple[int, ...] | None = None
    face_vectors: tuple[tuple[float, ...], ...] = ()
    face_similarity: float = FACE_SIMILARITY
    devices: tuple[int, ...] = ()
    device_none: bool = False
    sort: str = "taken_at"
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None

    def __post_init__(self) -> None:
        problems = [
            (self.flag not in ("any", "not_rejected", *FLAGS), f"unknown flag: {self.flag}"),
            (self.color_label not in (None, *COLORS), f"unknown color label: {self.color_label}"),
            (any(i not in exprs.ISSUES for i in self.issues_any), f"unknown issue in {self.issues_any}"),
            (any(s not in STATES for s in self.person_state), f"unknown state in {self.person_state}"),
            (self.person_mode not in ("any", "all"), f"unknown person mode: {self.person_mode}"),
            (self.sharp not in (None, "sharp", "blurry", "unknown"), f"unknown sharpness: {self.sharp}"),
            (self.sort not in SORTS, f"unknown sort key: {self.sort}"),
            (None not in (self.taken_from, self.taken_to) and self.taken_from > self.taken_to, "taken_from is after taken_to"),
            (not 0 <= self.face_similarity <= 1, "face_similarity must be 0 to 1"),
        ]
        for wrong, said in problems:
            if wrong:
                raise ValueError(said)

    @property
    def page_size(self) -> int:
        return min(max(self.limit, 1), MAX_LIMIT)


@dataclass(frozen=True)
class Catalog:
    """The tables that a query may read; face needs `embedding` only for similar faces."""

    photo: DataFrame
    face: DataFrame | None = None
    photo_tag: DataFrame | None = None
    burst: DataFrame | None = None
    scene: DataFrame | None = None


@dataclass
class Page:
    rows: list = field(default_factory=list)
    total: int = 0
    next_cursor: str | None = None


def plain_predicates(q: PhotoQuery) -> list[Column]:
    """The predicates on the photo row alone."""
    c, mask = F.col, F.coalesce(F.col("issues"), F.lit(0))
    blurred = mask.bitwiseAND(F.lit(exprs.ISSUES["blurry"])) != 0
    sharp = {"sharp": (c("sharpness") >= BLURRY_BELOW) & ~blurred, "blurry": blurred | (c("sharpness") < BLURRY_BELOW), "unknown": c("sharpness").isNull() & ~blurred}
    device = [c("device_id").isin(*q.devices)] * bool(q.devices) + [c("device_id").isNull()] * q.device_none
    wanted = [
        (q.session_id is not None, lambda: c("session_id") == q.session_id),
        (q.rating_gte > 0, lambda: c("user_rating") >= q.rating_gte),
        (q.flag in FLAGS, lambda: c("flag") == FLAGS[q.flag]),
        (q.flag == "not_rejected", lambda: c("flag") >= 0),
        (q.color_label is not None, lambda: c("color_label") == q.color_label),
        (q.ai_rating_gte is not None, lambda: c("ai_rating") >= q.ai_rating_gte),
        (q.issues_none, lambda: (c("analysis_version") > 0) & (mask == 0)),
        (bool(q.issues_any), lambda: mask.bitwiseAND(F.lit(exprs.issue_mask(*q.issues_any))) != 0),
        (q.burst_best_only, lambda: c("burst_id").isNull() | (c("rank_in_burst") == 0)),
        (q.burst_id is not None, lambda: c("burst_id") == q.burst_id),
        (q.scene_type is not None, lambda: c("scene_type") == q.scene_type),
        (q.has_edits is not None, lambda: F.coalesce(c("has_edits"), F.lit(0)) == int(q.has_edits)),
        (q.duplicates is not None, lambda: c("dup_group_id").isNotNull() == q.duplicates),
        (bool(q.lenses), lambda: c("lens").isin(*q.lenses)),
        (q.taken_from is not None, lambda: c("taken_at") >= q.taken_from),
        (q.taken_to is not None, lambda: c("taken_at") <= q.taken_to),
        (q.sharp is not None, lambda: sharp[q.sharp]),
        (bool(device), lambda: reduce(Column.__or__, device)),
        (q.faces_min is not None, lambda: c("subject_face_count") >= q.faces_min),
        (q.faces_max is not None, lambda: c("subject_face_count") <= q.faces_max),
    ]
    return [make() for active, make in wanted if active]


def _holding(rows: DataFrame, key: str, wanted: tuple, all_of: bool) -> DataFrame:
    """photo_ids with any, or with all, of the wanted values of key (relational division)."""
    rows = rows.where(F.col(key).isin(*wanted))
    if not all_of:
        return rows.select("photo_id")
    return rows.groupBy("photo_id").agg(F.countDistinct(key).alias("n")).where(F.col("n") == len(set(wanted))).select("photo_id")


def filtered(cat: Catalog, q: PhotoQuery) -> DataFrame:
    """All photos that the query selects, without order or limit."""
    out = cat.photo
    if q.faces_min is not None or q.faces_max is not None:
        if "subject_face_count" not in out.columns:
            counts = cat.face.groupBy("photo_id").agg(F.sum("is_subject").alias("subject_face_count"))
            out = out.join(counts, "photo_id", "left")
    for p in plain_predicates(q):
        out = out.where(p)
    states = [STATES[s] for s in q.person_state]
    if not q.include_background and "subject" not in q.person_state:
        states.append(SUBJECT)
    if q.persons or q.person_state:
        faces = reduce(DataFrame.where, states, cat.face)
        faces = _holding(faces, "person_id", tuple(set(q.persons)), q.person_mode == "all") if q.persons else faces.select("photo_id")
        out = out.join(faces, "photo_id", "left_semi")
    if q.exclude_persons:
        faces = cat.face.where(F.col("person_id").isin(*q.exclude_persons))
        out = out.join(faces if q.include_background else faces.where(SUBJECT), "photo_id", "left_anti")
    if q.event_id is not None:
        scenes = cat.scene.where(F.col("event_id") == q.event_id).select("scene_id")
        out = out.join(cat.burst.join(scenes, "scene_id", "left_semi"), "burst_id", "left_semi")
    tags = tuple(dict.fromkeys(t.strip()[:100] for t in q.tags if t.strip()))
    if tags:
        out = out.join(_holding(cat.photo_tag, "tag", tags, q.tags_all), "photo_id", "left_semi")
    if q.only_ids is not None:
        ids = out.sparkSession.createDataFrame([(i,) for i in q.only_ids], "photo_id long")
        out = out.join(ids, "photo_id", "left_semi")
    if q.face_vectors:
        close = [exprs.cosine(F.col("embedding"), F.array(*map(F.lit, v))) >= q.face_similarity for v in q.face_vectors]
        out = out.join(cat.face.where("embedding IS NOT NULL").where(reduce(Column.__or__, close)), "photo_id", "left_semi")
    return out


def sort_key(sort: str) -> Column:
    """The key of a sort order, with the sentinel of each for what is missing; scores are cut to whole millionths."""
    millionths = lambda name: (F.coalesce(F.col(name), F.lit(-0.001)) * 1_000_000).cast("long")
    return {
        "taken_at": lambda: F.coalesce(F.col("taken_at"), F.lit(LAST)),
        "-taken_at": lambda: F.coalesce(F.col("taken_at"), F.lit(FIRST)),
        "name": lambda: exprs.ascii_lower(F.col("file_name")),
        "rating": lambda: F.coalesce(F.col("user_rating"), F.lit(-1)).cast("long"),
        "ai": lambda: millionths("ai_score"),
        "taste": lambda: millionths("taste_score"),
    }[sort]()


def ordering(sort: str) -> list[Column]:
    """Key, then photo id, ascending in either direction of the key."""
    key = sort_key(sort)
    return [key.desc() if SORTS[sort][0] else key.asc(), F.col("photo_id").asc()]


def encode_cursor(key: int | str, photo_id: int) -> str:
    return json.dumps({"k": key, "id": photo_id}, separators=(",", ":")).encode().hex()


def decode_cursor(cursor: str, sort: str) -> tuple[int | str, int]:
    try:
        held = json.loads(bytes.fromhex(cursor))
        key, photo_id = held["k"], held["id"]
    except (ValueError, KeyError, TypeError):
        raise ValueError("invalid cursor") from None
    if isinstance(key, bool) or not isinstance(key, str if SORTS[sort][1] else int) or not isinstance(photo_id, int):
        raise ValueError("invalid cursor")
    return key, photo_id


def page_rows(cat: Catalog, q: PhotoQuery) -> DataFrame:
    """The page and one row more: sorted on key and id alone, so wide rows are read only for the page."""
    rows, key = filtered(cat, q), sort_key(q.sort)
    if q.cursor:
        k, last = decode_cursor(q.cursor, q.sort)
        k = exprs.ascii_lower(F.lit(k)) if SORTS[q.sort][1] else F.lit(k)
        beyond = key < k if SORTS[q.sort][0] else key > k
        rows = rows.where(beyond | ((key == k) & (F.col("photo_id") > last)))
    return rows.withColumn("sort_key", key).orderBy(*ordering(q.sort)).limit(q.page_size + 1)


def page(cat: Catalog, q: PhotoQuery) -> Page:
    """One page with its total and the cursor of the next; the total is counted only where the page doesn't show it."""
    rows = page_rows(cat, q).collect()
    more = len(rows) > q.page_size
    rows = rows[: q.page_size]
    whole = not more and not q.cursor
    total = len(rows) if whole else filtered(cat, replace(q, cursor=None)).count()
    return Page(rows, total, encode_cursor(rows[-1].sort_key, rows[-1].photo_id) if more else None)


def multi_get(photos: DataFrame, ids: list[int]) -> DataFrame:
    """Photos in the order of ids; missing ones are skipped, repeated ones come once."""
    asked = photos.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos long, photo_id long")
    return photos.join(asked, "photo_id").orderBy("pos")


def with_companions(photos: DataFrame) -> DataFrame:
    """Primaries with their companions nested, by id."""
    held = photos.where("pair_id IS NOT NULL").groupBy(F.col("pair_id").alias("photo_id")).agg(F.array_sort(F.collect_list("photo_id")).alias("companions"))
    return photos.where("pair_id IS NULL").join(held, "photo_id", "left").withColumn("companions", F.coalesce("companions", F.array().cast("array<long>")))


def sharp_state(sharpness: Column, issues: Column) -> Column:
    """sharp, blurry or unknown: the three states part all photos."""
    blurred = F.coalesce(issues, F.lit(0)).bitwiseAND(F.lit(exprs.ISSUES["blurry"])) != 0
    return F.when(blurred | F.coalesce(sharpness < BLURRY_BELOW, F.lit(False)), "blurry").when(sharpness.isNull(), "unknown").otherwise("sharp")


#: Saved queries that every catalog has.
COLLECTIONS = {
    "best_per_group": PhotoQuery(burst_best_only=True),
    "has_closed_eyes": PhotoQuery(issues_any=("closed_eyes",)),
    "undecided": PhotoQuery(flag="unflagged"),
    "edited": PhotoQuery(has_edits=True),
    "duplicates": PhotoQuery(duplicates=True),
}
