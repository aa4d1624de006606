"""Column expressions: vectors, hashes, geography, days, names and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAY_MS = 86_400_000
EARTH_RADIUS_M = 6_371_008.8
#: Issue bits of a photo.
ISSUES = {"closed_eyes": 1, "blurry": 2, "overexposed": 4, "underexposed": 8, "tilted": 16, "bystander": 32, "noisy": 64, "bad_expression": 128}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Logistic score of a text-to-image cosine.
SCORE_SCALE, SCORE_BIAS = 112.67, 16.5


def ascii_lower(text: Column) -> Column:
    """Folds A-Z alone, as a case-insensitive byte collation does."""
    return F.translate(text, UPPER, LOWER)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    """Sum of products in order; kind "float" keeps single precision throughout."""
    return F.aggregate(F.zip_with(a.cast(f"array<{kind}>"), b.cast(f"array<{kind}>"), lambda x, y: x * y), F.lit(0).cast(kind), lambda s, x: s + x)


def norm(a: Column, kind: str = "double") -> Column:
    return F.sqrt(dot(a, a, kind))


def cosine(a: Column, b: Column, kind: str = "double") -> Column:
    """0 where either vector is zero; null where the lengths differ."""
    size = norm(a, kind) * norm(b, kind)
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(size < 1e-12, F.lit(0.0)).otherwise(F.try_divide(dot(a, b, kind), size))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def visual_similarity(cos: Column, bits: Column, weight: float = 0.6) -> Column:
    """The weighted mean of cosine and hash agreement, whichever exists alone, or 0."""
    alike = 1.0 - bits / 64.0
    return F.when(cos.isNotNull() & bits.isNotNull(), weight * cos + (1 - weight) * alike).otherwise(F.coalesce(cos, alike, F.lit(0.0)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would skip a null: an unknown place is no distance away, not half the globe.
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


def valid_fix(lat: Column, lon: Column) -> Column:
    """(0, 0) and places off the globe aren't fixes."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def local_day(taken_at: Column, offset_min: Column) -> Column:
    """Days since the epoch of a capture time in its own zone, rounded down."""
    local = taken_at + F.coalesce(offset_min, F.lit(0)) * 60_000
    return ((local - F.pmod(local, F.lit(DAY_MS))) / DAY_MS).cast("long")


def bucket_first(day: Column, granularity: str) -> Column:
    date = F.date_from_unix_date(day.cast("int"))
    return date if granularity == "day" else F.trunc(date, granularity).cast("date")


def bucket_last(first: Column, granularity: str) -> Column:
    if granularity == "day":
        return first
    return F.last_day(first if granularity == "month" else F.add_months(first, 11))


def bucket_key(first: Column, granularity: str) -> Column:
    return F.date_format(first, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[granularity])


def issue_mask(*names: str) -> int:
    return sum(ISSUES[n] for n in set(names))


def issue_names(mask: Column) -> Column:
    """The issues of a mask in the order of their bits."""
    named = F.array(*[F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in ISSUES.items()])
    return F.filter(named, lambda x: x.isNotNull())


def base_stars(q: Column) -> Column:
    out = F.when(q < 0.20, 0.0)
    for stars, below in ((1.0, 0.35), (2.0, 0.50), (3.0, 0.65), (4.0, 0.80)):
        out = out.when(q < below, stars)
    return out.otherwise(5.0)


def star_rating(q: Column, group_best: Column, hard_issue: Column) -> Column:
    """Half a star more for the best of a group, two at most with a hard issue."""
    stars = F.when(group_best, F.least(base_stars(q) + 0.5, F.lit(5.0))).otherwise(base_stars(q))
    return F.when(hard_issue, F.least(stars, F.lit(2.0))).otherwise(stars)


def search_score(cos: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(SCORE_SCALE * cos - SCORE_BIAS)))


def clean_query(text: Column) -> Column:
    """Trimmed, white space collapsed; null if empty or over 256 characters."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((clean != "") & (F.length(clean) <= 256), clean)


def normal_tags(tags: Column) -> Column:
    """Control characters dropped, trimmed, at most 100 characters, in order without repeats."""
    clean = F.transform(tags, lambda t: F.substring(F.trim(F.regexp_replace(t, r"[\p{Cntrl}]", "")), 1, 100))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def stem_key(file_name: Column) -> Column:
    """Lower-cased name without its extension: what companions share."""
    return F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def multiset_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the characters of two strings, repeats counted."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    x, y = chars(a), chars(b)
    count = lambda xs, c: F.size(F.filter(xs, lambda v: v == c))
    shared = F.aggregate(F.transform(F.array_distinct(x), lambda c: F.least(count(x, c), count(y, c))), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(x) + F.size(y) > 0, 2.0 * shared / (F.size(x) + F.size(y))).otherwise(0.0)


def event_name(start_at: Column, end_at: Column, offset_min: Column) -> Column:
    """Local date and time span of an event."""
    shift = F.coalesce(offset_min, F.lit(0)) * 60_000
    s = F.timestamp_millis(start_at + shift)
    e = F.timestamp_millis(F.greatest(end_at, start_at) + shift)
    day, clock, short = "yyyy-MM-dd", "HH:mm", "MM-dd HH:mm"
    head = F.date_format(s, f"{day} {clock}")
    same_day = F.date_format(s, day) == F.date_format(e, day)
    same_minute = F.date_format(s, clock) == F.date_format(e, clock)
    tail = F.when(same_day, F.date_format(e, clock)).when(F.year(s) == F.year(e), F.date_format(e, short)).otherwise(F.date_format(e, f"{day} {clock}"))
    return F.when(same_day & same_minute, head).otherwise(F.concat_ws("-", head, tail))
