"""Exact and near duplicates of media files, and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs
from quillon.operators.graph import connected_components

MAX_BITS, ASPECT_TOLERANCE = 4, 0.01


def exact_groups(items: DataFrame) -> DataFrame:
    """id, group_id of items that share content key and size with another; null keys and sizes group with nothing."""
    known = items.where("content_key IS NOT NULL AND file_size IS NOT NULL")
    groups = known.groupBy("content_key", "file_size").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return known.join(groups, ["content_key", "file_size"]).select("id", "group_id")


def same_aspect(a: str, b: str) -> Column:
    """Aspect ratios within one percent, by cross products; false for unknown or empty sizes."""
    x, y = F.col(a + "width") * F.col(b + "height"), F.col(a + "height") * F.col(b + "width")
    known = (F.col(a + "width") > 0) & (F.col(a + "height") > 0) & (F.col(b + "width") > 0) & (F.col(b + "height") > 0)
    return F.coalesce(known & (F.abs(x - y) <= ASPECT_TOLERANCE * F.greatest(x, y)), F.lit(False))


def hash_chunks(column: str, max_bits: int = MAX_BITS, bits: int = 64) -> Column:
    """(chunk, value) pairs: hashes within max_bits bits agree on one at least."""
    n = max_bits + 1
    cuts = [bits * i // n for i in range(n + 1)]
    parts = [F.struct(F.lit(i).alias("chunk"), F.shiftrightunsigned(F.col(column), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    return F.array(*parts)


def near_pairs(items: DataFrame, max_bits: int = MAX_BITS, probes_only: bool = True) -> DataFrame:
    """a, b (ids, a < b): hashes within max_bits, like aspects and, with probes_only, one without a capture time.

    Equal hashes are joined as representatives first; a pair that shares several chunks is compared in the first of
    them alone, so no distinct is needed.
    """
    rows = items.where("phash IS NOT NULL").select("id", "phash", "width", "height", "has_time")
    keyed = rows.select("*", F.inline(hash_chunks("phash", max_bits)))
    a = keyed.select(*[F.col(c).alias("a_" + c) for c in rows.columns], "chunk", "value")
    b = keyed.select(*[F.col(c).alias("b_" + c) for c in rows.columns], "chunk", "value")
    if probes_only:
        a = a.where("NOT a_has_time")
    ordered = (F.col("a_id") != F.col("b_id")) & ((F.col("a_id") < F.col("b_id")) | (F.col("b_has_time") if probes_only else F.lit(False)))
    met = a.join(b, ["chunk", "value"]).where(ordered)
    first = F.array_min(F.filter(F.zip_with(hash_chunks("a_phash", max_bits), hash_chunks("b_phash", max_bits), lambda x, y: F.when(x["value"] == y["value"], x["chunk"])), lambda c: c.isNotNull()))
    close = met.where(exprs.hamming(F.col("a_phash"), F.col("b_phash")) <= max_bits).where(same_aspect("a_", "b_")).where(F.col("chunk") == first)
    return close.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def duplicate_groups(items: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """id, group_id (smallest id of the group), kind (exact where an equal file exists, else near)."""
    exact = exact_groups(items)
    edges = exact.where("id <> group_id").select(F.col("id").alias("a"), F.col("group_id").alias("b")).unionByName(near_pairs(items, max_bits))
    kinds = exact.select("id", F.lit("exact").alias("kind"))
    member = connected_components(edges).withColumnsRenamed({"node": "id", "root": "group_id"})
    every = member.unionByName(member.select(F.col("group_id").alias("id"), "group_id").distinct())
    return every.join(kinds, "id", "left").select("id", "group_id", F.coalesce("kind", F.lit("near")).alias("kind"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose group or kind changed: id with the new values, null where it has none any more."""
    o = old.select("id", F.col("group_id").alias("o_group"), F.col("kind").alias("o_kind"))
    both = o.join(new, "id", "full")
    return both.where(~(F.col("o_group").eqNullSafe(F.col("group_id")) & F.col("o_kind").eqNullSafe(F.col("kind")))).select("id", "group_id", "kind")
