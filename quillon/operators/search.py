"""Exact vector search with an adaptive cut-off, and face search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import exprs

CONFIDENT, ADAPTIVE_Z, ADAPTIVE_LEAST = 0.095, 2.0, 30
FACE_FLOOR, FACE_TOP = 0.25, 10


def ranked(rows: DataFrame, query: list[float], id_col: str, vector_col: str, min_score: float | None = None, limit: int | None = None, confident: float = CONFIDENT) -> DataFrame:
    """id, similarity, score and position of the hits, best first.

    Without min_score the cut-off is the mean plus two deviations of all cosines, `confident` at most, or `confident`
    with fewer than 30 vectors. Vectors of another length and zero vectors never match. The statistics are one row,
    joined by broadcast; figures are rounded after the order is settled.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = rows.where(F.size(vector_col) == len(query)).withColumn("n", exprs.norm(F.col(vector_col))).where("n >= 1e-12")
    cosines = usable.select(F.col(id_col), F.try_divide(exprs.dot(F.col(vector_col), q), F.greatest(exprs.norm(q), F.lit(1e-12)) * F.col("n")).alias("c"))
    if min_score is not None:
        hits = cosines.where(exprs.search_score(F.col("c")) >= min_score)
    else:
        stats = cosines.agg(F.when(F.count("*") < ADAPTIVE_LEAST, F.lit(confident)).otherwise(F.least(F.lit(confident), F.avg("c") + ADAPTIVE_Z * F.stddev_pop("c"))).alias("cut"))
        hits = cosines.join(F.broadcast(stats), F.col("c") >= F.col("cut"))
    out = hits.select(id_col, F.round("c", 4).alias("similarity"), F.round(exprs.search_score(F.col("c")), 4).alias("score"), "c").orderBy(F.desc("c"), id_col)
    return (out.limit(limit) if limit else out).drop("c")


def summary(rows: DataFrame, query: list[float], vector_col: str, confident: float = CONFIDENT) -> DataFrame:
    """searched, unindexed, low_confidence and the adaptive cut-off of a search."""
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = F.coalesce((F.size(vector_col) == len(query)) & (exprs.norm(F.col(vector_col)) >= 1e-12), F.lit(False))
    c = F.when(usable, F.try_divide(exprs.dot(F.col(vector_col), q), exprs.norm(q) * exprs.norm(F.col(vector_col))))
    got = rows.select(c.alias("c")).agg(F.count("c").alias("searched"), F.count_if(F.col("c").isNull()).alias("unindexed"), F.max("c").alias("best"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"))
    cut = F.when(F.col("searched") < ADAPTIVE_LEAST, F.lit(confident)).otherwise(F.least(F.lit(confident), F.col("mean") + ADAPTIVE_Z * F.col("sd")))
    return got.select("searched", "unindexed", ((F.col("searched") > 0) & (F.col("best") < confident)).alias("low_confidence"), F.round(cut, 4).alias("min_similarity"))


def nearest_centroids(centres: DataFrame, query: list[float], id_col: str, vector_col: str, floor: float = FACE_FLOOR, top: int = FACE_TOP) -> DataFrame:
    """The top rows at or above a floor, ordered by the rounded similarity and id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = F.round(exprs.cosine(F.col(vector_col), q), 4)
    return centres.select(id_col, sim.alias("similarity")).where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), id_col).limit(top)
