"""A learned preference model: labels, features, folds, logistic regression, gate, explanation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
FOLDS, NEWTON_STEPS = 5, 30
STRENGTHS = (0.3, 0.03, 0.003)
LEAST_PER_CLASS, LEAST_AUC, LEAST_MARGIN, MARGIN_SCALE = 30, 0.6, 0.02, 0.3
MOST_EVALUATED, MOST_FITTED = 4_000, 20_000
EXPLAIN_LEAST, EXPLAIN_TOP = 0.05, 3
ALPHA_MAX, ALPHA_FULL_AT = 0.6, 200


def latest_labels(labels: DataFrame) -> DataFrame:
    """The last user-made label per photo and kind."""
    w = Window.partitionBy("photo_id", "kind").orderBy(F.desc("made_at"), F.desc("label_id"))
    return labels.where("source = 'user'").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def classes(labels: DataFrame) -> DataFrame:
    """photo_id, positive: a flag decides before a rating; 4 stars or more are positive, 2 or fewer negative, 3 nothing."""
    flag = F.max(F.when((F.col("kind") == "flag") & (F.col("value") != 0), F.col("value")))
    rating = F.max(F.when(F.col("kind") == "rating", F.col("value")))
    got = latest_labels(labels).groupBy("photo_id").agg(flag.alias("f"), rating.alias("r"))
    positive = F.when(F.col("f").isNotNull(), F.col("f") > 0).when(F.col("r") >= 4, True).when(F.col("r") <= 2, False)
    return got.select("photo_id", positive.alias("positive")).where("positive IS NOT NULL")


def hash_order(column: Column) -> Column:
    """A number of 0 to 2**32 from a hash of the column's text; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def fold_of(photo_id: Column, burst_id: Column, dup_group_id: Column) -> Column:
    """Photos of one burst, else of one duplicate group, fall in one fold."""
    name = F.coalesce(F.concat(F.lit("burst "), burst_id.cast("string")), F.concat(F.lit("copies "), dup_group_id.cast("string")), F.concat(F.lit("photo "), photo_id.cast("string")))
    return (hash_order(name) % FOLDS).cast("int")


def folds(photos: DataFrame) -> DataFrame:
    """photo_id, fold. photos: photo_id, burst_id, dup_group_id."""
    return photos.select("photo_id", fold_of(F.col("photo_id"), F.col("burst_id"), F.col("dup_group_id")).alias("fold"))


def stratified(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of a key, which classes share evenly unless one has fewer; rows in hash order.

    rows: key, photo_id, positive.
    """
    w = Window.partitionBy(key, "positive")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(hash_order(F.col("photo_id")), "photo_id")))
    sizes = rows.groupBy(key).agg(F.count_if("positive").alias("yes"), F.count_if(~F.col("positive")).alias("no"))
    half = most // 2
    room = F.when(F.col("positive"), F.greatest(F.lit(half), most - F.col("no"))).otherwise(F.greatest(F.lit(most - half), most - F.col("yes")))
    return ranked.join(sizes, key).where(F.col("r") <= room).drop("r", "yes", "no")


def column_stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of columns without their missing values; 0 and 1 where there are none."""
    known = ~np.isnan(x)
    n = known.sum(0)
    mean = np.where(n > 0, np.where(known, x, 0).sum(0) / np.maximum(n, 1), 0.0)
    var = np.where(known, (x - mean) ** 2, 0).sum(0) / np.maximum(n, 1)
    sd = np.sqrt(var)
    return mean, np.where((n == 0) | (sd < 1e-4), 1.0, sd)


def design(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised rows, the missing at the mean, with a constant column."""
    return np.c_[(np.where(np.isnan(x), mean, x) - mean) / sd, np.ones(len(x))]


def fit(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """Class-balanced logistic regression with an L2 penalty on all but the bias (the last column), by Newton steps that
    are halved until the loss falls."""
    n, d = x.shape
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    ridge = np.append(np.full(d - 1, strength), 0.0)
    sign = np.where(y, 1.0, -1.0)

    def loss(w: np.ndarray) -> float:
        return float(share @ np.logaddexp(0, -sign * (x @ w)) + 0.5 * ridge @ w**2)

    w, now = np.zeros(d), math.inf
    for _ in range(NEWTON_STEPS):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (share * (chance - y)) + ridge * w
        bend = (x * (share * chance * (1 - chance))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if now - (now := loss(w)) < 1e-10:
            break
    return w


def auc(scores: np.ndarray, y: np.ndarray) -> float | None:
    pos, neg = int(y.sum()), int((~y).sum())
    if not pos or not neg:
        return None
    ranks = pd.Series(scores).rank().to_numpy()
    return float((ranks[y].sum() - pos * (pos + 1) / 2) / (pos * neg))


@dataclass
class Outcome:
    used: bool = False
    auc: float = 0.5
    base_auc: float = 0.5
    margin: float = 0.0
    strength: float = 0.0
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    sd: list[float] = field(default_factory=list)


def cross_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray, strength: float) -> np.ndarray:
    """Each row's score from the model of all other folds."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        inside = fold != f
        if inside.any():
            stats = column_stats(x[inside])
            out[~inside] = design(x[~inside], *stats) @ fit(design(x[inside], *stats), y[inside], strength)
    return out


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, base: np.ndarray, evaluated: np.ndarray | None = None) -> Outcome:
    """Grouped cross-validation of the strengths on the evaluated rows, the gate against the generic score, and the fit.

    The model is used only if its AUC is 0.6 at least and betters the generic score's by a margin that grows as the
    smaller class shrinks. Labels are a person's decisions, capped by the caller: one task in memory.
    """
    rarer = lambda v: min(int(v.sum()), int((~v).sum()))
    if rarer(y) < LEAST_PER_CLASS:
        return Outcome()
    e = np.ones(len(y), bool) if evaluated is None else evaluated
    tried = {s: auc(cross_scores(x[e], y[e], fold[e], s), y[e]) or 0.5 for s in STRENGTHS}
    strength = max(STRENGTHS, key=tried.get)
    scored = e & ~np.isnan(base)
    out = Outcome(auc=tried[strength], base_auc=auc(base[scored], y[scored]) or 0.5, strength=strength)
    out.margin = max(LEAST_MARGIN, MARGIN_SCALE / math.sqrt(max(1, rarer(y[e]))))
    out.used = out.auc >= max(LEAST_AUC, out.base_auc + out.margin)
    if out.used:
        mean, sd = column_stats(x)
        out.weights, out.mean, out.sd = fit(design(x, mean, sd), y, strength).tolist(), mean.tolist(), sd.tolist()
    return out


def train_by(rows: DataFrame, key: str) -> DataFrame:
    """key, used, auc, base_auc, margin, strength, weights of a model per key (a user).

    rows: key, photo_id, burst_id, dup_group_id, features (array), positive, base. Of a key at most MOST_FITTED rows are
    fitted and MOST_EVALUATED of them evaluated, chosen by hash on the way into the group, which is the model's documented
    bound.
    """
    fold = fold_of(F.col("photo_id"), F.col("burst_id"), F.col("dup_group_id")).alias("fold")
    bounded = stratified(rows.select(key, "photo_id", fold, "features", "positive", "base"), key, MOST_FITTED)
    chosen = stratified(bounded, key, MOST_EVALUATED).select(key, "photo_id", F.lit(True).alias("evaluated"))
    ready = bounded.join(chosen, [key, "photo_id"], "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("photo_id", ignore_index=True)
        x = np.array([[np.nan if v is None else v for v in f] for f in b["features"]], float)
        o = train(x, b["positive"].to_numpy(bool), b["fold"].to_numpy(), b["base"].to_numpy(float), b["evaluated"].to_numpy(bool))
        return pd.DataFrame({key: [b[key].iloc[0]], "used": [o.used], "auc": [o.auc], "base_auc": [o.base_auc], "margin": [o.margin], "strength": [o.strength], "weights": [o.weights]})

    return ready.groupBy(key).applyInPandas(run, f"{key} long, used boolean, auc double, base_auc double, margin double, strength double, weights array<double>")


def explain(parts: DataFrame) -> DataFrame:
    """photo_id, likes, dislikes: up to three features for and against, of at least 0.05. parts: photo_id, feature, delta."""
    strong = parts.where(F.abs("delta") >= EXPLAIN_LEAST)
    held = strong.groupBy("photo_id").agg(F.collect_list(F.struct("delta", "feature")).alias("d"))
    top = lambda sign: F.transform(F.slice(F.array_sort(F.transform(F.filter("d", lambda x: x["delta"] * sign > 0), lambda x: F.struct((-x["delta"] * sign).alias("k"), x["feature"].alias("f")))), 1, EXPLAIN_TOP), lambda x: x["f"])
    return held.select("photo_id", top(1).alias("likes"), top(-1).alias("dislikes"))


def alpha(labels: int) -> float:
    return min(ALPHA_MAX, ALPHA_MAX * labels / ALPHA_FULL_AT)
