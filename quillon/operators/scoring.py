"""Explainable scores: expressions, issues, composites, stars and the ranking within bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs

# Fixed values.
EYES_CLOSED_BELOW, BLURRY_BELOW, BLURRY_SEVERE_BELOW, BLURRY_IN_BURST = 0.45, 0.35, 0.20, 0.85
OVER_CLIPPED, OVER_SEVERE_CLIPPED, OVER_MEAN, OVER_SEVERE_MEAN, OVER_DETAIL_BELOW = 0.10, 0.25, 0.82, 0.90, 0.45
UNDER_CRUSHED, UNDER_SEVERE_CRUSHED, UNDER_MEAN, UNDER_SEVERE_MEAN, UNDER_DETAIL_BELOW = 0.40, 0.60, 0.12, 0.07, 0.40
NOISY_AT, NOISY_AT_NIGHT = 0.22, 0.30
TILT_MIN, TILT_MAX, TILT_CONFIDENCE = 2.0, 10.0, 0.2
BYSTANDER_AREA, ARTIFICIAL_AT = 0.003, 0.55
PENALTY = {"closed_eyes": 0.25, "blurry": 0.30, "overexposed": 0.20, "underexposed": 0.20}
REDUNDANT_COS, REDUNDANT_MARGIN, PENALTY_REDUNDANT = 0.93, 0.05, 0.03
#: Weights of the components by scene.
WEIGHTS = {
    ("portrait", "group"): {"face": 0.40, "sharpness": 0.25, "aesthetic": 0.20, "exposure": 0.15, "composition": 0.08},
    ("landscape", "architecture"): {"aesthetic": 0.40, "technical": 0.30, "composition": 0.20, "exposure": 0.10},
    ("night",): {"aesthetic": 0.25, "sharpness": 0.35, "technical": 0.20, "exposure": 0.15, "composition": 0.08},
    (): {"aesthetic": 0.30, "sharpness": 0.30, "technical": 0.25, "exposure": 0.15, "composition": 0.08},
}
SCENES = ("portrait", "group", "landscape", "architecture", "night", "food", "pet", "other")
EXPRESSION = {"eyes_open": 0.40, "smile": 0.20, "gaze": 0.15, "pose": 0.10, "sharpness": 0.15}


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the parts that exist with their weights scaled to one; null without any."""
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, F.try_divide(total, weight))


def expression_score() -> Column:
    """Expression of a face from whichever of eyes, smile, gaze, pose and sharpness are known."""
    yaw, pitch = (F.abs(F.coalesce(c, F.lit(0.0))) for c in ("yaw", "pitch"))
    turned = F.least(F.greatest(yaw - 15, F.lit(0.0)) / 45 + F.greatest(pitch - 15, F.lit(0.0)) / 60, F.lit(1.0))
    values = {"eyes_open": clamp01(F.col("eyes_open")), "smile": 0.4 + 0.6 * clamp01(F.col("smile")), "gaze": clamp01(F.col("gaze")), "pose": F.when(F.col("yaw").isNotNull() | F.col("pitch").isNotNull(), 1.0 - turned), "sharpness": clamp01(F.col("sharpness"))}
    return weighted_mean([(w, values[k]) for k, w in EXPRESSION.items()])


def not_a_person() -> Column:
    return F.coalesce(F.col("nonhuman") == 1, F.lit(False)) | F.coalesce(F.col("artificial") >= ARTIFICIAL_AT, F.lit(False))


def is_bystander() -> Column:
    """A sharp, sizeable, living face that isn't a subject."""
    area = F.greatest(F.col("w"), F.lit(0.0)) * F.greatest(F.col("h"), F.lit(0.0))
    return (F.col("is_subject") != 1) & ~not_a_person() & (area >= BYSTANDER_AREA) & (F.coalesce("sharpness", F.lit(0.0)) >= BLURRY_BELOW)


#: Talking or half blinking: bounds of the bad-expression tag.
TALKING_AT, HALF_BLINK, SMILE_BELOW, READABLE_AT = 0.06, (0.45, 0.65), 0.35, 0.35


def bad_expression() -> Column:
    """talking, half_blink or null, of a subject's face that can be read and doesn't smile."""
    readable = (F.col("is_subject") == 1) & ~not_a_person() & (F.col("smile") < SMILE_BELOW) & ~F.coalesce(F.col("sharpness") < READABLE_AT, F.lit(False))
    eyes = (F.col("eyes_open") >= HALF_BLINK[0]) & (F.col("eyes_open") < HALF_BLINK[1])
    return F.when(readable & (F.col("mouth_open") >= TALKING_AT), "talking").when(readable & eyes, "half_blink")


def face_features(faces: DataFrame) -> DataFrame:
    """Per photo: subjects, mean expression of the subjects, closed eyes, bystanders, bad expressions."""
    subject = F.col("is_subject") == 1
    return faces.groupBy("photo_id").agg(
        F.count_if(subject).alias("subjects"), F.avg(F.when(subject, expression_score())).alias("face_score"), F.count_if(subject & (F.col("eyes_open") < EYES_CLOSED_BELOW)).alias("closed"),
        F.count_if(is_bystander()).alias("bystanders"), F.count_if(bad_expression().isNotNull()).alias("bad"),
    )


def scene_class() -> Column:
    """The scene, or by the number of subjects where it is unknown."""
    n = F.coalesce("subjects", F.lit(0))
    return F.when(F.col("scene_type").isin(*SCENES), F.col("scene_type")).when(n == 0, "other").when(n <= 2, "portrait").otherwise("group")


def _issue_flags(scene: Column) -> dict[str, tuple[Column, Column]]:
    """Issue and hard issue, by name."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean, detail, night = F.col("mean_luminance"), zero("sharpness"), scene == "night"
    over = ((zero("clipped_highlights") >= OVER_CLIPPED) | (zero("mean_luminance") > OVER_MEAN)) & ((detail < OVER_DETAIL_BELOW) | (zero("mean_luminance") > OVER_SEVERE_MEAN))
    dark = F.coalesce((mean < UNDER_SEVERE_MEAN) | ((mean < UNDER_MEAN) & (detail < UNDER_DETAIL_BELOW)), F.lit(False))
    under = ~night & ((zero("crushed_shadows") >= UNDER_CRUSHED) | dark)
    sharp = F.when(~over & ~under, F.col("sharpness"))
    tilt = F.abs(F.col("tilt_deg"))
    no = F.lit(False)
    return {
        "closed_eyes": (F.coalesce(F.col("closed") > 0, no),) * 2,
        "blurry": (F.coalesce(sharp < BLURRY_BELOW, no), F.coalesce(sharp < BLURRY_SEVERE_BELOW, no)),
        "overexposed": (over, over & ((zero("clipped_highlights") >= OVER_SEVERE_CLIPPED) | (zero("mean_luminance") > OVER_SEVERE_MEAN))),
        "underexposed": (under, under & ((zero("crushed_shadows") >= UNDER_SEVERE_CRUSHED) | F.coalesce(mean < UNDER_SEVERE_MEAN, no))),
        "tilted": (F.coalesce((zero("tilt_confidence") >= TILT_CONFIDENCE) & tilt.between(TILT_MIN, TILT_MAX), no), no),
        "bystander": (F.coalesce(F.col("bystanders") > 0, no), no),
        "noisy": (F.coalesce(F.col("noise") >= F.when(night, NOISY_AT_NIGHT).otherwise(NOISY_AT), no), no),
        "bad_expression": (F.coalesce(F.col("bad") > 0, no), no),
    }


def score_photos(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photo_id, scene, q, face_score, issues (mask), hard_issue, components and contributions.

    photos: photo_id, scene_type, sharpness, exposure, noise, iqa, aesthetic, composition, clipped_highlights,
    crushed_shadows, mean_luminance, tilt_deg, tilt_confidence; other columns are kept.
    """
    rows = photos.join(face_features(faces), "photo_id", "left").withColumn("scene", scene_class())
    noise = F.when(F.col("scene") == "night", F.col("noise") * 0.5).otherwise(F.col("noise"))
    value = {k: clamp01(F.col(c)) for k, c in (("face", "face_score"), ("sharpness", "sharpness"), ("aesthetic", "aesthetic"), ("exposure", "exposure"), ("composition", "composition"))}
    value["technical"] = clamp01(F.coalesce(F.col("iqa"), 1.0 - noise))
    default = WEIGHTS[()]
    weight = {}
    for k in value:
        w = F.lit(None).cast("double")
        for scenes, weights in WEIGHTS.items():
            if scenes:
                w = F.when(F.col("scene").isin(*scenes), F.lit(weights.get(k)).cast("double")).otherwise(w)
        known = [s for scenes in WEIGHTS for s in scenes]
        weight[k] = F.when(~F.col("scene").isin(*known), F.lit(default.get(k)).cast("double")).otherwise(w)
    for k in value:
        rows = rows.withColumn("v_" + k, F.when(weight[k].isNotNull(), value[k])).withColumn("w_" + k, F.when(value[k].isNotNull(), weight[k]))
    total = sum((F.coalesce("w_" + k, F.lit(0.0)) for k in value), F.lit(0.0))
    mean = F.try_divide(sum((F.coalesce(F.col("w_" + k) * F.col("v_" + k), F.lit(0.0)) for k in value), F.lit(0.0)), total)
    flags = _issue_flags(F.col("scene"))
    mask = sum((F.when(f, exprs.ISSUES[n]).otherwise(0) for n, (f, _) in flags.items()), F.lit(0))
    hard = {n: h for n, (_, h) in flags.items() if n in PENALTY}
    penalty = sum((F.when(h, PENALTY[n]).otherwise(0.0) for n, h in hard.items()), F.lit(0.0))
    parts = [F.when(F.col("v_" + k).isNotNull(), F.struct(F.lit(k).alias("key"), F.round(F.col("w_" + k) / total * (F.col("v_" + k) - 0.5), 4).alias("delta"))) for k in value]
    parts += [F.when(h, F.struct(F.lit(n).alias("key"), F.lit(-PENALTY[n]).alias("delta"))) for n, h in hard.items()]
    largest = F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()), lambda x, y: F.when(F.abs(x["delta"]) > F.abs(y["delta"]), -1).when(F.abs(x["delta"]) < F.abs(y["delta"]), 1).otherwise(0))
    any_hard = F.lit(False)
    for h in hard.values():
        any_hard = any_hard | h
    components = F.struct(*[F.col("v_" + k).alias(k) for k in value])
    out = rows.select(*photos.columns, "scene", "face_score", clamp01(F.coalesce(mean, F.lit(0.5)) - penalty).alias("q"), mask.alias("issue_mask"), any_hard.alias("hard_issue"), components.alias("components"), largest.alias("contributions"))
    return out


def rank_bursts(scored: DataFrame) -> DataFrame:
    """Adds rank, burst_size, final q, issue_mask (with burst-relative blur), redundant and ai_rating.

    scored: of score_photos with burst_id, taken_at, sharpness, sharpness_center, embedding. The burst-relative measure is
    the centre sharpness where all members have it. Pairs are formed within bursts alone, each against better ranks.
    """
    w = Window.partitionBy("burst_id")
    order = w.orderBy(F.desc("q"), F.coalesce("face_score", F.lit(0.0)).desc(), F.col("taken_at").asc_nulls_first(), "photo_id")
    rows = scored.withColumn("rank", F.row_number().over(order) - 1).withColumn("burst_size", F.count("*").over(w))
    whole = F.count("sharpness_center").over(w) == F.col("burst_size")
    rows = rows.withColumn("measure", F.when(whole, F.col("sharpness_center")).otherwise(F.col("sharpness")))
    own = rows.select("burst_id", "photo_id", "rank", "measure", "embedding", "components")
    other = own.select("burst_id", *[F.col(c).alias("o_" + c) for c in ("photo_id", "rank", "measure", "embedding", "components")])
    pairs = own.join(other, "burst_id").where("photo_id <> o_photo_id")
    names = scored.schema["components"].dataType.names
    no_better = F.lit(True)
    for k in names:
        no_better = no_better & F.coalesce(F.col(f"components.{k}") <= F.col(f"o_components.{k}") + REDUNDANT_MARGIN, F.lit(True))
    like = F.coalesce(exprs.cosine(F.col("embedding"), F.col("o_embedding")) >= REDUNDANT_COS, F.lit(False))
    facts = pairs.groupBy("photo_id").agg(F.median("o_measure").alias("others"), F.max((F.col("o_rank") < F.col("rank")) & like & no_better).alias("redundant"))
    rows = rows.join(facts, "photo_id", "left").withColumn("redundant", F.coalesce("redundant", F.lit(False)))
    exposure = F.col("issue_mask").bitwiseAND(F.lit(exprs.issue_mask("overexposed", "underexposed"))) != 0
    blurred = F.coalesce(F.col("measure") < BLURRY_IN_BURST * F.col("others"), F.lit(False)) & ~exposure
    rows = rows.withColumn("issue_mask", F.when(blurred, F.col("issue_mask").bitwiseOR(F.lit(exprs.ISSUES["blurry"]))).otherwise(F.col("issue_mask")))
    rows = rows.withColumn("q", F.when(F.col("redundant"), F.greatest(F.col("q") - PENALTY_REDUNDANT, F.lit(0.0))).otherwise(F.col("q")))
    best = (F.col("burst_size") >= 2) & (F.col("rank") == 0)
    return rows.withColumn("ai_rating", exprs.star_rating(F.col("q"), best, F.col("hard_issue"))).drop("measure", "others")


def fuse_taste(q: Column, taste: Column, labels: int) -> Column:
    """The score with a preference model's opinion mixed in, more so with more labels, 0.6 at most."""
    alpha = min(0.6, 0.6 * labels / 200)
    return F.when(taste.isNotNull(), (1 - alpha) * q + alpha * taste).otherwise(q)


#: Composition: weights of its parts, the frame's edge, heads that count for headroom, degrees of full penalty.
PARTS = {"thirds": 0.35, "headroom": 0.15, "horizon": 0.20, "cutoff": 0.30}
EDGE, HEAD_HEIGHT, LEVEL_PENALTY_DEG = 0.01, 0.08, 6.0


def _axis(a: Column) -> Column:
    """How well a coordinate sits on a third line, or a little less on the middle."""
    bell = lambda d, s: F.exp(-0.5 * F.pow(d / s, 2))
    third = F.least(F.abs(a - 1 / 3), F.abs(a - 2 / 3))
    return F.greatest(bell(third, 0.09), 0.8 * bell(F.abs(a - 0.5), 0.06))


def thirds(x: Column, y: Column) -> Column:
    return F.sqrt(_axis(clamp01(x)) * _axis(clamp01(y)))


def headroom(gap: Column) -> Column:
    return F.when(gap < 0.04, clamp01(F.greatest(gap, F.lit(0.0)) / 0.04)).when(gap <= 0.25, 1.0).otherwise(F.greatest(1.0 - 0.7 * (gap - 0.25) / 0.35, F.lit(0.3)))


def horizon(deg: Column) -> Column:
    return 1.0 - 0.85 * F.least(F.abs(deg) / LEVEL_PENALTY_DEG, F.lit(1.0))


def composition_scores(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photo_id, composition: placement, headroom, level and cut-off of the subjects, or of the salient box without any;
    null without an anchor.

    photos: photo_id, saliency (struct x, y, w, h or null), tilt_deg, tilt_confidence. faces: photo_id, is_subject,
    nonhuman, artificial, x, y, w, h.
    """
    beside = lambda x, y, w, h: (x < EDGE) | (x + w > 1 - EDGE) | (y + h > 1 - EDGE)
    box = [F.col(c).cast("double") for c in "xywh"]
    live = faces.where((F.col("is_subject") == 1) & ~not_a_person() & (F.col("w") > 0) & (F.col("h") > 0))
    around = live.groupBy("photo_id").agg(
        F.min(box[0]).alias("x1"), F.min(box[1]).alias("y1"), F.max(box[0] + box[2]).alias("x2"), F.max(box[1] + box[3]).alias("y2"), F.avg(F.when(beside(*box), 1.0).otherwise(0.0)).alias("cut"),
    )
    rows = photos.join(around, "photo_id", "left")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    s = [F.col(f"saliency.{c}") for c in "xywh"]
    salient = x1.isNull() & (s[2] > 0) & (s[3] > 0)
    cut = ~((s[2] >= 0.9) & (s[3] >= 0.9)) & (beside(*s) | (s[1] < EDGE))
    tall = y2 - y1
    level = (F.col("tilt_confidence") >= TILT_CONFIDENCE) & (F.abs("tilt_deg") <= TILT_MAX)
    anchored = x1.isNotNull() | F.coalesce(salient, F.lit(False))
    parts = {
        "thirds": F.when(x1.isNotNull(), thirds((x1 + x2) / 2, y1 + 0.4 * tall)).when(salient, thirds(s[0] + s[2] / 2, s[1] + s[3] / 2)),
        "headroom": F.when(tall >= HEAD_HEIGHT, headroom(y1)),
        "cutoff": F.when(x1.isNotNull(), 1.0 - 0.8 * F.col("cut")).when(salient, F.when(cut, 0.6).otherwise(1.0)),
        "horizon": F.when(anchored & level, horizon(F.col("tilt_deg"))),
    }
    return rows.select("photo_id", F.when(anchored, clamp01(weighted_mean([(PARTS[k], v) for k, v in parts.items()]))).alias("composition"))


#: Mean gray and contrast of a face at which it is fully visible.
COVER_LUMA, COVER_CONTRAST = 0.15, 0.06


def cover_score() -> Column:
    """How good a face is as a person's cover: big (to a cap), surely found, sharp, frontal, open, visible."""
    c = lambda n, default: F.coalesce(F.col(n).cast("double"), F.lit(default))
    bound = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    size = F.least(F.sqrt(F.greatest(c("w", 0.0) * c("h", 0.0), F.lit(0.0))), F.lit(0.3))
    turned = F.greatest(1 - F.abs(c("yaw", 0.0)) / 75, F.lit(0.05)) * F.greatest(1 - F.abs(c("pitch", 0.0)) / 60, F.lit(0.1))
    frontal = F.when(F.col("yaw").isNull() & F.col("pitch").isNull(), 0.7).otherwise(turned)
    t = bound(F.least(c("luma", 0.0) / COVER_LUMA, c("contrast", 0.0) / COVER_CONTRAST), 0.0, 1.0)
    visible = F.when(F.col("luma").isNotNull() & F.col("contrast").isNotNull(), 0.02 + 0.98 * F.pow(t, 3)).when(F.col("mean_luminance").isNotNull(), bound(c("mean_luminance", 0.0) / 0.3, 0.25, 1.0)).otherwise(1.0)
    return size * bound(c("det_score", 0.5), 0.05, 1.0) * (0.3 + bound(c("sharpness", 0.5), 0.0, 1.0)) * frontal * (1 - 0.8 * bound(c("occlusion", 0.0), 0.0, 1.0)) * visible
