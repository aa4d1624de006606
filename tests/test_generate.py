from pyspark.sql import functions as F

from quillon.operators import people
from quillon.sources import generate


def test_generated_catalog(spark):
    a, b = generate.photos(spark, 300, 2), generate.photos(spark, 300, 2).repartition(3)
    assert sorted(a.collect()) == sorted(b.collect())
    rows = a.agg(F.count("*").alias("n"), F.countDistinct("photo_id").alias("ids"), F.avg((F.col("flag") == 1).cast("int")).alias("picked"), F.avg(F.col("user_rating").isNotNull().cast("int")).alias("rated"), F.avg((F.col("issues") > 0).cast("int")).alias("issues")).first()
    assert rows.n == rows.ids > 1_000 and 0.04 < rows.picked < 0.12 and 0.25 < rows.rated < 0.35 and 0.3 < rows.issues < 0.4


def test_recomputed_subjects(spark):
    box = (0.4, 0.4, 0.2, 0.2)
    rows = [(1, 1, *box, 0.8, 0.5, False, False, False), (1, 2, 0.02, 0.02, 0.02, 0.02, 0.8, 0.5, False, False, True), (2, 3, *box, 0.8, None, False, True, True), (2, 4, *box, None, None, True, False, True)]
    df = spark.createDataFrame(rows, "photo_id long, face_id long, x double, y double, w double, h double, sharpness double, gaze double, named boolean, not_person boolean, is_subject boolean")
    assert sorted((r.face_id, r.is_subject) for r in people.recompute_subjects(df).collect()) == [(1, True), (2, False), (3, False)]
