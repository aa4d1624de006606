"""Storing clustered people: the person of every face after a clustering, and the faces that are no human's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a group of which fewer than this share of the judged faces are human is no person's.
HUMAN_SHARE = 0.5


def assign_people(faces: DataFrame, tracks: DataFrame, elsewhere: DataFrame, after: int) -> DataFrame:
    """face_id, photo_id, person_id, nonhuman, singleton of every face.

    faces: face_id (not negative), photo_id, track_id, person_id, locked, is_subject, human (null: not judged); tracks:
    track_id, kind, number, has_vector, kinds as `people.people` tells them; elsewhere: person_id, named, known, found, photos,
    locked, what the library holds of each person outside these faces; after: the largest person id in use.

    A track's group is its known person, its new or weak cluster, or the track alone, if it has a vector and a subject. A
    weak cluster makes no person: its tracks are people on their own, singletons, like those without a cluster. A group
    without a name or a locked face, of whose judged faces too few are human, gets no person; its faces are marked nonhuman
    if it spans two photos. A weak cluster is judged as one and then track by track. Locked faces keep their person.
    A new id is `after` + 1 + the smallest face_id of its group: unique without numbering all groups in one task.
    Faces without a known track keep their person.
    """
    held = faces.groupBy("track_id").agg(F.coalesce(F.bool_or("is_subject"), F.lit(False)).alias("subject"), F.min("face_id").alias("first"))
    own = F.struct(F.col("kind"), F.col("number").cast("long").alias("number"))
    alone = F.when(F.col("subject") & F.col("has_vector"), F.struct(F.lit("single").alias("kind"), F.col("track_id").cast("long").alias("number")))
    settled, weak = F.col("kind").isin("person", "new"), F.col("kind") == "weak"
    placed = tracks.join(held, "track_id").select("track_id", "first", F.when(settled | weak, own).otherwise(alone).alias("judged"), F.when(weak, alone).alias("then"), F.when(settled, own).otherwise(alone).alias("target"))

    cast = faces.join(placed, "track_id").select("photo_id", "human", "locked", F.explode(F.array_compact(F.array("judged", "then"))).alias("of"))
    votes = cast.groupBy("of").agg(F.count("human").alias("known"), F.count_if("human").alias("found"), F.min("photo_id").alias("low"), F.max("photo_id").alias("high"), F.max("locked").alias("locked"))
    outside = elsewhere.select(F.struct(F.lit("person").alias("kind"), F.col("person_id").cast("long").alias("number")).alias("of"), "named", F.col("known").alias("more_known"), F.col("found").alias("more_found"), F.col("photos").alias("more_photos"), F.col("locked").alias("more_locked"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known, found = F.col("known") + zero("more_known"), F.col("found") + zero("more_found")
    free = ~F.coalesce("named", F.lit(False)) & ~F.coalesce("locked", F.lit(False)) & ~F.coalesce("more_locked", F.lit(False))
    spans = (F.col("low") < F.col("high")) | (zero("more_photos") > 0)
    vetoed = votes.join(outside, "of", "left").where(free & (known > 0) & (found < HUMAN_SHARE * known)).select("of", spans.alias("spans"))

    one, two = (vetoed.select(F.col("of").alias(c), F.col("spans").alias(f"{c}_spans")) for c in ("judged", "then"))
    told = placed.join(one, "judged", "left").join(two, "then", "left").withColumn("veto", F.coalesce("judged_spans", "then_spans"))
    ids = told.where("veto IS NULL AND target.kind <> 'person'").groupBy("target").agg((F.min("first") + F.lit(after + 1)).alias("new_id"))
    outcome = told.join(ids, "target", "left").select("track_id", "veto", F.when(F.col("veto").isNull(), F.when(F.col("target.kind") == "person", F.col("target.number")).otherwise(F.col("new_id"))).alias("to"), (F.col("target.kind") == "single").alias("single"), F.lit(True).alias("clustered"))

    kept = F.coalesce("locked", F.lit(False)) | F.col("clustered").isNull()
    person = F.when(kept, F.col("person_id").cast("long")).otherwise(F.col("to"))
    return faces.join(outcome, "track_id", "left").select(
        "face_id", "photo_id", person.alias("person_id"), (~kept & F.coalesce("veto", F.lit(False))).alias("nonhuman"), (~kept & F.col("to").isNotNull() & F.coalesce("single", F.lit(False))).alias("singleton")
    )
