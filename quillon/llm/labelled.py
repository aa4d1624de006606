"""Folds and bounded training samples of the operators that learn from labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import materialize


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label (0 or 1) of at most `most` labelled documents outside the held-out fold, as a written table.

    Which ones is settled by a hash of the id, so the sample is the same in every run and spread over the whole
    table. Labels other than 0 and 1, null ids and null texts are left out; repeated label rows count once.
    """
    kept = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(f"label IN (0, 1) AND id IS NOT NULL").where(fold("id", modulus) != held_out)
    # Rows of (id, label), `most` at most: small enough for every task, whatever the size of the labels.
    sample = kept.dropDuplicates(["id", "label"]).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return materialize(texts.join(F.broadcast(sample), "id").select("id", "text", "label"), "training")
