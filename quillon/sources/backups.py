"""Backups of a catalog's tables: written as a whole, checked by digest, kept up to a number.

A backup is a folder with a Parquet table per name and a manifest that is put there last. A folder without a manifest is
a backup that was cut off: it is not listed, never restored and goes with the next pruning once a newer one is complete.
"""

from __future__ import annotations

import json

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 10
PREFIX = "catalog-"
MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _told(table: DataFrame) -> dict:
    """Rows of a table and a digest that doesn't depend on their order: both are partial sums before they meet."""
    digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)"))
    got = table.agg(F.count("*").alias("rows"), digest.cast("string").alias("digest")).first()
    return {"rows": got["rows"], "digest": got["digest"], "schema": table.schema.json()}


def backups(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete backups in folder, the newest first."""
    fs, place = _files(spark, folder)
    if not fs.exists(place):
        return []
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{PREFIX}*/{MANIFEST}"))
    return sorted((s.getPath().getParent().getName() for s in found or []), reverse=True)


def back_up(spark: SparkSession, tables: dict[str, DataFrame], folder: str, stamp: str, keep: int = KEEP) -> str:
    """Write the tables as backup PREFIX + stamp, of which later ones sort later; prune to `keep`; return the name."""
    name = PREFIX + stamp
    path = f"{folder}/{name}"
    held = {}
    for t, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{t}")  # an existing backup of that stamp is never overwritten
        held[t] = _told(spark.read.parquet(f"{path}/{t}"))
    fs, place = _files(spark, f"{path}/{MANIFEST}")
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{MANIFEST}.part")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
    out.close()
    if not fs.rename(hidden, place):
        raise OSError(f"cannot complete the backup {path}")
    prune(spark, folder, keep)
    return name


def prune(spark: SparkSession, folder: str, keep: int = KEEP) -> list[str]:
    """Delete all but the `keep` newest complete backups, and the cut-off ones that are older than the newest."""
    fs, place = _files(spark, folder)
    whole = backups(spark, folder)
    every = [s.getPath().getName() for s in fs.listStatus(place)] if whole else []
    gone = sorted(n for n in every if n.startswith(PREFIX) and (n in whole[keep:] or (n not in whole and n < whole[0])))
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"), True)
    return gone


def _manifest(spark: SparkSession, folder: str, name: str) -> dict[str, dict]:
    if name not in backups(spark, folder):
        raise ValueError(f"no complete backup: {name}")
    return json.loads(spark.read.text(f"{folder}/{name}/{MANIFEST}", wholetext=True).first()[0])


def verify(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """table_name, n_rows, problem (null: none) for each table of a backup; the tables are read whole, one aggregate each."""
    out = []
    for t, held in sorted(_manifest(spark, folder, name).items()):
        try:
            now = _told(spark.read.parquet(f"{folder}/{name}/{t}"))
            wrong = [k for k in ("schema", "rows", "digest") if now[k] != held[k]]
            out.append((t, now["rows"], f"differs in {', '.join(wrong)}" if wrong else None))
        except PySparkException as e:
            out.append((t, None, f"cannot be read: {str(e).splitlines()[0][:200]}"))
    return spark.createDataFrame(out, "table_name string, n_rows long, problem string")


def restore(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """The tables of a backup, if all of them verify."""
    wrong = verify(spark, folder, name).where("problem IS NOT NULL").collect()
    if wrong:
        raise ValueError(f"{name} cannot be restored: " + "; ".join(f"{r.table_name} {r.problem}" for r in wrong))
    return {t: spark.read.parquet(f"{folder}/{name}/{t}") for t in _manifest(spark, folder, name)}
