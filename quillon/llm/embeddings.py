"""Embedding near-duplicates: spherical k-means cells and blocked cosine products within them.

1. Equal vectors of one label, known by a 128-bit hash, are one node with a count, so copies are never compared with
   each other.
2. Spherical k-means on a bounded, documented sample gives cells; every vector has a home cell, the nearest centroid.
   Two unit vectors with cosine >= t are at most d = sqrt(2 - 2t) apart, so of two that have different homes at least
   one lies within d / 2 of the plane between the two centroids. Visiting all cells whose plane is that near, every
   linked pair meets in the home of one of the two: no link is lost, whatever the centroids are. Vectors are not sent
   to cells where none of their label is at home.
3. A cell's vectors of one label are dealt out as pairs of bounded tiles; each pair of tiles is one matrix product in
   double precision. A pair of vectors is counted once, in the lower of the cells in which it meets.
4. Counts of links are added up; tiles give spanning stars, which are joined to components.

Defined results: null labels, null or zero vectors, and vectors with null or non-finite components link with nothing;
vectors of different lengths don't link; rows repeated with one id and vector are one vector; a null id is a
component of its own (null) and is not kept. n_links counts rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import tasks
from quillon.operators.graph import connected_components
from quillon.sources.scratch import materialize

THRESHOLD = 0.98
#: Vectors that k-means learns from, at most, and its rounds.
SAMPLE, ROUNDS, SEED = 20_000, 8, 7
#: Components of all sampled vectors, at most; centroids have at most half as many.
VALUES = 1 << 23
#: Centroids grow as the root of the rows, to at most this many (a broadcast of some MB).
CENTROIDS = 8192
TILE = 2048
#: Beyond rounding: a pair this near the threshold is settled by its exactly rounded sums.
EDGE = 1e-9


def kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; empty cells keep their centroid."""
    r = np.random.default_rng(seed)
    centres = vectors[r.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(vectors[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def cells_of(vectors: np.ndarray, centres: np.ndarray, threshold: float = THRESHOLD) -> list[list[int]]:
    """Home cell first, then the cells to visit, of unit vectors."""
    if not len(centres):
        return [[0] for _ in vectors]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-6
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
    out = []
    for i in range(0, len(vectors), 1024):
        close = vectors[i : i + 1024] @ centres.T
        home = close.argmax(1)
        rows = np.arange(len(home))
        margin = close[rows, home][:, None] - close
        visits = margin <= reach * gaps[home]
        visits[rows, home] = False
        out += [[int(h), *np.flatnonzero(v).tolist()] for h, v in zip(home, visits)]
    return out


def _valid(column: str) -> Column:
    values = F.col(column)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return values.isNotNull() & finite & F.exists(values, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine in double precision from exactly rounded sums."""
    dot = lambda a, b: math.fsum((a * b).tolist())
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_links, component_id, kept: a row per distinct (id, label, vector). label_col None: all may link."""
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    # Floats are shipped as floats; tasks widen them to doubles.
    held = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast(held).alias("vector"))
    usable = _valid("vector") & F.col("label").isNotNull()
    # Copies of one vector are a node; label and vector are known by 128 bits, so vectors are dealt out once for it.
    keyed = rows.where(usable).withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "label", "vector"))
    members = materialize(keyed.select("id", "h1", "h2").distinct(), "members")
    counted = members.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    vectors = keyed.select("h1", "h2", "label", "vector").dropDuplicates(["h1", "h2"])
    nodes = materialize(vectors.join(counted, ["h1", "h2"]).withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    shipped = table.sparkSession.sparkContext.broadcast(_centres(nodes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column(1).to_numpy(), [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                found = cells_of(_unit(_matrix(batch.column(0).take(pa.array(at)))), shipped.value.get(dim, np.empty((0, dim))), threshold)
                for i, c in zip(at.tolist(), found):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), pa.array(cells, pa.list_(pa.int32()))], ["dim", "label", "node", "copies", "vector", "cells"])

    placed = materialize(nodes.select("vector", "dim", "label", "node", "copies").mapInArrow(assign, f"dim int, label string, node long, copies long, vector {held}, cells array<int>"), "cells")
    at_home = F.col("cell") == F.col("cells")[0]
    met = placed.withColumn("cell", F.explode("cells"))
    # Every pair has one at home, so visitors meet in no cell where nothing of their label is at home. The table is
    # written, so that its size is known when the join with it is planned.
    sizes = met.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.count(F.when(at_home, 1)).alias("homes")).where("n > 1 AND homes > 0")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("label", "dim", "cell", F.when(F.col("n") <= TILE, 1).otherwise(tiles(F.col("homes"))).alias("gh"), F.when(F.col("n") <= TILE, 0).otherwise(tiles(F.col("n") - F.col("homes"))).alias("gv"))
    by_hash = lambda g: F.pmod(F.xxhash64("node"), F.col(g)).cast("int")
    dealt = (
        met.join(materialize(sizes, "cell-sizes"), ["label", "dim", "cell"])
        .withColumn("own", F.when(at_home | (F.col("gv") == 0), by_hash("gh")).otherwise(F.col("gh") + by_hash("gv")))
        .withColumn("s", F.explode(F.expr("sequence(0, IF(own < gh, gh + gv, gh) - 1)")))
        .select("label", "dim", "cell", F.least("own", "s").alias("ta"), F.greatest("own", "s").alias("tb"), "own", "node", "copies", "cells", "vector")
    )
    dealt = dealt.repartition(tasks(table.sparkSession), "label", "dim", "cell", "ta", "tb").sortWithinPartitions("label", "dim", "cell", "ta", "tb", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches):
            yield from _links(run, threshold)

    links = materialize(dealt.mapInArrow(compare, "node long, n long, other long"), "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("linked"))
    member = connected_components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = nodes.select("node", "h1", "h2", "least", "copies").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(smallest, "root").join(counts, "node", "left").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = members.join(told, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).distinct().select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by vector length. A share of the hashes is drawn before the sample is cut to size, so no task sends
    more than its part of it."""
    n, longest = nodes.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return {}
    size = max(1, min(SAMPLE, VALUES // longest))
    share = min(1.0, 1.2 * size / n + 1000 / n)
    drawn = F.shiftrightunsigned(F.xxhash64("h1", "h2"), 33) <= int(share * (1 << 31))
    sample = nodes.where(drawn).orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(size).select("dim", "vector").toArrow().combine_chunks()
    dims, centres = sample.column("dim").to_numpy(), {}
    k = min(CENTROIDS, max(1, math.isqrt(n)))
    for dim in np.unique(dims).tolist():
        of = _unit(_matrix(sample.column("vector").take(pa.array(np.flatnonzero(dims == dim))).combine_chunks()))
        centres[dim] = kmeans(of, max(1, min(k, len(of), VALUES // 2 // dim)))
    return centres


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal label, dim, cell and tiles; a run has two tiles at most."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        starts = _starts(table)
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1]) if starts else None
    if rest is not None and rest.num_rows:
        yield rest


def _starts(table: pa.Table) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(5):
        column = table.column(i).combine_chunks().dictionary_encode().indices.to_numpy() if i == 0 else table.column(i).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new).tolist()


def _links(run: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each row with links: node, rows linked with it here, and a node that it is joined with (or null)."""
    cell, ta, tb = (run.column(i)[0].as_py() for i in (2, 3, 4))
    own, node, copies = (run.column(i).to_numpy() for i in (5, 6, 7))
    cells = run.column(8).to_pylist()
    raw = _matrix(run.column(9).combine_chunks())
    unit = _unit(raw)
    everyone = np.arange(len(node))
    left, right = (everyone, everyone) if ta == tb else (everyone[own == ta], everyone[own == tb])
    home = np.array([c[0] for c in cells])
    linked, label = np.zeros(len(node), np.int64), everyone.copy()
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        close = unit[rows] @ unit[right].T
        u, v = np.nonzero(close >= threshold - EDGE)
        u, v, c = rows[u], right[v], close[u, v]
        good = u < v if ta == tb else np.ones(len(u), bool)
        # Two visitors meet in a home of theirs; a pair that meets twice counts in the lower cell.
        good &= (home[u] == cell) | (home[v] == cell)
        u, v, c = u[good], v[good], c[good]
        twice = [k for k in np.flatnonzero(home[u] != home[v]).tolist() if max(home[u[k]], home[v[k]]) == cell and _both(cells, u[k], v[k])]
        unsure = [k for k in np.flatnonzero(c < threshold + EDGE).tolist() if exact_cosine(raw[u[k]], raw[v[k]]) < threshold]
        keep = np.ones(len(u), bool)
        keep[twice + unsure] = False
        u, v = u[keep], v[keep]
        np.add.at(linked, u, copies[v])
        np.add.at(linked, v, copies[u])
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    some = np.flatnonzero((linked > 0) | (label != everyone))
    if len(some):
        other = np.ma.masked_array(node[label[some]], label[some] == some)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(linked[some]), pa.array(other.data, mask=np.ma.getmaskarray(other))], ["node", "n", "other"])


def _both(cells: list[list[int]], u: int, v: int) -> bool:
    """Whether each of two rows visits the other's home, so that they meet in both."""
    return cells[v][0] in cells[u] and cells[u][0] in cells[v]
