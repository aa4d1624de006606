"""Near copies by the share of common word shingles: Jaccard AT_LEAST or more over shingles of SHINGLE words.

Operator 7's fingerprints and bit-sliced comparison, at the radius that such a similarity needs:

1. Equal texts are one node. A node's fingerprint has WORDS * 64 bits, each the majority of that bit over the hashes of
   its distinct shingles. At a Jaccard of 0.8 about 15 % of the bits differ, far more than pigeonhole keys can bear, so
   nodes meet by minima of their shingle hashes: ROWS minima are a key and there are BANDS keys. Two texts of Jaccard j
   share a key with a chance of 1 - (1 - j^ROWS)^BANDS: 0.9996 at 0.8.
2. All nodes of a key are first held against the least of them, one pair a node, by the exact Jaccard of their shingle
   sets. That settles most groups of copies.
3. Keys whose nodes still belong to different components are dealt out as pairs of bounded tiles, with the nodes'
   shingle sets, and compared bit-sliced; pairs of different components within RADIUS bits are candidates (at Jaccard
   0.8 four standard deviations are within it). They are settled in the tile by the exact Jaccard; a tile emits the
   links of a spanning forest, never its pairs. No candidate is left out.

Defined results: null texts are empty; texts without words are copies of each other; texts with fewer words than a
shingle are one shingle; rows with a null id stay; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import tasks, unused, values
from quillon.llm.simhash import _join_labels, _last_run, _runs, lanes_set, majority, planes, within
from quillon.operators.graph import connected_components
from quillon.sources.scratch import materialize

SHINGLE, AT_LEAST = 5, 0.8
BANDS, ROWS = 20, 5
WORDS, RADIUS = 2, 40
SEED, TILE = 42, 4096
#: (query, block) pairs that are compared at once; bounds a task's memory.
AT_ONCE = 1 << 14
#: Pairs that are settled one by one rather than by matrix products, and columns of a product; the results are the same.
FEW, COLUMNS = 100, 1024

_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits in an order that visits all bytes early: a block is abandoned as soon as all of its lanes differ enough.
_ORDER = [w * 64 + i for i in range(64) for w in range(WORDS)]


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return np.unique(np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1 << 10):
        np.minimum(out, ((hashes[None, at : at + (1 << 10)] ^ _XOR) * _ODD).min(1), out=out)
    return out


def fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS fingerprints of 64 bits of distinct shingle hashes, each from hashes mixed anew."""
    out = []
    for w in range(WORDS):
        out.append(majority(hashes) if len(hashes) else 0)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
        hashes = hashes ^ (hashes >> np.uint64(29))
    return out


def _sketches(nodes: DataFrame) -> DataFrame:
    """node, keys (one of each band) and the words of the fingerprint, of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = [], np.empty((batch.num_rows, WORDS), np.uint64)
            for i, text in enumerate(values(batch.column(1))):
                hashes = shingles(text)
                rows = minima(hashes).astype("<u8").tobytes()
                keys.append(np.array([xxhash.xxh64_intdigest(rows[k : k + 8 * ROWS]) for k in range(0, len(rows), 8 * ROWS)], np.uint64).view(np.int64))
                prints[i] = fingerprint(hashes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *(pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(WORDS))], ["node", "keys", "f0", "f1"])

    return nodes.select("node", "text").mapInArrow(run, "node long, keys array<long>, f0 long, f1 long")


class Sets:
    """Shingle sets of the rows of a run, for exact counts of common shingles of many pairs at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.size = sets, np.array([len(x) for x in sets], np.int64)
        self.columns: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def near(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the sets of the pairs are near copies."""
        if len(u) <= FEW:
            return np.array([jaccard(self.sets[x], self.sets[y]) >= AT_LEAST for x, y in zip(u.tolist(), v.tolist())], bool)
        common = self.common(u, v)
        union = self.size[u] + self.size[v] - common
        return common >= AT_LEAST * union  # an empty pair has 0 of 0

    def common(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Common shingles by products of 0/1 matrices, some columns (shingles that several rows have) at a time."""
        if self.columns is None:
            _, number, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(self.sets)), self.size)
            shared = (times > 1)[number]
            number = (np.cumsum(times > 1) - 1)[number][shared]
            order = np.argsort(number, kind="stable")
            self.columns = row[shared][order], number[order], np.arange(0, int((times > 1).sum()) + COLUMNS, COLUMNS)
        row, number, edges = self.columns
        lines, at_u = np.unique(u, return_inverse=True)
        lanes, at_v = np.unique(v, return_inverse=True)
        place_u, place_v = np.full(len(self.sets), -1), np.full(len(self.sets), -1)
        place_u[lines], place_v[lanes] = np.arange(len(lines)), np.arange(len(lanes))
        product = np.zeros((len(lines), len(lanes)), np.float32)
        for low, high in zip(edges, edges[1:]):
            s, e = np.searchsorted(number, (low, high))
            product += _zero_one(place_u[row[s:e]], number[s:e] - low, len(lines)) @ _zero_one(place_v[row[s:e]], number[s:e] - low, len(lanes)).T
        return product[at_u, at_v].astype(np.int64)


def _zero_one(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, COLUMNS), np.float32)
    out[rows[rows >= 0], columns[rows >= 0]] = 1
    return out


def near_links(prints: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the smallest row that each is joined with, over near copies of which one is in left and one in right.
    Pairs with one label are joined already."""
    everyone = np.arange(len(prints))
    joined = np.unique(label, return_index=True, return_inverse=True)
    own = joined[1][joined[2]]  # the first row of each label
    up, vertical, same = own.copy(), planes(prints[right]), left is right
    per = max(1, AT_ONCE // len(vertical))
    for at in range(0, len(left), per):
        rows = np.arange(at, min(at + per, len(left)))
        first = at // 64 if same else 0  # of the same tile, only lanes after the query
        q, b = np.repeat(rows, len(vertical) - first), np.tile(np.arange(first, len(vertical)), len(rows))
        u, v = lanes_set(*within(prints[left], vertical, q, b, RADIUS, _ORDER))
        good = v < len(right)
        u, v = left[u[good]], right[v[good]]
        good = (up[u] != up[v]) & (v > u if same else True)
        u, v = u[good], v[good]
        if len(u):
            good = sets.near(u, v)
            _join_labels(up, u[good], v[good])
    new = everyone[(up != own)]
    return new, up[new]


def _tile_links(keyed: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b that join nodes of one key and different components. keyed: t, key, node, f0, f1; texts: node and text."""
    n = tasks(keyed.sparkSession)
    labelled = keyed.join(roots, "node", "left").select("t", "key", "node", F.coalesce("root", "node").alias("label"), "f0", "f1")
    mixed = labelled.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rows = materialize(labelled.join(mixed.select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("g")), ["t", "key"]), "mixed")
    sets = _sets(texts.join(rows.select("node").distinct(), "node", "left_semi"))
    tiled = (
        rows.join(sets, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("s", F.explode(F.expr("sequence(0, g - 1)")))
        .select("t", "key", F.least("own", "s").alias("ta"), F.greatest("own", "s").alias("tb"), "own", "node", "label", "f0", "f1", "hashes")
    )
    dealt = tiled.repartition(n, "t", "key", "ta", "tb").sortWithinPartitions("t", "key", "ta", "tb", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            yield from compare(table.slice(0, last := _last_run(table)))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from compare(rest)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        t, key, ta, tb, own, node, label, *words = (table.column(i).to_numpy() for i in range(7 + WORDS))
        prints = np.stack(words, axis=1).view(np.uint64)
        starts = _runs(t, key, ta, tb)
        for s, e in zip(starts, [*starts[1:], table.num_rows]):
            if (label[s:e] == label[s]).all():
                continue
            everyone = np.arange(e - s)
            left, right = (everyone, everyone) if ta[s] == tb[s] else (np.flatnonzero(own[s:e] == x[s]) for x in (ta, tb))
            if len(left) and len(right):
                sets = Sets([np.frombuffer(x, np.uint64) for x in table.column(7 + WORDS).slice(s, e - s).to_pylist()])
                a, b = near_links(prints[s:e], label[s:e], left, right, sets)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[s:e][a]), pa.array(node[s:e][b])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame) -> DataFrame:
    """node and hashes (its shingle set) of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in values(batch.column(1))], pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _settled(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are near copies. texts: node and text, one row a node."""
    own = pairs.select("a").distinct().join(texts, F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "text")
    met = pairs.join(texts, F.col("b") == F.col("node")).select("a", "b", "text")
    dealt = own.unionByName(met).repartition(tasks(pairs.sparkSession), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for b, text in zip(batch.column(1).to_pylist(), values(batch.column(2))):
                theirs = shingles(text)
                if b is None:
                    mine = theirs
                good.append(b is not None and jaccard(mine, theirs) >= AT_LEAST)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt.mapInArrow(run, "a long, b long")


def near_copy_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """node (xxhash64 of a text), root (of its component; for nodes that aren't its smallest)."""
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = materialize(_sketches(texts), "sketches")
    rows = sketches.dropDuplicates(["node"]).select("node", F.posexplode("keys").alias("t", "key"), "f0", "f1")
    # A key's nodes and, pre-aggregated, how many they are and the least of them.
    sizes = rows.select("t", "key", "node").groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    keyed = materialize(rows.join(sizes.drop("n"), ["t", "key"]), "near-keys")
    held = materialize(texts.join(keyed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    pairs = materialize(keyed.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "near-pairs")
    good = materialize(_settled(pairs, held), "near-links")
    first = connected_components(good).select("node", "root")
    more = materialize(_tile_links(keyed, first, held), "near-links")
    return connected_components(good.unionByName(more)).select("node", "root")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group of near copies; of rows of one group with that id, one
    stays. Rows with a null id stay."""
    own, kept_id, kept = unused(docs, "own_node", "kept_id", "kept_node")
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    places = marked.select(F.col(id_col).cast("long").alias("id"), F.col(own).alias("node")).distinct()
    rooted = places.join(near_copy_groups(docs, text_col), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    keep = rooted.join(least, "root").where("id = least").groupBy("root", "id").agg(F.min("node").alias(kept)).select(F.col("id").alias(kept_id), kept)
    stays = marked.join(keep, (F.col(own) == F.col(kept)) & (F.col(id_col).cast("long") == F.col(kept_id)), "left_semi")
    return stays.dropDuplicates([id_col, own]).drop(own).unionByName(docs.where(F.col(id_col).isNull()))
