"""SimHash near-duplicate detection with bit-sliced comparison.

1. A fingerprint per whole text: 64 bits, each the majority of that bit over the XXH64 of all word shingles.
2. Equal fingerprints are one node. For a radius r the 64 bits are cut into 2r blocks; two fingerprints within
   r bits agree on at least r blocks whole, so keying on each choice of r blocks loses no link.
3. A key's fingerprints are compared bit-sliced: 64 candidates are the lanes of a word, one word per bit
   position; carry-save counters add up the differing bits of all lanes at once, and a (query, block) pair is
   abandoned once all of its lanes exceed the radius. Keys with many fingerprints are dealt out as pairs of
   bounded tiles, so no task gets an unbounded group.
4. Each tile pair emits a spanning star of its links; components are then joined up across tiles.

Defined results: null or empty texts, or texts of white space alone, have fingerprint zero and link like any
other; texts with fewer words than a shingle hash the whole sequence; repeated ids and rows stay as they are;
rows with a null id get the component of their fingerprint. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import tasks, unused, values
from quillon.operators.graph import connected_components
from quillon.sources.scratch import materialize

BITS = 64
SEED = 42
TILE = 4096
#: (query, block) pairs that are compared at once; bounds a task's memory.
AT_ONCE = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return majority(np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long), a row for each input row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("hash"))
    return _prints(source, shingle).select(F.col("id").alias(id_col), "fp")


def _prints(source: DataFrame, shingle: int) -> DataFrame:
    """id, hash and fp of id, text and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in values(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["id", "hash", "fp"])

    return source.select("id", "text", "hash").mapInArrow(run, "id long, hash long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """Bit masks such that two values within radius bits agree on at least one of them."""
    blocks = 2 * radius if radius else 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    part = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical layout of values [value, word]: [block, bit] words whose lane i is that bit of the block's i-th value."""
    blocks, width = -(-len(values) // 64), values.shape[1] * 64
    bits = np.zeros((blocks * 64, width), np.uint8)
    bits[: len(values)] = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    lanes = np.packbits(bits.reshape(blocks, 64, width).transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view("<u8").reshape(blocks, width)


def within(queries: np.ndarray, block_planes: np.ndarray, q: np.ndarray, b: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, b, lanes) of the (query, block) pairs with a lane within radius. queries: [query, word]; order: the bit
    positions that can differ."""
    count = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    bound, over = (1 << radius.bit_length()) - 1 - radius, np.zeros(len(q), np.uint64)
    for k in range(bound):  # start the counters so that they overflow just beyond the radius
        carry = np.full(len(q), ALL)
        for i, c in enumerate(count):
            count[i], carry = c ^ carry, c & carry
    for n, bit in enumerate(order, 1):
        x = block_planes[b, bit] ^ (np.uint64(0) - ((queries[q, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)))
        for i, c in enumerate(count):
            count[i], x = c ^ x, c & x
        over |= x
        if n % 8 == 0:
            alive = over != ALL
            if not alive.all():
                q, b, over, count = q[alive], b[alive], over[alive], [c[alive] for c in count]
    alive = over != ALL
    return q[alive], b[alive], ~over[alive]


def lanes_set(q: np.ndarray, b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, value) of every lane that is set."""
    hit, lane = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[hit], b[hit] * 64 + lane


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Lower label in place until both ends of every link have the same one."""
    while True:
        while not np.array_equal(up := label[label], label):
            label[:] = up
        a, b = label[u], label[v]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _links_of_run(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, order: list[int]) -> np.ndarray:
    """The smallest row that each row of the run is linked with. left, right: the rows that are queries and lanes."""
    label = np.arange(len(values))
    vertical, same = planes(values[right]), left is right
    per = max(1, AT_ONCE // len(vertical))
    for at in range(0, len(left), per):
        rows = np.arange(at, min(at + per, len(left)))
        first = at // 64 if same else 0  # of the same tile, only lanes after the query
        q, b = np.repeat(rows, len(vertical) - first), np.tile(np.arange(first, len(vertical)), len(rows))
        q, b, lanes = within(values[left], vertical, q, b, radius, order)
        if not len(q):
            continue
        u, other = lanes_set(q, b, lanes)
        good = (other < len(right)) & (other > u if same else True)
        _join_labels(label, left[u[good]], right[other[good]])
    return label


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Spanning links a, b (fingerprints) of all pairs of distinct fingerprints within radius bits.

    prints: a column fp of distinct longs.
    """
    keyed = masks(radius)
    free = [[i for i in range(BITS) if not m >> i & 1] for m in keyed]
    rows = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(keyed)])))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = (
        rows.join(sizes, ["t", "key"])
        .withColumn("g", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("s", F.explode(F.expr("sequence(0, g - 1)")))
        .select("t", "key", F.least("own", "s").alias("ta"), F.greatest("own", "s").alias("tb"), "own", "fp")
    )
    # A given number of partitions, which adaptive execution doesn't merge by their few bytes: the work is in the pairs.
    dealt = shared.repartition(tasks(prints.sparkSession), "t", "key", "ta", "tb").sortWithinPartitions("t", "key", "ta", "tb", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            yield from compare(table, last := _last_run(table))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from compare(rest, rest.num_rows)

    def compare(table: pa.Table, until: int) -> Iterator[pa.RecordBatch]:
        if not until:
            return
        t, key, ta, tb, own, fp = (table.column(i).slice(0, until).to_numpy() for i in range(6))
        a, b = [], []
        starts = _runs(t, key, ta, tb)
        for s, e in zip(starts, [*starts[1:], until]):
            if e - s < 2:
                continue
            prints_of_run = fp[s:e].view(np.uint64)[:, None]
            everyone = np.arange(e - s)
            left, right = (everyone, everyone) if ta[s] == tb[s] else (everyone[own[s:e] == ta[s]], everyone[own[s:e] == tb[s]])
            if not len(left) or not len(right):
                continue
            label = _links_of_run(prints_of_run, left, right, radius, free[t[s]])
            joined = np.flatnonzero(label != everyone)
            a.append(fp[s:e][joined])
            b.append(fp[s:e][label[joined]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _runs(*keys: np.ndarray) -> list[int]:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new).tolist()


def _last_run(table: pa.Table) -> int:
    """Where the last run of equal keys begins."""
    return _runs(*(table.column(i).to_numpy() for i in range(4)))[-1] if table.num_rows else 0


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """id_col, fp (long), component_id (the smallest id reachable over links), a row for each input row."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "simhash")
    return _rooted(prints, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """prints (id, fp and more) with root (a fingerprint of the component) and component_id."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    member = connected_components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs whose id is the smallest of their group. Of rows with one id and one group, repeated or near
    copies of each other, one stays: that with the least text hash. Rows with a null id stay."""
    text_hash, kept_id, kept_hash = unused(docs, "text_hash", "kept_id", "kept_hash")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    prints = materialize(_prints(rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")))), shingle), "simhash")
    keep = _rooted(prints, radius).where("id = component_id").groupBy("root", F.col("id").alias(kept_id)).agg(F.min("hash").alias(kept_hash)).drop("root")
    marked = docs.withColumn(text_hash, hashed)
    stays = marked.join(keep, (F.col(id_col).cast("long") == F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash)), "left_semi")
    return stays.dropDuplicates([id_col, text_hash]).drop(text_hash).unionByName(docs.where(F.col(id_col).isNull()))
