"""Operator 1: near-duplicate embeddings.

The signs of a vector's products with random hyperplanes give it a key in each of
several tables. Vectors that share a key are compared by exact cosine in double
precision, and the links found are joined to connected components. With n vectors
a key has so many bits that a bucket holds about `BUCKET` of n random vectors, and
there are so many tables that a pair at the threshold shares a bucket in one of
them with probability `recall` or more.

Equal vectors are one row before that and link with each other uncompared. What is
shuffled for each table is not the vector but a sketch of `SKETCH` more signs: of
vectors that share a key, those whose sketches differ in more bits than a pair at
the threshold ever may are pruned, and the rest join to components of candidates.
Each vector then goes once to the other candidates of its component, where all
pairs are compared exactly: a vector leaves with its number of links, and a
component with links that join what it joins, fewer rows than vectors, however
dense it is. A bucket or component of more than `BLOCK` vectors is dealt out in
blocks, each pair of which is compared in a place of its own.

Results: null, zero and empty vectors and those with null or non-finite parts
link with nothing; vectors of unequal length don't link; repeated rows are
vectors of their own that link; null ids link like others but never name a
component unless it has no other; an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.buckets import dealt, joins, runs
from tandem.llm.components import connected_components
from tandem.llm.shared import written

COSINE, RECALL, BUCKET, BLOCK, SKETCH, SEED = 0.95, 0.9999, 64, 4096, 256, 7


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for `n` vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(31, max(4, math.ceil(math.log2(max(1, n / BUCKET)))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def most_different(cosine: float = COSINE) -> int:
    """Bits of a sketch in which a pair at `cosine` differs: its mean and 4.5 standard deviations, which one pair in 100,000 passes."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 4.5 * math.sqrt(SKETCH * p * (1 - p)))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _signs(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, size, keys, sketch) of rows (node, embedding)."""
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size not in planes:
                planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * bits + SKETCH))
            for part in (rows[i : i + 1000] for i in range(0, len(rows), 1000)):
                signs = _matrix(batch.column(1).take(pa.array(part))) @ planes[size] > 0
                keys = (signs[:, : tables * bits].reshape(len(part), tables, bits) @ weights).astype(np.int32)
                sketch = np.packbits(signs[:, tables * bits :], axis=1)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables)
                yield pa.record_batch([batch.column(0).take(pa.array(part)), pa.array(np.full(len(part), size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["node", "size", "keys", "sketch"])


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of nodes that join what the buckets' pairs of close sketches join."""

    def done(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        node = rows.column("node").combine_chunks().to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)

        def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            parts = range(0, len(a), 1 << 16)
            return np.concatenate([np.flatnonzero(np.bitwise_count(sketch[a[i : i + (1 << 16)]] ^ sketch[b[i : i + (1 << 16)]]).sum(1, dtype=np.int64) <= most) + i for i in parts] or [np.zeros(0, np.int64)])

        pairs = np.array(joins(run, close), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    yield from runs(batches, 2, 50_000, done)


def exact_links(vectors: np.ndarray, n: np.ndarray, own: np.ndarray, together: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each vector, of which there are `n`, the number of others that it links with, and links that join what all links join.

    Two vectors of one block, `own`, are compared only if `together`: where that block meets itself.
    """
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    norms, links, label, out = np.sqrt((vectors * vectors).sum(1)), np.zeros(len(n), np.int64), np.arange(len(n)), []
    for start in range(0, len(n), 256):
        part = slice(start, start + 256)
        close = (vectors[part] @ vectors.T) / (norms[part, None] * norms[None]) >= cosine
        close &= np.arange(len(n))[None] > np.arange(start, start + len(close))[:, None]
        close &= (own[part, None] != own[None]) | together[part, None]
        links[part] += close @ n
        links += n[part] @ close
        for i in (np.flatnonzero(close.any(1)) + start).tolist():
            near = np.flatnonzero(close[i - start] & (label != label[i]))
            theirs, where = np.unique(label[near], return_index=True)
            if len(theirs):
                label[np.isin(label, theirs)] = label[i]
                out += [(i, j) for j in near[where].tolist()]
    return links, out


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, links, other) of the rows of each component and block: a node with its number of links or with a node that it links with."""

    def done(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        node, n, own, n_blocks, block = (rows.column(c).combine_chunks().to_numpy() for c in ("node", "n", "own", "n_blocks", "block"))
        out: list[tuple[int, int, int | None]] = []
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(run)]):
            vectors = _matrix(rows.column("embedding").combine_chunks().slice(i, j - i))
            links, pairs = exact_links(vectors, n[i:j], own[i:j], (block == own * n_blocks + own)[i:j], cosine)
            out += [(int(node[i + k]), int(links[k]), None) for k in np.flatnonzero(links).tolist()]
            out += [(int(node[i + a]), 0, int(node[i + b])) for a, b in pairs]
        return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["node", "links", "other"])

    yield from runs(batches, 2, 0, done)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one a vector."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = rows.where(good)
    # Numbers that hold once they are written: any that tell vectors apart will do.
    classes = written(usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = plan_tables(classes.count(), cosine, recall)
    signed = written(classes.select("node", "embedding").mapInArrow(lambda x: _signs(x, bits, tables, SEED), "node long, size int, keys array<int>, sketch binary"), "signs")

    each = signed.select("node", "sketch", "size", F.posexplode("keys").alias("table", "key")).select(F.xxhash64("size", "table", "key").alias("key"), "node", "sketch")
    many = F.ceil(F.col("count") / F.lit(block // 2)).alias("n")
    hot = written(each.groupBy("key").count().where(F.col("count") > block).select("key", many), "hot-buckets")
    placed = dealt(each, "key", "node", None if hot.isEmpty() else hot).select("key", "block", "node", "sketch")
    most = most_different(cosine)
    pairs = placed.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(lambda x: _candidates(x, most), "a long, b long")

    near = written(connected_components(pairs).withColumnRenamed("id", "node"), "candidates")
    large = written(near.groupBy("component").count().where(F.col("count") > block).select("component", many), "large-candidates")
    placed = dealt(near.join(classes, "node"), "component", "node", None if large.isEmpty() else large).select("component", "block", "own", "n_blocks", "node", "n", "embedding")
    found = written(placed.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(lambda x: _compared(x, cosine), "node long, links long, other long"), "links")

    groups = connected_components(found.where("other is not null"), "node", "other").withColumnRenamed("id", "node")
    of_node = found.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node").join(classes.select("node", "least"), "node")
    of_node = written(of_node, "linked-vectors")
    smallest = written(of_node.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    linked = of_node.join(smallest, "component").select("node", "links", "component_id", F.lit(True).alias("is_linked"))
    component = F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("least"))
    named = classes.join(linked, "node", "left").select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"))
    out = usable.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
