"""Operator 8: SimHash near-duplicates, pruned on the pigeonring.

A fingerprint has the majority bits of its shingles' hashes. Its 64 bits lie on a
ring of five segments. If two fingerprints differ in at most four bits, there is
a segment from which every chain of consecutive segments keeps to its share of
those four: no difference in the first, one in the first two, two in three, three
in four, four in all. So each fingerprint gets the keys (start, first segment,
second segment with one bit left out): two that link share a key. Those that
share one are checked along the longer chains, and what is left by all 64 bits.

Equal fingerprints are one row before that. Fingerprints with equal keys lie
together in a sorted partition, where only links that join two groups not joined
yet are kept: fewer rows than fingerprints, however dense a group is. A key with
more than `BLOCK` fingerprints is dealt out in blocks, each pair of which is
compared in a place of its own.

`drop_near_duplicates` removes near copies by what two texts share: five-word
shingles with a Jaccard similarity of 0.8 or more. Such texts differ in up to
about twenty bits, too many for segments to serve as keys. So texts meet where the
least of their shingles by one of six orders is the same, which two such texts miss
with a chance of 0.2 to the sixth; the pigeonring, here with budgets for 24 bits
over the fingerprint of the distinct shingles, prunes those that meet before the
full check of 64 bits; those that agree in fewer than 38 of 64 orders go too; and
what is left is compared by its whole sets of shingles, each text brought once to
its group of candidates. Of pairs at the similarity one in 5,000 is lost before that.

Results: a null or empty text has the fingerprint zero, which links like any
other in `near_duplicates`, and is similar only to other texts without a word; a
text of fewer words than a shingle hashes whole; repeated rows and equal texts
link; a null id never names a component unless no other is in it; an empty table
gives no rows; extra columns are left out of `near_duplicates` and stay in
`drop_near_duplicates`. A very long text needs memory in proportion to its own
length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.buckets import dealt, joins, runs
from tandem.llm.components import connected_components
from tandem.llm.shared import arrow_columns, text_of, written

MAX_DIFFERENT, SHINGLE, SEED = 4, 4, 42
#: Bits of the ring's segments.
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of one key that a single place compares.
BLOCK = 4096
#: Of `drop_near_duplicates`: words of a shingle and similarity; orders by which least shingles are taken, how many of
#: them are keys and how many must agree; bits that two similar texts may differ in.
NEAR_SHINGLE, SIMILARITY, ORDERS, KEYS, AGREE, NEAR_BITS = 5, 0.8, 64, 6, 38, 24
#: Bytes of texts that a single place compares, but for one text that has more.
BLOCK_BYTES = 32 << 20
_U = np.uint64
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, ORDERS, 1), _U)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: only A-Z changes, only ASCII white space splits


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hashes of the shingles, repeats included; fewer words are one shingle, none have none."""
    if not words:
        return np.zeros(0, _U)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = min(shingle, len(words)) - 1
    starts = [0, *(ends[: len(ends) - first - 1] + 1).tolist()]
    return np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[first:].tolist())), _U, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(_U)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The majority bits of the hashes of a text's shingles, repeats included."""
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` of `docs` and `fp`, the fingerprint as a signed number of the same bits."""

    def start(_: str) -> Callable:
        return lambda texts: [pa.array(np.array([fingerprint(x, shingle) for x in texts], _U).view(np.int64))]

    return arrow_columns(docs, text, keep, [T.StructField("fp", T.LongType())], start, "")


def _turned(fp: np.ndarray, by: int) -> np.ndarray:
    """The ring turned so that bit `by` comes first."""
    return (fp >> _U(by)) | (fp << _U(64 - by)) if by else fp


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(_U)
        for start, width in enumerate(WIDTHS):
            near = _turned(fp, sum(WIDTHS[:start]))
            for bit in range(following := WIDTHS[(start + 1) % 5]):
                chain = near & _U(((1 << (width + following)) - 1) ^ (1 << (width + bit)))
                key = chain | _U(((start << 4) | bit) << 26)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places where the chains from `start` and all 64 bits keep within their budgets."""
    different = a ^ b
    at = np.arange(len(a))
    for segments in (3, 4):
        for s in range(5):
            mine = start[at] == s
            bits = sum(WIDTHS[(s + i) % 5] for i in range(segments))
            chain = _turned(different[at], sum(WIDTHS[:s])) & _U((1 << bits) - 1)
            mine &= np.bitwise_count(chain) > segments * MAX_DIFFERENT // 5
            at = at[~mine]
    return at[np.bitwise_count(different[at]) <= MAX_DIFFERENT]


def _on_the_ring(different: np.ndarray, budget: int) -> np.ndarray:
    """Places where chains from some segment keep to their shares of `budget` differing bits, and so do all 64 bits."""
    of_segment = [np.bitwise_count(_turned(different, sum(WIDTHS[:s])) & _U((1 << w) - 1)).astype(np.int64) for s, w in enumerate(WIDTHS)]
    within = np.zeros(len(different), bool)
    for start in range(5):
        chain, keeps = 0, np.ones(len(different), bool)
        for segments in range(1, 5):
            chain = chain + of_segment[(start + segments - 1) % 5]
            keeps &= 5 * chain <= segments * budget
        within |= keeps
    at = np.flatnonzero(within)
    return at[np.bitwise_count(different[at]) <= budget]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints within runs of rows with equal key and block."""

    def done(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        key, fp = (rows.column(c).combine_chunks().to_numpy() for c in ("key", "fp"))
        bits, start = fp.view(_U), (key >> 30) & 7
        pairs = np.array(joins(run, lambda a, b: _linked(bits[a], bits[b], start[a])), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["a", "b"])

    yield from runs(batches, 2, 50_000, done)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) of fingerprints that differ in at most four bits; they connect whatever all such pairs connect."""
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    # A key has no more fingerprints than its first segment alone: only where that has many are keys counted.
    first = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), (F.expr(f"(shiftrightunsigned(fp, {sum(WIDTHS[:i])}) & {(1 << w) - 1})")).alias("v")) for i, w in enumerate(WIDTHS)]))
    many = distinct.select(first.alias("x")).groupBy("x.s", "x.v").count().where(F.col("count") > block)
    hot = None
    if not many.isEmpty():
        hot = written(keys.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / F.lit(block // 2)).alias("n")), "hot-keys")
    placed = dealt(keys, "key", "fp", hot)
    return placed.select("key", "block", "fp").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one a document."""
    marked = written(fingerprints(docs, text, (doc_id,)), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "distinct-fingerprints")
    groups = written(connected_components(links(distinct)).withColumnsRenamed({"id": "fp"}).join(distinct, "fp"), "linked-fingerprints")
    # Written, so that joins with it are between plain tables and Spark can split a component that is very large.
    smallest = written(groups.groupBy("component").agg(F.min("first").alias("least")), "components")
    linked = groups.join(smallest, "component").select("fp", F.col("least").alias("component_id"))
    of_fp = linked.union(distinct.join(groups, "fp", "left_anti").select("fp", F.col("first").alias("component_id")))
    return marked.join(of_fp, "fp").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: candidates by least shingles, pruned on the ring, compared by their sets.


def sketch(text: str) -> tuple[bytes, np.ndarray, int, np.ndarray]:
    """A digest of the words, the distinct shingles' hashes in order, their majority bits, and the least of them by each order, which agree by chance as often as texts are similar."""
    words = words_of(text)
    shingles = np.unique(shingle_hashes(words, NEAR_SHINGLE))
    least = (shingles * (_DRAWN[0] | _U(1)) + _DRAWN[1]).min(1) if len(shingles) else np.zeros(ORDERS, _U)
    return hashlib.md5(b" ".join(words)).digest(), shingles, majority(shingles), least


def sketches(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` of `docs` and of each text `cls` (the digest of its words), `fp`, `keys`, `least` (16 bits of each order) and `bytes`."""

    def start(_: str) -> Callable:
        def make(texts: list[str]) -> list[pa.Array]:
            found = [sketch(x) for x in texts]
            fp = np.array([x[2] for x in found], _U).view(np.int64)
            keys = pa.array([x[3][:KEYS].view(np.int64) for x in found], pa.list_(pa.int64()))
            least = pa.array([x[3].astype(np.uint16).tobytes() for x in found], pa.binary())
            return [pa.array([x[0] for x in found], pa.binary()), pa.array(fp), keys, least, pa.array([len(x) for x in texts], pa.int64())]

        return make

    fields = [T.StructField("cls", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("least", T.BinaryType()), T.StructField("bytes", T.LongType())]
    return arrow_columns(docs, text, keep, fields, start, "")


def _close(fp: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Places of pairs of rows that keep to the ring, differ in few enough bits and agree in enough orders."""
    at = _on_the_ring(fp[a] ^ fp[b], NEAR_BITS)
    agree = [(least[a[part]] == least[b if isinstance(b, int) else b[part]]).sum(1) >= AGREE for part in (at[i : i + 50_000] for i in range(0, len(at), 50_000))]
    return at[np.concatenate(agree)] if agree else at


def candidates(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) of nodes that share a key and are close; they connect whatever all such pairs connect."""
    each = distinct.select(F.posexplode("keys").alias("at", "key"), "fp", "least", "node").select(F.xxhash64("at", "key").alias("key"), "fp", "least", "node")
    hot = written(each.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / F.lit(block // 2)).alias("n")), "hot-least")
    placed = dealt(each, "key", "node", None if hot.isEmpty() else hot)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
            fp, node = (rows.column(c).combine_chunks().to_numpy() for c in ("fp", "node"))
            least = np.frombuffer(b"".join(rows.column("least").to_pylist()), np.uint16).reshape(len(fp), ORDERS)
            pairs = np.array(joins(run, lambda a, b: _close(fp.view(_U), least, a, b)), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

        yield from runs(batches, 2, 50_000, done)

    return placed.select("key", "block", "fp", "least", "node").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(link, "a long, b long")


def similar(texts: list[str], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places that join the texts as all pairs with the similarity or more would."""
    made = [sketch(x) for x in texts]
    values, flat = np.unique(np.concatenate([x[1] for x in made]), return_inverse=True)
    sizes = np.array([len(x[1]) for x in made])
    ends = np.cumsum(sizes)
    fp, least = np.array([x[2] for x in made], _U), np.array([x[3] for x in made]).astype(np.uint16)
    label, out, mine = np.arange(len(texts)), [], np.zeros(len(values), bool)
    for i in range(len(texts) - 1):
        apart = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        apart = apart[np.minimum(sizes[apart], sizes[i]) >= similarity * np.maximum(sizes[apart], sizes[i]) - 1e-9]
        apart = apart[_close(fp, least, apart, i)]
        if not len(apart) or not sizes[i]:
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mine[own] = True
        theirs = mine[np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in apart.tolist()])]
        shared = np.add.reduceat(theirs, np.cumsum(np.r_[0, sizes[apart][:-1]]), dtype=np.int64)
        mine[own] = False
        for j in apart[shared >= similarity * (sizes[apart] + sizes[i] - shared) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def similar_nodes(distinct: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows (node, component) of the nodes that are similar to others. `distinct` has node, fp, keys, least, bytes and the `key` of a text of `texts` (key, text)."""
    near = written(connected_components(candidates(distinct, block)).withColumnRenamed("id", "node").join(distinct.select("node", "key", "bytes"), "node"), "candidates")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block // 2)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES // 2)))
    hot = written(near.groupBy("component").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"), blocks.alias("n")).where((F.col("count") > block) | (F.col("bytes") > BLOCK_BYTES)).select("component", "n"), "hot-candidates")
    placed = dealt(near.join(texts, "key"), "component", "node", None if hot.isEmpty() else hot)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
            node, pairs = rows.column("node").combine_chunks().to_numpy(), []
            for first, end in pairwise([*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(run)]):
                pairs += [(first + a, first + b) for a, b in similar(rows.column("text").slice(first, end - first).to_pylist(), similarity)]
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

        yield from runs(batches, 2, 0, done)

    found = placed.select("component", "block", "node", "text").repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(link, "a long, b long")
    return connected_components(found).withColumnRenamed("id", "node")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, in the columns of `docs`: that with the smallest id, null ids last.

    Groups are what pairs of texts whose five-word shingles have the `similarity` or more connect. Of a group's texts with
    that same id it is the one with the smallest digest; of rows equal in both id and text any one.
    """
    the_id, digest = F.col(f"`{doc_id}`"), F.md5(text_of(F.col(f"`{text}`")).cast("binary"))
    key = F.when(the_id.isNull(), digest).otherwise(F.concat(digest, the_id.cast("string")))  # a digest has always the same length
    plain = docs.select(the_id.alias("id"), text_of(F.col(f"`{text}`")).alias("text"), key.alias("key"))
    marked = written(sketches(plain, "text", ("id", "key")), "sketches")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")
    distinct = marked.groupBy("cls").agg(first, *[F.any_value(c).alias(c) for c in ("fp", "keys", "least", "bytes")])
    # Numbers that hold once they are written: any that tell texts apart will do.
    distinct = written(distinct.drop("cls").withColumns({"key": F.col("first.key"), "node": F.monotonically_increasing_id()}), "distinct-texts")
    # Repeated rows go before the join: they sum up before the shuffle that both then share.
    groups = similar_nodes(distinct, plain.select("key", "text").dropDuplicates(["key"]), similarity)
    stay = written(distinct.select("node", "first").join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key")), "survivors")
    return docs.withColumn("__key", key).dropDuplicates(["__key"]).join(stay, "__key", "left_semi").select(*[f"`{c}`" for c in docs.columns])
