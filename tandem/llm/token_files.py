"""Operator 7: token ids in Arrow stream files of fixed-size-list batches.

Documents are range-partitioned and sorted by id; each partition is encoded by
the tokenizers library and written as one shard: an Arrow IPC stream whose rows
are sequences of exactly `length` ids in the smallest unsigned type that holds
the vocabulary, beside a mask of equal length that is false only on the filling
at a shard's end. Every row has the same width and every block but a shard's last
the same number of rows, so `Shard.row` finds row i of a mapped shard without
reading another and without a copy. A second stream beside it
lists each document's place in the shard. A task writes under a name of its own
attempt and returns it; only names in the written manifest count, so a task that
runs again leaves a file that nobody reads.

Pieces between spaces repeat: a worker remembers the library's ids of short ones
and asks the library for the rest at once.

Results: a null text is the empty text and gives the end id alone; documents with
equal ids follow each other in the order of their texts' hash; repeated rows are
repeated in the files; null ids come first; an empty table gives no rows; extra
columns are left out, whatever their names.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.shared import batches_of, by_bytes, local_text, shared_dir, text_of
from tandem.llm.token_counts import splits_safely

MANIFEST = "shard int, ids_path string, index_path string, n_docs long, n_tokens long"
#: Rows in a written block.
BLOCK_ROWS = 512
#: Pieces up to this many characters are remembered, and about so many of them in a worker.
REMEMBER_CHARS, REMEMBER = 32, 500_000
#: Documents that a task takes at once.
ROWS = 1024
_SPACES = re.compile(r" (?:\s|$)|\s ")
_RARE = re.compile(r"[^\S \n]")
_encoders: dict[str, LibraryEncoder] = {}


def single_spaced(text: str) -> bool:
    """Whether each space stands between characters that aren't white space."""
    if _RARE.search(text):
        return not _SPACES.search(text)
    return "  " not in text and " \n" not in text and "\n " not in text and text[-1:] != " "


class LibraryEncoder:
    """The ids that the tokenizers library gives, with a memory of short space-separated pieces.

    A single space between other characters always starts a pre-token, so the
    ids of a text are those of its pieces, each taken with the space before it.
    Missing pieces are encoded together: in a byte-level vocabulary, the ids that
    start with a space are exactly the first ones of each piece. Texts with a
    space next to other white space are encoded whole.
    """

    def __init__(self, file_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        by_id = {i: x for x, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.size = max(by_id) + 1
        self.starts = np.array([by_id.get(i, "").startswith("\u0120") for i in range(self.size)])
        self.pieces = splits_safely(file_text)
        self.marks = {x: np.array(self._whole([x])[0], np.uint32).tobytes() for x in ",."} if self.pieces else {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece with a space before it, as bytes."""
        ids = np.array(self._whole([" " + " ".join(pieces)])[0], np.uint32)
        cuts = np.flatnonzero(self.starts[ids])
        assert len(cuts) == len(pieces)
        flat, cuts = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn(self, pieces: list[str]) -> None:
        """Remembers pieces. A letter and then a comma or full stop at the end are two pre-tokens, so the word alone is looked up."""
        known = self.known
        marked = [x for x in pieces if x[-1:] in self.marks and x[-2:-1].isalpha()]
        words = {*pieces}.difference(marked).union(x[:-1] for x in marked).difference(known)
        if words:
            words = [*words]
            known.update(zip(words, self._spaced(words)))
        known.update((x, known[x[:-1]] + self.marks[x[-1]]) for x in marked)

    def _values(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from memory or else from the library."""
        if len(self.known) > REMEMBER // 2:  # pieces not asked for since the last time are forgotten
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = [x for x in pieces if x not in known]
        if older:
            known.update((x, older[x]) for x in missing if x in older)
            missing = [x for x in missing if x not in known]
        if missing:
            self._learn(missing)
        out = [*map(known.__getitem__, pieces)]
        for piece in missing:
            if len(piece) > REMEMBER_CHARS:
                del known[piece]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one text after the other, and how many each has.

        Pieces are told apart by Arrow, so that Python sees each piece of a batch
        once. A text is a row of entries: its first piece, which has no space before
        it, then numbers of distinct pieces; or one entry if it is encoded whole.
        """
        texts = column.to_pylist()
        plain = np.array([self.pieces and single_spaced(x) for x in texts], bool)
        lists = pc.split_pattern(column.filter(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy()
        is_head = np.zeros(offsets[-1], bool)
        is_head[offsets[:-1]] = True
        pieces = lists.flatten()
        heads = self._whole(pieces.filter(pa.array(is_head)).to_pylist())
        numbered = pieces.filter(pa.array(~is_head)).dictionary_encode()
        values = self._values(numbered.dictionary.to_pylist())
        whole = self._whole([x for x, p in zip(texts, plain) if not p])
        sizes = np.array([*(len(x) // 4 for x in values), *map(len, heads), *map(len, whole)], np.int64)
        table = np.frombuffer(b"".join(values) + np.array([*chain.from_iterable(heads), *chain.from_iterable(whole)], np.uint32).tobytes(), np.uint32)
        at = np.cumsum(sizes) - sizes

        n_entries = np.ones(len(texts), np.int64)
        n_entries[plain] = np.diff(offsets)
        spaced = np.zeros(len(is_head), np.int64)
        spaced[~is_head] = numbered.indices.to_numpy()
        spaced[is_head] = len(values) + np.arange(len(heads))
        entries = np.empty(n_entries.sum(), np.int64)
        of_plain = np.repeat(plain, n_entries)
        entries[of_plain] = spaced
        entries[~of_plain] = len(values) + len(heads) + np.arange(len(whole))
        each = sizes[entries]
        ends = np.cumsum(each)
        places = np.repeat((at[entries] - (ends - each)).astype(np.int32), each)
        places += np.arange(len(places), dtype=np.int32)
        return table[places], np.diff(np.r_[0, ends[np.cumsum(n_entries) - 1]])


def _encoder(file_text: str) -> LibraryEncoder:
    key = sha256(file_text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(file_text)
    return _encoders[key]


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, file_text: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(file_text)
    biggest = max(encoder.size, end_id + 1)
    kind = pa.uint16() if biggest <= 1 << 16 else pa.uint32()
    rows = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
    index = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    shard = TaskContext.get().partitionId()
    name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}"
    held, n_held, n_docs, n_tokens = [], 0, 0, 0

    def block(flat: np.ndarray, real: int) -> pa.RecordBatch:
        mask = np.arange(len(flat)) < real
        return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(kind.to_pandas_dtype())), type=rows.field(0).type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=rows.field(1).type)], schema=rows)

    with store.open_output_stream(f"{name}.ids.arrows") as a, store.open_output_stream(f"{name}.index.arrows") as b:
        with pa.ipc.new_stream(a, rows) as ids_out, pa.ipc.new_stream(b, index) as index_out:
            for batch in (part for whole in batches for part in by_bytes(whole)):
                ids, sizes = encoder.encode(batch.column(1))
                held.append(np.insert(ids, np.cumsum(sizes), np.uint32(end_id)))
                sizes = sizes + 1
                index_out.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n_tokens + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=index))
                n_held, n_docs, n_tokens = n_held + int(sizes.sum()), n_docs + len(sizes), n_tokens + int(sizes.sum())
                if n_held >= BLOCK_ROWS * length:
                    flat = np.concatenate(held)
                    full = len(flat) // (BLOCK_ROWS * length) * BLOCK_ROWS * length
                    for i in range(0, full, BLOCK_ROWS * length):
                        ids_out.write_batch(block(flat[i : i + BLOCK_ROWS * length], BLOCK_ROWS * length))
                    held, n_held = [flat[full:]], len(flat) - full
            if n_held:
                flat = np.concatenate(held)
                ids_out.write_batch(block(np.concatenate([flat, np.zeros(-len(flat) % length, np.uint32)]), len(flat)))
    if n_docs:
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids_path": f"{name}.ids.arrows", "index_path": f"{name}.index.arrows", "n_docs": n_docs, "n_tokens": n_tokens}], schema=pa.schema([("shard", pa.int32()), ("ids_path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = 1024) -> DataFrame:
    """Writes the shards below `folder` and returns their manifest: a table with one row a shard and its `start` in the whole."""
    spark = docs.sparkSession
    file_text = spark.sparkContext.broadcast(local_text(tokenizer_path))
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    with batches_of(spark, ROWS):
        ordered.mapInArrow(lambda batches: _write_shard(batches, f"{folder}/shards", file_text.value, end_id, length), MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row a shard, so this one small window is over as many rows as there are files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(folder)
    for shard in (x for batch in batches for x in batch.to_pylist()):
        with store.open_input_stream(shard["ids_path"]) as a, store.open_input_stream(shard["index_path"]) as b:
            ids, places = pa.ipc.open_stream(a), pa.ipc.open_stream(b)
            held, at = np.zeros(0, "<u4"), 0
            for listed in places:
                for part in (listed.slice(i, 2000) for i in range(0, listed.num_rows, 2000)):
                    place, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                    pieces, have = [held[place[0] - at :]], at + len(held)
                    while have < place[-1] + n[-1]:
                        rows = ids.read_next_batch()
                        pieces.append(rows.column(0).flatten().to_numpy().astype("<u4"))
                        have += len(pieces[-1])
                    held, at = np.concatenate(pieces), int(place[0])
                    yield pa.record_batch([part.column(0), pa.array(place + shard["start"]), pa.array(n), pa.array([zlib.crc32(held[p - at : p - at + k]) for p, k in zip(place, n)], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: a row a document with its start in the whole, its number of ids and their CRC-32."""
    # As many places as shards, given by number: else Spark would gather these few small rows in one task.
    return manifest.select("shard", "ids_path", "index_path", "start").repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(partial(_read_shards, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


class Shard:
    """A shard of ids mapped from a local path: rows by number, as views of the file."""

    def __init__(self, path: str):
        self.file = pa.memory_map(path)
        stream = pa.ipc.open_stream(self.file)
        self.schema, self.first = stream.schema, self.file.tell()
        stream.read_next_batch()
        self.step = self.file.tell() - self.first

    def row(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of sequence i and its mask."""
        block, k = divmod(i, BLOCK_ROWS)
        self.file.seek(self.first + block * self.step)
        rows = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        return rows.column(0)[k].values.to_numpy(), rows.column(1)[k].values


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes `docs` to a new shared folder and reads the files back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, **options), folder)
