"""Operator 5: byte-level BPE encoding and decoding.

A pre-token's bytes become a doubly linked list of symbols. A priority queue
holds the merge rank and place of each adjacent pair that can merge; the lowest
rank is merged first, at equal ranks the leftmost. An entry whose pair has
changed since is stale and skipped. Decoding concatenates vocabulary strings.

Results: a null text counts as the empty text, which has no ids and decodes to
the empty text; other columns pass through or are left out, whatever their
names; repeated rows give repeated results; an empty table gives no rows. Very long texts take time in
proportion to n log n of their longest pre-token and memory in proportion to
their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import partial
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.shared import arrow_columns, local_text

#: Fixed: the pattern that splits text before byte-level merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this many characters are remembered, and so many of them in a worker.
REMEMBER_CHARS, REMEMBER = 32, 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def newer_letters() -> str:
    """Ranges of letters and numbers newer than this Python's Unicode tables, as inside a character class.

    The tokenizers library takes them as unassigned, the regex module as letters.
    """
    points = [ord(x) for x in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))) if unicodedata.category(x) == "Cn"]
    starts = [x for x, last in zip(points, [-2, *points]) if x != last + 1]
    ends = [x for x, following in zip(points, [*points[1:], -2]) if following != x + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Codec:
    """Encodes and decodes with the vocabulary and merges of one tokenizer file's text."""

    def __init__(self, file_text: str):
        data = json.loads(file_text)
        vocab, letters = data["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        #: pair of ids -> rank and the merged id, both in one number
        self.merges = {(vocab[a] << 20) | vocab[b]: (r << 20) | vocab[a + b] for r, (a, b) in reversed([*enumerate(merges)])}
        of_letter = {x: b for b, x in letters.items()}
        strings = {i: bytes(of_letter[x] for x in s) for s, i in vocab.items() if i not in self.special.values()}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.decimal = [*map(str, range(len(self.strings)))]
        self.split = regex.compile(SPLIT)
        newer = newer_letters()
        self.newer = re.compile(f"[{newer}]") if newer else None
        self.older = regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{newer}]|[^\s\p{{L}}\p{{N}}])").replace(r"?\p{L}+", rf"?[\p{{L}}--[{newer}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{newer}]]+"), regex.V1) if newer else self.split
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: pre-token -> its ids as unsigned 32-bit integers
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # the quickest way to see that there are no newer letters
        except UnicodeEncodeError:
            if self.newer and self.newer.search(text):
                return self.older.findall(text)
        return self.split.findall(text)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token's bytes."""
        of_byte, get = self.of_byte, self.merges.get
        ids = [of_byte[b] for b in data]
        n = len(ids)
        if n == 1:
            return ids
        # In the queue: (rank, merged id, place) in one number; ids in the list: -1 where a symbol is gone and at the end, which no pair holds.
        queue = [(m << 32) | i for i, m in enumerate(map(get, [(a << 20) | b for a, b in zip(ids, ids[1:])])) if m is not None]
        if not queue:
            return ids
        heapify(queue)
        ids.append(-1)
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        while queue:
            entry = heappop(queue)
            i, m = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if get((ids[i] << 20) | ids[j]) != m:
                continue  # stale
            ids[i] = new = m & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            before[k] = i
            m = get((new << 20) | ids[k])
            if m is not None:
                heappush(queue, (m << 32) | i)
            h = before[i]
            m = get((ids[h] << 20) | new)
            if m is not None:
                heappush(queue, (m << 32) | h)
        return [x for x in ids if x >= 0]

    def _missing(self, token: str) -> bytes:
        ids = self.before.get(token) or array("I", self.merge(token.encode())).tobytes()
        if len(token) <= REMEMBER_CHARS:
            if len(self.known) >= REMEMBER // 2:  # pre-tokens not asked for since the last time are forgotten
                self.before, self.known = self.known, {}
            self.known[token] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join([self.known.get(x) or self._missing(x) for x in self.pre_tokens(text)])

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as unsigned 32-bit integers; special strings in it are special tokens."""
        if not self.at_special or not self.at_special.search(text):
            return self._plain(text)
        out, start = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[start : m.start()]), array("I", [self.special[m[0]]]).tobytes()
            start = m.end()
        return b"".join(out) + self._plain(text[start:])

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return np.frombuffer(self.packed(text), np.uint32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(file_text: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    key = sha256(file_text.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file_text)
    return _codecs[key]


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns `keep` of `df` with the ids of its texts, and with the text decoded from the ids if `decoded` names a column."""
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def columns(codec: Codec, texts: list[str]) -> list[pa.Array]:
        got = [codec.encode(x) for x in texts]
        return [pa.array(got, pa.list_(pa.field("element", pa.int32(), False)))] + ([pa.array(map(codec.decode, got), pa.string())] if decoded else [])

    return arrow_columns(df, text, keep, extra, lambda file_text: partial(columns, codec_of(file_text)), local_text(tokenizer_path))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns `keep` of `df` and the ids of its whole texts."""
    return encode_decode(df, tokenizer_path, text, keep, ids)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of `df` and the text that its ids stand for; null ids decode to the empty text."""
    ids_or_none = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return arrow_columns(df, ids_or_none, keep, [T.StructField(text, T.StringType())], lambda file_text: lambda rows: [pa.array(map(codec_of(file_text).decode, rows), pa.string())], local_text(tokenizer_path))


def digests(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row of `df` the number of ids, and SHA-256 of the ids and of the text decoded from them."""
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def columns(codec: Codec, texts: list[str]) -> list[pa.Array]:
        out = []
        for ids in map(codec.encode, texts):
            listed = ",".join(map(codec.decimal.__getitem__, ids))
            out.append((len(ids), sha256(listed.encode()).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*out) if out else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return arrow_columns(df, text, keep, extra, lambda file_text: partial(columns, codec_of(file_text)), local_text(tokenizer_path))
