"""Operator 9: token counts.

Texts are encoded in batches inside Arrow functions that give back lengths only.
A batch holds about `batch_bytes` of text, so short and long texts cost alike;
a longer text is split before white space that follows another character. No
pre-token of the byte-level pattern crosses such a place and no special string
holds white space, so the parts' counts add up to the whole text's. A stretch
without such a place stays whole. The pieces between all such places of a batch
repeat: a worker remembers the library's counts of short ones and asks the
library for the rest of a batch at once. Other kinds of tokenizer (other pre-tokenizers,
sentencepiece models) may look across white space: their texts stay whole.

Results: a null text counts as the empty text, with no tokens; repeated rows give
repeated results; an empty table gives no rows; extra columns are left out,
whatever their names. A text or stretch that can't be split needs memory in
proportion to its length, and a stretch without white space the library's time for
one pre-token of that length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.shared import arrow_columns, text_of

_loaded: dict[str, Callable] = {}
_BREAK = regex.compile(r"(?<=\S)(?=[ \t\n\r])")
#: The pieces between all breaks of a text that holds no other white space.
_PIECES, _RARE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"), re.compile(r"[^\S \t\n\r]")
#: Pieces up to this many characters are remembered, and about so many of them in a worker.
REMEMBER_CHARS, REMEMBER = 32, 1_000_000


def splits_safely(file_text: str) -> bool:
    """Whether a tokenizer file is byte-level with the pattern whose pre-tokens never cross the start of white space."""
    data = json.loads(file_text)
    pre = data.get("pre_tokenizer") or {}
    special = [t["content"] for t in data.get("added_tokens", [])]
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not data.get("normalizer") and not any(regex.search(r"\s", x) for x in special) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in data.get("added_tokens", []))


def parts(text: str, size: int) -> list[str]:
    """Parts of about `size` characters, cut only at safe places; together they are the text."""
    out, start = [], 0
    while len(text) - start > size and (m := _BREAK.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def remembering(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """`count` for texts that may be split safely, which is asked for each new piece once; texts with rare white space are pieces as they are."""
    known: dict[str, int] = {}
    older: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        nonlocal known, older
        if len(known) >= REMEMBER // 2:  # pieces not asked for since the last time are forgotten
            older, known = known, {}
        pieces = [[x] if _RARE.search(x) else _PIECES.findall(x) for x in texts]
        missing = set(chain.from_iterable(pieces)).difference(known)
        known.update((x, older[x]) for x in missing if x in older)
        if missing := [*missing.difference(known)]:
            known.update(zip(missing, count(missing)))
        out = [sum(map(known.__getitem__, x)) for x in pieces]
        for x in missing:
            if len(x) > REMEMBER_CHARS:
                del known[x]
        return out

    return counts


def _counter(kind: str, data: bytes, batch_bytes: int) -> Callable[[list[str]], list[int]]:
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        count, size = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), None
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        count = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = batch_bytes if splits_safely(data.decode()) else None
        count = remembering(count) if size else count

    def lengths(texts: list[str]) -> list[int]:
        out, batch, owners, held = [0] * len(texts), [], [], 0

        def flush() -> None:
            for owner, n in zip(owners, count(batch) if batch else []):
                out[owner] += n
            batch.clear()
            owners.clear()

        for i, text in enumerate(texts):
            n_bytes = len(text.encode())
            # Characters that make up about as many bytes as a batch holds.
            whole = not size or n_bytes <= size
            for part in [text] if whole else parts(text, max(1, size * len(text) // n_bytes)):
                batch.append(part)
                owners.append(i)
                held += n_bytes if whole else len(part.encode())
                if held >= batch_bytes:
                    flush()
                    held = 0
        flush()
        return out

    return lengths


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 16) -> DataFrame:
    """The columns `keep` of `df` and n_bytes and n_tokens of its whole texts."""
    kind = tokenizer_path.rpartition(".")[2]
    with open(tokenizer_path, "rb") as f:
        data = f.read()

    def start(fixed: bytes) -> Callable:
        key = f"{kind} {batch_bytes} {sha256(fixed).hexdigest()}"
        if key not in _loaded:
            _loaded[key] = _counter(kind, fixed, batch_bytes)
        return lambda texts: [pa.array(_loaded[key](texts), pa.int64())]

    sized = df.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("__text"))
    return arrow_columns(sized, "__text", (*keep, "n_bytes"), [T.StructField("n_tokens", T.LongType())], start, data)
