"""Operator 10: quality rules, lines first.

Each line with a word is judged by itself; failing lines go; a document that
loses more than `MAX_LOST` percent of its words goes as a whole. A line fails if

* symbols: it has more than one character of SYMBOLS for every two words;
* punctuation: it has four words or more and no sentence mark, or doubled
  exclamation or question marks after more than a quarter of its words;
* navigation: it has three separators or more, and four words or fewer for each
  of the parts between them;
* boilerplate: it has at most 40 words and one of PHRASES.

A document also goes if its base counts fail: fewer than 10 words, or more than
a fifth of its words in five-word windows that occur twice.

Results: a null or empty text has no words and goes; an empty table gives no rows; repeated rows are judged
alike; extra columns pass through `clean` unread. A very long text needs memory
in proportion to its own length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.shared import arrow_columns

MIN_WORDS, MAX_REPEATED, MAX_LOST = 10, 20, 50
SYMBOLS, MARKS, SHOUTS, SEPARATORS = r"[#*$%&|<>{}~^=\\]", r"[.!?:;…。！？।؟]", r"!!|\?\?", r"[|»›•·]"
#: Lower-case phrases of lines that belong to a site rather than a text.
PHRASES = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "click here", "read more", "sign up for", "subscribe to our", "share this", "skip to content", "log in to", "lorem ipsum")
_SYMBOL, _MARK, _SHOUT, _SEPARATOR = map(re.compile, (SYMBOLS, MARKS, SHOUTS, SEPARATORS))
_PHRASE = re.compile("|".join(PHRASES).encode())
_BASE_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\v\f\r"


def line_fails(line: str, n_words: int) -> bool:
    """The verdict on a line with `n_words` words, at least one."""
    if 2 * len(_SYMBOL.findall(line)) > n_words or (n_words >= 4 and not _MARK.search(line)) or 4 * len(_SHOUT.findall(line)) > n_words:
        return True
    separators = len(_SEPARATOR.findall(line))
    if separators >= 3 and n_words <= 4 * (separators + 1):
        return True
    return n_words <= 40 and bool(_PHRASE.search(line.encode().lower()))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of five that occur twice or more."""
    if len(words) < width + 1:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    at, many, n = ids[: len(ids) - width + 1].copy(), len(numbers), len(ids) - width + 1
    for k in range(1, width):
        at = at * many + ids[k : k + n]
        if k < width - 1:
            at = np.unique(at, return_inverse=True)[1]  # dense again: no overflow
    _, where, times = np.unique(at, return_inverse=True, return_counts=True)
    starts = times[where] > 1
    if not starts.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += starts
    edge[width:] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost words, text of the lines left."""
    words = text.encode().split()  # of bytes, so only ASCII white space splits
    seen, n_dup, lost, left = set(), 0, 0, []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            n_dup += line in seen
            seen.add(line)
            if line_fails(line, n):
                lost += n
                continue
        left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    kept = not failed and 100 * lost <= MAX_LOST * len(words)
    return len(words), len(text) - sum(map(text.count, _SPACES)), len(_BASE_SYMBOL.findall(text)), n_dup, repeated, failed, kept, lost, "\n".join(left)


_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("lost_words", T.LongType())]
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]


def _verdicts(_: str) -> Callable:
    def columns(texts: list[str]) -> list[pa.Array]:
        rows = [judge(x) for x in texts]
        return [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(_TYPES)]

    return columns


def _texts_left(_: str) -> Callable:
    """The text of the lines left, null if the document goes."""
    return lambda texts: [pa.array([x[8] if x[6] else None for x in map(judge, texts)], pa.string())]


def judged(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` with the counts and the verdict on each whole text."""
    return arrow_columns(docs, text, keep, _FIELDS, _verdicts, "")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, in the columns of `docs`, with the text (and n_chars) of the lines left."""
    keep = tuple(c for c in docs.columns if c != text)
    left = arrow_columns(docs, text, keep, [T.StructField("__left", T.StringType())], _texts_left, "").where("__left is not null")
    changed = {text: F.col("__left")} | ({"n_chars": F.length("__left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in keep else {})
    return left.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
