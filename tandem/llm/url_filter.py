"""Operator 6: URL filters by a cascade of Bloom filters, in DataFrame functions only.

The first level holds the listed keys that occur in the corpus. The second holds
the corpus's other keys that pass the first, the third the listed keys that pass
the second, and so on in turn until no key passes wrongly. Every key of the
corpus's complete universe then leaves the cascade at a level whose parity tells
whether it is listed: exact membership, and no join of the pages with the list.

The first level's rate of wrong passes is set from the exact numbers of listed
and other keys, the others' is a half, so that all levels take a few bits for
each listed key, times the logarithm of how many others there are for each. That
size is known before a level is built. A level is one binary constant, stated once
in the plan of the pages and shipped with the tasks. Where all levels together
would pass `MAX_BYTES`, keys are dealt by a hash into as many cascades as keep
below it, and the pages pass one after another: the method stays the same.

Results: a null url or one without `://` has an empty host and path, which no
rule and no list fits: it is allowed; null list entries count for nothing; an
empty list blocks nothing; repeated rows get the same verdict; an empty table
gives no rows; extra columns stay, but for those named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.shared import text_of, written

#: Bytes of one cascade's levels together: what a plan may carry.
MAX_BYTES = 64 << 20
#: Bits in a byte of a level, so that each byte is an ASCII character, and bytes that a row of a level has when it is built.
BITS, CHUNK = 7, 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, else the empty text."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def domains(host: Column) -> Column:
    """The host and each domain above it: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


class Cascade:
    """The levels: for each its number of bits, of probes, and its bytes."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    def _passes(self, key: Column, level: int) -> Column:
        bits, probes, data = self.levels[level]

        def probed(words: Column) -> Column:
            out = F.lit(True)
            for place in _places(key, bits, probes, level):
                byte = F.ascii(F.substring(words, (F.floor(place / BITS) + 1).cast("int"), F.lit(1)).cast("string"))
                out = out & (F.getbit(byte, (place % BITS).cast("int")) == 1)
            return out

        # Through a function's argument, so that the constant stands in the plan once, however many probes there are.
        return F.element_at(F.transform(F.array(F.lit(data)), probed), 1)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def _places(key: Column, bits: int, probes: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + i)), F.lit(bits)) for i in range(probes)]


def _level(keys: DataFrame, n: int, rate: float, number: int) -> tuple[int, int, bytes]:
    """A Bloom filter of the `n` keys, built as a grouped union of bits, which comes to the driver in chunks of its known size."""
    probes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * probes / math.log(2)))
    place = F.explode(F.array(*_places(F.col("key"), bits, probes, number)))
    some = keys.select(place.alias("p")).select(F.floor(F.col("p") / BITS).alias("at"), F.expr(f"shiftleft(1, cast(p % {BITS} as int))").alias("bits"))
    none = keys.sparkSession.range(bits // BITS + 1).select(F.col("id").alias("at"), F.lit(0).alias("bits"))
    each = some.union(none).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda x: F.char(x["bits"])), "")
    rows = each.groupBy(F.floor(F.col("at") / CHUNK).alias("chunk")).agg(text.cast("binary").alias("data")).collect()
    return bits, probes, b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.chunk))


def _size(n_in: int, n_out: int) -> tuple[float, float]:
    """The first level's rate of wrong passes, and bytes that all levels take, at most but for chance."""
    rate = min(0.5, max(1e-9, n_in / (2 * n_out or 1)))
    # Each later level holds half of what the one two before it held, or what passed the one before: together fewer than four bits a listed key.
    return rate, n_in * (max(1, round(-math.log2(rate))) + 4) / math.log(2) / BITS


def _cascade(known: DataFrame, n_in: int, n_out: int) -> Cascade:
    inside, outside, levels = known.where("listed"), known.where("listed is null"), []
    while n_in:
        rate = _size(n_in, n_out)[0] if not levels else 0.5
        levels.append(_level(inside, n_in, rate, len(levels)))
        passing = outside.where(Cascade(levels)._passes(F.col("key"), len(levels) - 1))
        inside, outside = passing, inside
        n_in = inside.count()
    return Cascade(levels)


def build_cascades(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> list[Cascade]:
    """The cascades over the distinct keys of `universe` (a column `key`): that of a key by `shard`, each of about `max_bytes` at most."""
    known = written(universe.where("key is not null").distinct().join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left"), "url-keys")
    numbers = known.agg(F.count("listed"), F.count("*")).first()
    n = max(1, math.ceil(_size(numbers[0], numbers[1] - numbers[0])[1] / max_bytes))
    counted = {r.s: (r.listed, r.every - r.listed) for r in known.groupBy(shard(F.col("key"), n).alias("s")).agg(F.count("listed").alias("listed"), F.count("*").alias("every")).collect()}
    return [_cascade(known.where(shard(F.col("key"), n) == s), *counted.get(s, (0, 0))) for s in range(n)]


def shard(key: Column, n: int) -> Column:
    """Which of `n` cascades a key belongs to."""
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n))


def fitting_rule(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """The longest of the rules `host/path` that fits, of equally long ones that with the longer host; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r), -r.index("/"), r))
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, block_rules: Iterable[str], allow_rules: Iterable[str], listed: DataFrame, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """`pages` with host, path, rule and verdict: the rule's, else block if the host or a domain above it is `listed` (a column `key`)."""
    block, allow = set(block_rules), set(allow_rules)
    rest = [f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*rest, url_host(text_of(url)).alias("host"), url_path(text_of(url)).alias("path"))
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), block | allow))
    universe = judged.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    cascades = build_cascades(universe, listed, max_bytes)
    is_listed = F.lit(False)
    for s, cascade in enumerate(cascades):
        if s:  # the plan carries one cascade at a time
            judged, is_listed = written(judged.withColumn("__listed", is_listed), "judged-urls"), F.col("__listed")
        if cascade.levels:
            keys = domains(F.col("host"))
            mine = keys if len(cascades) == 1 else F.filter(keys, lambda key: shard(key, len(cascades)) == s)
            is_listed = is_listed | F.exists(mine, cascade.contains)
    ruled = F.when(F.col("rule").isin(*block), "block").when(F.col("rule").isNotNull(), "allow")
    verdict = F.coalesce(ruled, F.when(is_listed, "block").otherwise("allow"))
    return judged.select(*rest, "host", "path", "rule", verdict.alias("verdict"))
