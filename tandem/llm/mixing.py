"""Operator 4: mixing sources to target weights.

Each document gets a key drawn from a hash of the seed and its id. Within its
source, documents are sorted by that key in ranges of the key's leading digits:
one range holds about `RANGE_ROWS` documents, however large its source. A range
that many rows of one id or of no id fill is split further by a hash of their
contents. Sums of
the ranges, added up range by range, give each document the size of all that
come before it, and each source is cut at its exact budget: as many whole epochs
as fit, and of one more the documents up to the budget, the last of them in part.

Results: a null text has size 0; null is a source of its own; sources of size 0
get nothing; documents with equal keys go by id, then size; rows equal in id and
text are told apart by nothing and share a range, and which of them is cut is not
defined, only how much; null ids come first; an empty table gives no rows; extra columns pass through `mix` unread
and are left out of `mixed_amounts`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.shared import WORD, text_of, written

WEIGHTS = (5, 2, 1)
#: A target is at most this many times the size of its source.
EPOCHS = 3
RANGE_ROWS = 8_192


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Rows (source, source_size) with each source's `target` of 100 % of all sizes.

    A source is full when the share for its weight passes `epochs` times its size.
    In the order of that ratio, the full ones come first: with what they take set
    apart, the others share the rest by weight. The windows are over one row a source.
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("__weight", weight).withColumn("__ratio", epochs * F.col("source_size") / F.col("__weight"))
    order, every = Window.orderBy("__ratio", "__rank"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("__share", left / weights_left).withColumn("__full", F.col("__share") >= F.col("__ratio"))
    level = F.min_by("__share", F.when(~F.col("__full"), F.struct("__ratio", "__rank"))).over(every)
    target = F.when(F.col("__full"), (epochs * F.col("source_size")).cast("double")).otherwise(level * F.col("__weight"))
    return shared.select("source", "source_size", target.alias("target"))


def words_in(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _taken(sized: DataFrame, seed: str, weights: tuple[int, ...], epochs: int, *extra: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (doc_id, source, `extra`, size) with the source's size and target and the amount taken; `sized` has a hash of the content, `__tag`."""
    n = sized.count()
    digits = max(0, math.ceil(math.log(max(1, n / range_rows), 16)))
    keyed = sized.withColumn("__key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("__range", F.substring("__key", 1, digits))
    # Keys of distinct ids fill ranges evenly; one far above the mean holds rows of one id, or of none.
    hot = keyed.groupBy("source", "__range").count().where(F.col("count") > 4 * range_rows)
    hot = written(hot.select(F.col("source").alias("h_source"), F.col("__range").alias("h_range"), F.ceil(F.log(16.0, F.col("count") / range_rows)).cast("int").alias("__more")), "hot-ranges")
    if not hot.isEmpty():
        keyed = keyed.join(hot, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("__range") == F.col("h_range")), "left").drop("h_source", "h_range")
        within = F.substring(F.md5(F.concat(F.lit(seed), F.col("__tag").cast("string"))), F.lit(1), F.coalesce("__more", F.lit(0)))
        keyed = keyed.withColumn("__range", F.concat("__range", within)).drop("__more")
    within = Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "size", "__tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    ranges = keyed.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, epochs)
    starts = ranges.withColumn("__outer", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    starts = starts.alias("s").join(targets.alias("t"), same).select("s.source", "__range", "__outer", "source_size", "target")
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.__range") == F.col("s.__range"))
    joined = placed.alias("p").join(starts.alias("s"), same)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__inner") - F.col("__outer")))
    return joined.select("doc_id", "p.source", *extra, "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def mixed_amounts(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, text: str = "text") -> DataFrame:
    """For each document its size in words, its source's size and target, and the words that the mix takes of it."""
    sized = written(docs.select("doc_id", "source", words_in(text).alias("size"), F.xxhash64(text).alias("__tag")), "sizes")
    return _taken(sized, seed, weights, epochs)


def mix(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents in the columns of `docs`: a row for each time a document is taken, the last perhaps with its first words only.

    Documents of no words aren't taken; `n_chars` of a document cut short is that of the words left.
    """
    tag = F.xxhash64(*[f"`{c}`" for c in docs.columns])
    sized = written(docs.select("doc_id", "source", words_in().alias("size"), tag.alias("__tag")), "sizes")
    amounts = _taken(sized, seed, weights, epochs, "__tag").groupBy("doc_id", "__tag").agg(F.sum("taken").alias("taken"), F.first("size").alias("size")).where("taken > 0")
    # A plain key, so that dropping repeats and joining share one shuffle of the texts.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("__key")
    texts = docs.select("*", tag.alias("__tag"), key).dropDuplicates(["__key", "__tag"]).alias("d")
    amounts = amounts.withColumn("__key", key)
    same = (F.col("d.__key") == F.col("a.__key")) & (F.col("d.__tag") == F.col("a.__tag"))
    rest = F.col("a.taken") % F.col("a.size")
    whole = F.array_repeat("a.size", F.floor(F.col("a.taken") / F.col("a.size")).cast("int"))
    times = F.explode(F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))))
    rows = texts.join(amounts.alias("a"), same).select("d.*", F.col("a.size").alias("__size"), times.alias("__part"))
    cut = F.col("__part") < F.col("__size")
    # Each piece ends with a word, so the first pieces joined are the text up to that word's end.
    pieces = F.split("text", f"(?<={WORD[:-1]})(?=[\\x20\\x09-\\x0D])")
    text = F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("__part").cast("int")), "")).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.when(cut, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns)
