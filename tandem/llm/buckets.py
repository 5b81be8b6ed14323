"""Rows that share a key, compared in runs of sorted partitions; a key with very many rows is dealt out in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(keys: DataFrame, by: str, identity: str, hot: DataFrame | None) -> DataFrame:
    """`keys` with `own` and `block`: 0, or for the values of `by` that `hot` has with a number of blocks `n`, a row for each block that a row is compared in.

    Of n blocks, rows of the blocks i <= j meet in the place i * n + j, for each such pair.
    """
    if hot is None:
        return keys.withColumns({"own": F.lit(0).cast("long"), "n_blocks": F.lit(1).cast("long"), "block": F.lit(0).cast("long")})
    places = keys.join(hot.withColumnRenamed("n", "n_blocks"), by, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)).cast("long"))
    places = places.withColumn("own", F.pmod(F.xxhash64(identity), F.col("n_blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda x: F.least("own", x) * F.col("n_blocks") + F.greatest("own", x))
    return places.withColumn("block", F.explode(others))


def runs(batches: Iterator[pa.RecordBatch], keys: int, least: int, done: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands `done` whole runs of rows that are equal in the first `keys` columns, of whole numbers, about `least` rows at once, and the number of each row's run."""
    held: pa.Table | None = None

    def places(rows: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for column in rows.columns[:keys]:
            values = column.combine_chunks().to_numpy()
            new |= values[1:] != values[:-1]
        return np.cumsum(np.r_[0, new])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows and held.num_rows >= least:
            run = places(held)
            if cut := int(np.searchsorted(run, run[-1])):
                yield done(held.slice(0, cut), run[:cut])
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield done(held, places(held))


def joins(group: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the rows of each group as all its links would; groups are runs. `linked` gives the places of two lists of rows that link."""
    label, out, active, lag = np.arange(len(group)), [], np.arange(len(group)), 1
    while True:
        active = active[active + lag < len(group)]
        active = active[group[active] == group[active + lag]]
        if not len(active):
            return out
        apart = active[label[active] != label[active + lag]]
        found = apart[linked(apart, apart + lag)]
        for i in found.tolist():
            a, b = i, i + lag
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, i + lag))
        if len(found):
            while not np.array_equal(label, flat := label[label]):
                label = flat
        lag += 1
