"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.shared import remove, shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for each id in `edges`; component is the smallest id reachable.

    Large stars join each neighbour above a node to the smallest id around the
    node, small stars do so with the neighbours below; in turn they lead to one
    star for each component in a number of rounds that grows with the logarithm
    of the ids. Smallest ids come from a grouped minimum, which sums up before
    the shuffle, and reach the edges by a join, which Spark can split where a
    node has very many neighbours: no task gathers a node's neighbours. Each
    round is written to the shared folder, and the round before is deleted.

    Null ids and loops are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")
    )
    path, state = shared_dir(spark, "edges"), None
    now.distinct().write.parquet(path)
    while True:
        now = spark.read.schema("hi long, lo long").parquet(path)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == tuple(seen) or not seen[0]:
            break
        state, before, path = tuple(seen), path, shared_dir(spark, "edges")
        _small_star(_large_star(now)).write.parquet(path)
        remove(spark, before)
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    above = both.where("v > u").join(least, "u")
    return above.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    below = edges.join(least, "hi").where("lo != m")
    return below.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
