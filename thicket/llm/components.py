"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, release


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that has a link.

    ``links`` has two columns of node numbers. Repeated links and links of a node
    with itself do no harm. Each turn hangs every node's larger neighbours on its
    smallest one, then every node's smaller neighbours likewise; a chain of n nodes
    needs about log2(n) turns. Links stay in Spark; two numbers a turn come back.
    """
    a, b = links.columns
    edges = durable(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    seen = _fingerprint(edges)
    while True:
        edges = durable(_small_star(_large_star(edges)))
        release(edges.sparkSession)  # each turn shuffles anew; the last one's shuffles are done with
        before, seen = seen, _fingerprint(edges)
        if before == seen:
            break
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    hung = edges.join(least, "hi").select(
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            )
        ).alias("e")
    )
    return hung.select("e.hi", "e.lo").filter("hi <> lo").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
