"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.runtime import discard, written


def _sum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return r["n"], r["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b: long); comp is the smallest node of the component.

    Alternating star contraction: each node's neighbours are tied to the smallest one, the larger ones first, then the smaller ones, until no edge
    changes. A hub's edges are aggregated before they are shuffled and joined, never collected; each step is written to the shared folder, and deleted once the next one is.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, e = e, written(small.where("a <> b").distinct(), "edges")
        discard(last, large)
        now = _sum(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
