"""Statistics of scaffolds, contigs, gaps and alignments: totals, quantiles and histograms of lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nice_step(span: int, bins: int) -> int:
    """The largest of 1, 2, 5, 10, 20, 50, ... of which `bins` fit into span; 1 if none does."""
    best, ten = 1, 1
    while ten * bins <= span:
        best = max(x * ten for x in (1, 2, 5) if x * ten * bins <= span)
        ten *= 10
    return best


def gaps(scaffolds: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaf, beg, glen) of what lies before, between and behind the contigs (scaf, sbeg, clen) of scaffolds (scaf, slen); touching contigs have none between."""
    marks = contigs.select("scaf", "sbeg", (F.col("sbeg") + F.col("clen")).alias("to")).unionByName(scaffolds.select("scaf", F.col("slen").alias("sbeg"), F.col("slen").alias("to")))
    last = F.coalesce(F.lag("to").over(Window.partitionBy("scaf").orderBy("sbeg", "to")), F.lit(0))
    return marks.select("scaf", last.alias("beg"), (F.col("sbeg") - last).cast("long").alias("glen")).where("glen > 0")


def genome_totals(scaffolds: DataFrame, contigs: DataFrame) -> DataFrame:
    """(kind, n, total, average) of scaffolds, contigs and gaps; the average is whole."""
    kinds = (("scaffold", scaffolds.select(F.col("slen").alias("l"))), ("contig", contigs.select(F.col("clen").alias("l"))), ("gap", gaps(scaffolds, contigs).select(F.col("glen").alias("l"))))
    one = lambda k, df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("total")).select(F.lit(k).alias("kind"), "n", "total", F.expr("if(n = 0, 0, total div n)").alias("average"))
    return reduce(DataFrame.unionByName, (one(k, df) for k, df in kinds))


def genome_counters(scaffolds: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: scaffolds, contigs, gaps, and the most contigs and gaps of a scaffold."""
    per = lambda df, name: df.groupBy("scaf").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias(f"max_{name}"))
    return scaffolds.agg(F.count("*").alias("scaffolds")).join(F.broadcast(per(contigs, "contigs"))).join(F.broadcast(per(gaps(scaffolds, contigs), "gaps")))


def _accumulated(found: DataFrame, every: DataFrame, total: int) -> DataFrame:
    """(bucket, n, bases, upto, permille) of all buckets, from the top; upto: bases in this bucket and those above."""
    rows = every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bases", F.lit(0)).cast("long").alias("bases"))
    upto = F.sum("bases").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("upto", upto).withColumn("permille", F.expr(f"upto * 1000 div {max(1, total)}"))


def _bounds(lengths: DataFrame) -> tuple[int, int, int] | None:
    r = lengths.agg(F.min("len").alias("lo"), F.max("len").alias("hi"), F.sum("len").alias("total")).first()
    return None if r["lo"] is None else (r["lo"], r["hi"], r["total"])


_EMPTY = "bucket long, n long, bases long, upto long, permille long"


def linear_histogram(lengths: DataFrame, step: int | None = None, bins: int = 20) -> DataFrame:
    """(bucket, n, bases, upto, permille) of lengths (len) in buckets of `step`, or of a nice step of which about `bins` fit; empty buckets between the ends count too."""
    seen = _bounds(lengths)
    if seen is None:
        return lengths.sparkSession.createDataFrame([], _EMPTY)
    lo, hi, total = seen
    step = step or nice_step(hi - lo, bins)
    found = lengths.groupBy(F.expr(f"(len div {step}) * {step}").alias("bucket")).agg(F.count("*").alias("n"), F.sum("len").alias("bases"))
    every = lengths.sparkSession.range(lo // step * step, hi // step * step + 1, step, 1).withColumnRenamed("id", "bucket")
    return _accumulated(found, every, total)


def log_steps(lo: int, hi: int) -> list[int]:
    """1, 2, 5, 10, ... from the largest not above lo to the largest not above hi."""
    every = [x * 10**e for e in range(len(str(max(1, hi)))) for x in (1, 2, 5) if x * 10**e <= max(1, hi)]
    return [x for x in every if x >= nice_step(lo, 1)]


def log_histogram(lengths: DataFrame) -> DataFrame:
    """(bucket, n, bases, upto, permille) of lengths (len) in buckets 1, 2, 5, 10, 20, ...; a length counts in the largest bucket not above it."""
    seen = _bounds(lengths)
    if seen is None:
        return lengths.sparkSession.createDataFrame([], _EMPTY)
    lo, hi, total = seen
    steps = log_steps(lo, hi)
    bucket = F.coalesce(*[F.when(F.col("len") >= s, F.lit(s)) for s in reversed(steps)], F.lit(steps[0])).cast("long")
    found = lengths.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("len").alias("bases"))
    every = lengths.sparkSession.createDataFrame([(s,) for s in steps], "bucket long")
    return _accumulated(found, every, total)


def alignment_totals(alignments: DataFrame) -> DataFrame:
    """One row: alignments, their total and average length on A, differences, and the most and all trace points (abpos, aepos, diffs, tpoints)."""
    size = F.col("aepos") - F.col("abpos")
    points = F.size("tpoints")
    out = alignments.agg(F.count("*").alias("alignments"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bases"), F.coalesce(F.sum("diffs"), F.lit(0)).cast("long").alias("diffs"), F.coalesce(F.max(points), F.lit(0)).cast("long").alias("max_trace"), F.coalesce(F.sum(points), F.lit(0)).cast("long").alias("total_trace"))
    return out.withColumn("average", F.expr("if(alignments = 0, 0, bases div alignments)"))


def seed_totals(seeds: DataFrame, bases: int) -> DataFrame:
    """One row: seeds, their total length, the average in tenths, and seeds for each 1000 bases of genome 1. seeds: (len, ...)."""
    out = seeds.agg(F.count("*").alias("seeds"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total"))
    return out.withColumn("average_tenths", F.expr("if(seeds = 0, 0, total * 10 div seeds)")).withColumn("per_kilobase", F.expr(f"seeds * 1000 div {max(1, bases)}"))
