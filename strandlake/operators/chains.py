"""Seeds on diagonals, and their chains in pairs of neighbouring diagonal bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Antidiagonals without a seed that end a chain, and those that a chain must cover, in bases; both count twice.
CHAIN_BREAK, CHAIN_MIN = 1000, 85
#: Diagonals of a band, as a power of two.
BAND = 6


def diagonals(seeds: DataFrame, amax: int, bmax: int) -> DataFrame:
    """seeds (len, actg, apos, bctg, bpos, comp) with diag, anti, band and drem; amax and bmax are the longest contigs of either side."""
    i, j = F.col("apos"), F.col("bpos")
    diag = F.when(F.col("comp"), F.lit(amax + bmax) - (i + j)).otherwise(F.lit(bmax) + i - j).cast("long")
    anti = F.when(F.col("comp"), F.lit(amax) - (i - j)).otherwise(i + j).cast("long")
    return seeds.withColumn("diag", diag).withColumn("anti", anti).withColumn("band", F.shiftright("diag", BAND)).withColumn("drem", F.pmod("diag", F.lit(1 << BAND)))


def chains(placed: DataFrame, chain_break: int = CHAIN_BREAK, chain_min: int = CHAIN_MIN) -> DataFrame:
    """(actg, bctg, comp, band, alow, ahgh, dgmin, dgmax, cov, seeds) of what `diagonals` returns.

    A band that holds a seed is swept together with the next one, by antidiagonal. A chain ends where no seed starts within 2 chain_break of the
    furthest end so far; it stays if its seeds cover 2 chain_min antidiagonals and, where the band below holds seeds too, one of them lies in the upper
    band (else the sweep below has it).
    """
    group = ["actg", "bctg", "comp"]
    held = placed.select(*group, "band").distinct()
    below = held.select(*group, (F.col("band") + 1).alias("band"), F.lit(True).alias("_below"))
    keyed = placed.select(*group, "len", "diag", "anti", "band").withColumn("_up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("_up"))
    keyed = keyed.join(held, [*group, "band"], "left_semi").join(below, [*group, "band"], "left").withColumn("_below", F.coalesce("_below", F.lit(False)))
    keyed = keyed.withColumn("_end", F.col("anti") + 2 * F.col("len"))
    order = Window.partitionBy(*group, "band").orderBy("anti", "_up", "diag", "len")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = keyed.withColumn("_last", before).withColumn("_new", F.when(F.col("_last").isNull() | (F.col("anti") >= F.col("_last") + 2 * chain_break), 1).otherwise(0))
    rows = rows.withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    covered = F.greatest(F.lit(0), F.col("_end") - F.when(F.col("_new") == 1, F.col("anti")).otherwise(F.greatest("anti", "_last")))
    out = rows.withColumn("_cov", covered).groupBy(*group, "band", "_chain", "_below").agg(
        F.min("anti").alias("alow"), F.max("_end").alias("ahgh"), F.min("diag").alias("dgmin"), F.max("diag").alias("dgmax"), F.sum("_cov").alias("cov"), F.max("_up").alias("_upper"), F.count("*").alias("seeds")
    )
    out = out.where((F.col("cov") >= 2 * chain_min) & ((F.col("_upper") == 1) | ~F.col("_below")))
    return out.select(*group, "band", "alow", "ahgh", "dgmin", "dgmax", "cov", "seeds")
