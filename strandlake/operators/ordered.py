"""Orders over whole tables: row numbers, slices, top-k thresholds and running sums, none of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.storage import written


def numbered(df: DataFrame, order: list[str | Column], out: str = "row") -> DataFrame:
    """Add `out`: the row's number from 0 in the order given; rows that tie are numbered in any order.

    Rows are dealt out to ranges of the order and written once; windows number each range, and a table of one row a range has what lies before it.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = written(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()), "numbered")
    sums = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    out_rows = parts.withColumn("_own", own).join(F.broadcast(sums.select("_range", before.alias("_before"))), "_range")
    return out_rows.select(*df.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias(out))


def slice_rows(df: DataFrame, order: list[str | Column], first: int, last: int) -> DataFrame:
    """The rows numbered first (from 0) to last (exclusive) in the order given."""
    if first < 0 or last < first:
        raise ValueError(f"{first} to {last} is no range of rows")
    return numbered(df, order, "_row").where((F.col("_row") >= first) & (F.col("_row") < last)).drop("_row")


def nice_cut(length: int) -> int:
    """length with low digits replaced by 0, as many as cost at most a tenth of it."""
    digits = 1
    while length and (length // digits) * digits >= 0.9 * length:
        digits *= 10
    digits = max(1, digits // 10)
    return length // digits * digits


def longest(df: DataFrame, length: Column, most: int) -> DataFrame:
    """The rows whose length reaches the most-th greatest one rounded down by `nice_cut`: `most` rows or some more; all, if there are no more or most is 0."""
    if most <= 0:
        return df
    top = df.select(length.alias("l")).orderBy(F.desc("l")).limit(most).agg(F.min("l").alias("l"), F.count("*").alias("n")).first()
    return df.where(length >= nice_cut(top["l"])) if top["n"] == most and top["l"] is not None else df


def running(df: DataFrame, key: str, value: str, out: str, descending: bool = False) -> DataFrame:
    """Add `out`: the sum of value over all rows up to this one by key (whole numbers from 0 on, each once).

    Keys go to bins by their leading bits (256 a power of two): windows add up each bin, a table of one row a bin has what lies before it.
    """
    size = F.length(F.bin(F.col(key).cast("long")))
    bits = F.greatest(F.lit(0), size - 9)
    df = df.withColumn("_bin", bits * 4096 + F.expr(f"shiftright(cast({key} as bigint), cast(greatest(0, length(bin(cast({key} as bigint))) - 9) as int))"))
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    bins = df.groupBy("_bin").agg(F.sum(value).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.orderBy(turn("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(value).over(Window.partitionBy("_bin").orderBy(turn(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = df.withColumn("_own", own).join(F.broadcast(bins.select("_bin", before.alias("_before"))), "_bin")
    return both.withColumn(out, F.col("_own") + F.col("_before")).drop("_bin", "_own", "_before")
