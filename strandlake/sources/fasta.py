"""FASTA files as tables of scaffolds, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.ordered import numbered

#: Bases of a line.
WIDTH = 80


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of all records: the header behind > and blanks, and the lines below it joined, blanks left out. Text before the first > is an error.

    Spark splits plain files at > (gzip files are read whole), so a record is one row; a base count beyond 2 GB does not fit one.
    """
    raw = spark.read.text(path, lineSep=">")
    rows = raw.where(F.trim(F.regexp_replace("value", "[\\r\\n]", " ")) != "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    return rows.select(F.trim(F.regexp_extract("value", r"^[^\r\n]*", 0)).alias("name"), body.alias("seq"))


def with_numbers(records: DataFrame) -> DataFrame:
    """(scaf, name, slen, seq): records numbered from 0 by name."""
    return numbered(records, ["name"], "scaf").select("scaf", "name", F.length("seq").cast("long").alias("slen"), "seq")


def wrapped(seq, width: int = WIDTH):
    """A sequence in lines of `width`, without an end of line at the end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def write(scaffolds: DataFrame, path: str, width: int = WIDTH, compression: str | None = None, upper: bool = False) -> None:
    """Write scaffolds (name, seq) as FASTA text, one file a partition; compression: gzip or none."""
    seq = F.upper("seq") if upper else F.col("seq")
    out = scaffolds.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped(seq, width)).alias("value"))
    out.write.option("compression", compression or "none").text(path)


def assembled(scaffolds: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, seq): scaffolds (scaf, name, slen) put together from contigs (scaf, sbeg, clen, seq), gaps and ends filled with N."""
    own = contigs.groupBy("scaf").agg(F.array_sort(F.collect_list(F.struct("sbeg", "clen", "seq"))).alias("c"))  # one scaffold's own contigs
    whole = scaffolds.join(own, "scaf", "left").withColumn("c", F.coalesce("c", F.expr("array()")))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.col("c")[i - 1]["sbeg"] + F.col("c")[i - 1]["clen"])
    parts = F.transform("c", lambda x, i: F.concat(F.repeat(F.lit("N"), (x["sbeg"] - before(i)).cast("int")), x["seq"]))
    end = F.when(F.size("c") == 0, F.lit(0).cast("long")).otherwise(F.element_at("c", -1)["sbeg"] + F.element_at("c", -1)["clen"])
    return whole.select("name", F.concat(F.array_join(parts, ""), F.repeat(F.lit("N"), (F.col("slen") - end).cast("int"))).alias("seq"))
