"""BED files as annotations of a genome, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.records import short_name
from strandlake.operators import intervals


def read_bed(spark: SparkSession, path: str, scaffolds: DataFrame) -> DataFrame:
    """(scaf, beg, end, orient, score, label) of a BED file over scaffolds (scaf, name, slen).

    Lines that start with #, track or browser, and empty ones, are passed over. Three fields at least; field 4 is the label (`.`: none), 5 the score, 6 the strand (- is orient 1).
    An unknown name, a field that is no number, or an interval that does not lie in its scaffold is an error that names the line.
    """
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != ""))
    f = F.split("value", r"\t")
    number = lambda i: F.expr(f"try_cast(trim(get(f, {i})) as long)")
    some = lambda i: F.when(F.expr(f"get(f, {i})").isin("", "."), None).otherwise(F.expr(f"get(f, {i})"))
    said = rows.select("value", f.alias("f")).select("value", short_name(F.col("f")[0]).alias("_name"), number(1).alias("beg"), number(2).alias("end"), some(3).alias("label"), F.coalesce(number(4), F.lit(0)).cast("int").alias("score"), (F.coalesce(F.expr("get(f, 5)"), F.lit("+")) == "-").cast("int").alias("orient"))
    known = scaffolds.select("scaf", short_name(F.col("name")).alias("_short"), "slen")
    both = said.join(known, F.col("_name") == F.col("_short"), "left")
    good = F.coalesce((F.col("beg") >= 0) & (F.col("beg") <= F.col("end")) & (F.col("end") <= F.col("slen")), F.lit(False))
    checked = F.when(good, F.col("scaf")).otherwise(F.raise_error(F.concat(F.lit("no interval of the genome: "), F.col("value"))))
    return both.select(checked.alias("scaf"), "beg", "end", "orient", "score", "label")


def write_bed(rows: DataFrame, scaffolds: DataFrame, path: str) -> None:
    """Write annotations (scaf, beg, end, orient, score, label) as BED text, in scaffold coordinates and with their strands."""
    named = rows.join(scaffolds.select("scaf", "name"), "scaf")
    fields = [short_name(F.col("name")), F.col("beg").cast("string"), F.col("end").cast("string"), F.coalesce("label", F.lit(".")), F.col("score").cast("string"), F.when(F.col("orient") == 1, "-").otherwise("+")]
    named.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)


def on_contigs(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaf, ctg, beg, end, ...): annotations of scaffolds in the coordinates of the contig (scaf, ctg, sbeg, clen) in which they begin; one that begins in a gap belongs to none."""
    spans = contigs.select("scaf", "ctg", "sbeg", F.col("sbeg").alias("rbeg"), (F.col("sbeg") + F.col("clen")).alias("rend"))
    keyed = rows.withColumnsRenamed({"beg": "_beg", "end": "_end"}).withColumn("at", F.col("_beg"))
    hit = intervals.holding(keyed, spans, "scaf", "at")
    others = [c for c in rows.columns if c not in ("scaf", "beg", "end")]
    return hit.select("scaf", "ctg", (F.col("_beg") - F.col("sbeg")).alias("beg"), (F.col("_end") - F.col("sbeg")).alias("end"), *others)


def on_scaffolds(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """The inverse of on_contigs."""
    others = [c for c in rows.columns if c not in ("scaf", "ctg", "beg", "end")]
    return rows.join(contigs.select("scaf", "ctg", "sbeg").hint("merge"), ["scaf", "ctg"]).select("scaf", (F.col("beg") + F.col("sbeg")).alias("beg"), (F.col("end") + F.col("sbeg")).alias("end"), *others)
