"""A genome, its index, annotations and alignments as Parquet folders with what they were made from."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import sequences
from strandlake.storage import filesystem

GENOME = {"scaffolds": "scaf long, name string, slen long", "contigs": "scaf long, ctg int, sbeg long, clen long, seq string"}


def _note(spark: SparkSession, path: str, note: list[dict]) -> None:
    fs, target = filesystem(spark, f"{path}/_about.json")
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(note).encode()))
    out.close()


def about(spark: SparkSession, path: str) -> list[dict]:
    """What a folder was made by and from, the first step first; empty where nothing was noted."""
    fs, target = filesystem(spark, f"{path}/_about.json")
    if not fs.exists(target):
        return []
    return json.loads(_text(fs, target))


def _text(fs, target) -> str:
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def noted(spark: SparkSession, path: str, step: str, sources: list[str]) -> None:
    """Add a step to a folder's history, behind that of the folders it was made from."""
    past = [x for s in sources for x in about(spark, s)]
    _note(spark, path, [*past, {"step": step, "sources": sources, "at": datetime.now(timezone.utc).isoformat()}])


def write_genome(scaffolds: DataFrame, path: str, min_gap: int = 0, source: str = "") -> None:
    """Write scaffolds (scaf, name, slen, seq) as a genome: its skeleton and its contigs."""
    scaffolds.select("scaf", "name", "slen").write.parquet(f"{path}/scaffolds")
    sequences.contigs(scaffolds.select("scaf", "seq"), min_gap).write.parquet(f"{path}/contigs")
    noted(scaffolds.sparkSession, path, "genome", [source] if source else [])


def read_genome(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scaffolds, contigs) of a genome; columns that are not asked for are not read."""
    return spark.read.schema(GENOME["scaffolds"]).parquet(f"{path}/scaffolds"), spark.read.schema(GENOME["contigs"]).parquet(f"{path}/contigs")


def checked(df: DataFrame, schema: str) -> DataFrame:
    """df, or an error if its columns and types are not those of schema."""
    want = df.sparkSession.createDataFrame([], schema).schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns that are missing or of another type: {', '.join(wrong)}")
    return df


def skeletons(scaffolds: DataFrame, contigs: DataFrame) -> DataFrame:
    """(scaf, mark): a scaffold's number and a hash of its name, length and contigs' places."""
    own = contigs.groupBy("scaf").agg(F.array_sort(F.collect_list(F.struct(F.col("sbeg").cast("long").alias("sbeg"), F.col("clen").cast("long").alias("clen")))).alias("c"))
    return scaffolds.join(own, "scaf", "left").select("scaf", F.sha2(F.to_json(F.struct("name", F.col("slen").cast("long").alias("slen"), "c")), 256).alias("mark"))


def same_genome(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame | None:
    """(scaf, other): which scaffold of b each of a is, if both hold the same scaffolds in whatever order; else None. Equal scaffolds go in their order."""
    from pyspark.sql.window import Window

    turn = lambda df: df.withColumn("turn", F.row_number().over(Window.partitionBy("mark").orderBy("scaf")))
    left, right = turn(skeletons(*a)), turn(skeletons(*b)).withColumnRenamed("scaf", "other")
    both = left.join(right, ["mark", "turn"], "full")
    return None if not both.where("scaf is null or other is null").isEmpty() else both.select("scaf", "other")


def replace_source(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Name another source in a folder's history, by a new file in the old one's place; the tables stay as they are."""
    note = [x | {"sources": [new if s == old else s for s in x["sources"]]} for x in about(spark, path)]
    _note(spark, path, note)


def view(df: DataFrame, first: int = 0, last: int | None = None, order: list[str] | None = None, header: bool = False) -> DataFrame:
    """(line): rows as text, those numbered first to last (exclusive) in the order given; header: the schema's line alone."""
    from strandlake.operators.ordered import numbered

    if header:
        return df.sparkSession.createDataFrame([(df.schema.simpleString(),)], "line string")
    rows = numbered(df, order or df.columns, "_row").where(F.col("_row") >= first)
    rows = rows if last is None else rows.where(F.col("_row") < last)
    return rows.orderBy("_row").select(F.to_json(F.struct(*df.columns)).alias("line"))


def stats(df: DataFrame, groups: list[str]) -> DataFrame:
    """(kind, n): how many objects there are, and how many groups of each kind."""
    return df.agg(F.count("*").alias("object"), *[F.countDistinct(g).alias(g) for g in groups]).unpivot([], ["object", *groups], "kind", "n")
