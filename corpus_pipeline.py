"""The corpus pipeline: language identification, near-dedup, decontamination, mixing, sharding, each over all that is kept so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, langid, mixing, neardup, sharding
from strandlake.llm.runtime import small_batches, table, written

#: Shards of the last stage.
SHARDS = 16


def _free(docs: DataFrame, *names: str) -> list[str]:
    """names, with underscores in front where docs has such columns."""
    out = []
    for name in names:
        while name in docs.columns:
            name = f"_{name}"
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or null) go; so do those whose codewords leave no language ahead (score below one half, and flagged as ambiguous).

    If no row has a language to learn from, only the first rule holds.
    """
    small_batches(spark)
    model = langid.train(docs, F.lit(True))
    names = pred, score, ambiguous = _free(docs, "lang_pred", "score", "ambiguous")
    out = langid.identify(docs, model, names=names)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return out.where((F.col(pred) != langid.UNDETERMINED) & ~(F.col(ambiguous) & (F.col(score) < 0.5))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest (doc_id, hash of the text), nulls last; one of those rows, if it is repeated."""
    small_batches(spark)
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    key = lambda tk: [F.xxhash64(F.col("doc_id").cast("long"), tk).alias("a"), F.coalesce(tk, F.lit(0).cast("long")).alias("b")]
    kept = found.where("kept").select(*key(F.col("tk"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *key(F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string")))))
    return rows.join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their position in the Pfair schedule; partitions and the rows in them follow each other in that order."""
    return mixing.mix(docs).select(*[c for c in docs.columns if c != "position"], "position")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, of nearly equal bytes, and their slot in it, in the order of the schedule."""
    names = _free(docs.drop("position"), "shard", "slot")
    placed = sharding.shard(docs, SHARDS, order="position").select(F.col("position").alias("_at"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "position"]).alias("row"), "position")
    return rows.join(placed, F.col("position") == F.col("_at")).select("row.*", F.col("_shard").alias(names[0]), F.col("_slot").alias(names[1]))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shard", shard)]
#: The fitted classifier and the sketches have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of shard() over the documents of sf_dir, after all stages; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
