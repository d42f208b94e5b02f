"""The queries of the operators here, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import ann, chat, decontaminate, langid, mixing, neardup, passages, pii, sharding, warc
from strandlake.llm.runtime import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), langid.train(docs, ~held_out))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "block", "release", "deadline", "mix_slot", "position")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op8_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_kd_shards, op4_warc_round_trip, op5_nearest_neighbours, op6_personal_data, op7_chat_snapshots, op8_benchmark_matches, op9_repeated_passages, op10_near_duplicates)}


OP7_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                  md5(string_agg(coalesce('r' || role, 'n') || '|' || length(coalesce(role, '')) || coalesce('t' || text, 'n') || '|' || length(coalesce(text, '')), '|') OVER w) AS h
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     best AS (SELECT pos, h, max({'n': n, 'c': -conv_id}) AS b FROM t GROUP BY pos, h),
     gone AS (SELECT t.conv_id, -best.b.c AS into_conv FROM t JOIN best USING (pos, h) WHERE t.pos = t.n AND t.conv_id <> -best.b.c)
SELECT t.conv_id, t.pos, t.role, t.n AS n_turns, (SELECT count(*) FROM gone WHERE into_conv = t.conv_id) AS n_collapsed,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_snapshots": OP7_SQL}
