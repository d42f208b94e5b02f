"""Chat formatting: logged conversations that are prefixes of longer ones are collapsed before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.runtime import written

#: Turns of a conversation that one task orders and hashes at once.
TURNS_PER_BUCKET = 4096


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with pos (from 1), n (turns of the conversation) and the rolling hash h1, h2 of turns 1 to pos.

    Turns go by (turn, role, text), nulls first. The hash of a prefix is the exclusive or of two 64-bit hashes of (position, role, text),
    so a conversation in many parts is hashed part by part, and no task holds more than a part of it.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("_b", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(2**60))))
    here = Window.partitionBy("conv_id", "_b").orderBy("turn", "role", "text")
    counts = t.groupBy("conv_id", "_b").agg(F.count("*").alias("_c"))
    parts = Window.partitionBy("conv_id")
    counts = counts.select("conv_id", "_b", F.coalesce(F.sum("_c").over(parts.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_c").over(parts).alias("n"))
    of = lambda x: x.withColumnsRenamed({"conv_id": "_k_conv", "_b": "_k_b"})
    same = F.col("conv_id").eqNullSafe(F.col("_k_conv")) & (F.col("_b") == F.col("_k_b"))
    t = t.withColumn("_i", F.row_number().over(here))
    t = t.join(of(counts), same).withColumn("pos", F.col("_off") + F.col("_i")).drop("_k_conv", "_k_b", "_off", "_i")
    said = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    t = t.withColumn("_h1", F.xxhash64(*said)).withColumn("_h2", F.xxhash64(F.lit("second"), *said))
    t = written(t, "chat-turns")
    sums = t.groupBy("conv_id", "_b").agg(F.expr("bit_xor(_h1)").alias("_x1"), F.expr("bit_xor(_h2)").alias("_x2"))
    before = parts.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "_b", *[F.coalesce(F.expr(f"bit_xor(_x{k})").over(before), F.lit(0).cast("long")).alias(f"_o{k}") for k in (1, 2)])
    run = Window.partitionBy("conv_id", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.expr(f"bit_xor(_h{k})").over(run).alias(f"_r{k}") for k in (1, 2)])
    t = t.join(of(sums), same)
    return t.select("conv_id", "turn", "role", "text", "pos", "n", *[F.col(f"_r{k}").bitwiseXOR(F.col(f"_o{k}")).alias(f"h{k}") for k in (1, 2)])


def collapse(hashed: DataFrame) -> DataFrame:
    """superseded conversations (conv_id) and the maximal one that holds each (into_conv): from what `prefixes` returns.

    For each prefix one conversation is kept, the longest, then the one with the smallest conv_id; a conversation whose whole hash names
    another one is a snapshot of it, or a copy. One row for each prefix, never a pair of conversations.
    """
    best = hashed.groupBy(F.col("pos").alias("_pos"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.max(F.struct("n", (-F.col("conv_id")).alias("c"))).alias("best"))
    whole = hashed.where("pos = n").select("conv_id", "pos", "h1", "h2")
    met = whole.join(best, (F.col("pos") == F.col("_pos")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return met.select("conv_id", (-F.col("best.c")).alias("into_conv")).where(~F.col("conv_id").eqNullSafe(F.col("into_conv")))


def chat_format(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", escaped: str | None = None) -> DataFrame:
    """The turns of maximal conversations, rendered: conv_id, pos, role, n_turns, n_collapsed, rendered.

    n_collapsed counts the logged conversations that were collapsed into this one. A conversation's text is its rendered turns in the order of pos, one after the
    other; conversations are not gathered into one row. A null role or text renders as an empty string but is another turn than an
    empty one. A marker inside a role or text is rendered as it stands and can look like a turn of its own, unless `escaped` is given to stand in its place. Turns with a null conv_id are one conversation; it is kept unless another one (with an id) holds it. Repeated rows are turns.
    """
    hashed = written(prefixes(turns), "chat-prefixes")
    gone = written(collapse(hashed), "chat-gone")
    kept = hashed.alias("t").join(gone.alias("g"), F.col("t.conv_id").eqNullSafe(F.col("g.conv_id")), "left_anti")
    into = gone.groupBy(F.col("into_conv").alias("_into")).agg(F.count("*").alias("n_collapsed"))
    plain = lambda c: F.coalesce(c, F.lit("")) if escaped is None else F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(start), F.lit(escaped)), F.lit(end), F.lit(escaped))
    rendered = F.concat(F.lit(start), plain("role"), F.lit("\n"), plain("text"), F.lit(end + "\n"))
    kept = kept.join(into, F.col("conv_id").eqNullSafe(F.col("_into")), "left")
    return kept.select("conv_id", "pos", "role", F.col("n").alias("n_turns"), F.coalesce("n_collapsed", F.lit(0).cast("long")).alias("n_collapsed"), rendered.alias("rendered"))
