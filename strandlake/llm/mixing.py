"""Mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.runtime import MOST_BUCKETS, ROWS_PER_BUCKET, buckets_for, numbered, small_table

#: Bytes of a block.
BLOCK_BYTES = 65_536
#: Slots after which the schedule repeats; weights are rounded to multiples of 1 / PERIOD.
PERIOD = 1024


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """weights as whole slots of a period (largest remainders, then names), one at least for each."""
    total = sum(weights.values())
    exact = {s: 1 + w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def pfair(slots: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period.

    Block j of a source with a of D slots may run from floor(j D / a) and must be done by ceil((j + 1) D / a). In each slot
    the released block with the earliest deadline runs, the smaller name first in ties. The shares fill the period, so
    all deadlines hold, and after any number t of slots each source has run less than one block away from t a / D.
    """
    period = sum(slots.values())
    queue = [(0, s, 0) for s in sorted(slots)]  # (release, source, block)
    heapq.heapify(queue)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(period):
        while queue and queue[0][0] <= t:
            release, s, j = heapq.heappop(queue)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        if j + 1 < slots[s]:
            heapq.heappush(queue, ((j + 1) * period // slots[s], s, j + 1))
        out.append((s, j, release, deadline, t))
    return out


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, block_bytes: int = BLOCK_BYTES, period: int = PERIOD) -> DataFrame:
    """Add block, release, deadline, mix_slot and position to all rows of docs (doc_id, text, source; other columns stay, those of these names are replaced).

    Target weights: as given, or each source's bytes to the power alpha; a source that weights does not name gets the smallest
    weight named. A source's rows, in the order of md5(doc_id), are cut into blocks of block_bytes (text's UTF-8 bytes plus 1 a
    row; a row belongs to the block in which it starts). Blocks run by `pfair`, period after period; a source that has run out leaves its slots
    to the others. position numbers all rows without gaps in that order: none is dropped or repeated. Null sources are one source
    of their own, named with an empty string, as empty ones are. Null doc_ids come first. Rows that tie are in any order; partitions
    and the rows in them follow position. An empty table stays empty.
    """
    spark = docs.sparkSession
    added = ("block", "release", "deadline", "mix_slot", "position")
    others = [c for c in docs.columns if c not in added]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    unit = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(F.struct(*others).alias("_row"), F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("_src"), size.alias("_size"), unit.alias("_u"), F.crc32("text").alias("_t"))
    sums = {r["_src"]: r for r in sized.groupBy("_src").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()}
    if not sums:
        return docs.select(*others, *[F.lit(0).cast("long").alias(c) for c in added])
    if weights is None:
        aim = {s: float(r["b"]) ** alpha for s, r in sums.items()}
    else:
        aim = {s: float(weights.get(s, min(weights.values()))) for s in sums}
    while period < 4 * len(aim):
        period *= 2
    slots = shares(aim, period)
    # A row for each slot of a period: it grows with the sources (a quarter of it at most), not with the rows.
    plan = small_table(spark, [(s, slots[s], j, r, d, t) for s, j, r, d, t in pfair(slots)], {"_p_src": pa.string(), **{f"_p_{k}": pa.int32() for k in "ajrdt"}})
    rows, size = sum(r["n"] for r in sums.values()), sum(r["b"] for r in sums.values())
    bits = buckets_for(rows, len(sums)).bit_length() - 1
    bucket = F.shiftright(F.conv(F.substring("_u", 1, 6), 16, 10).cast("int"), 24 - min(bits, 24))
    own = numbered(sized.withColumn("_b", bucket), ["_src"], "_b", [F.col("_u"), F.col("doc_id"), F.col("_size"), F.col("_t")], "_start", F.col("_size"))
    own = own.withColumn("block", F.expr(f"_start div {block_bytes}"))
    per_source = F.broadcast(small_table(spark, [(s, slots[s]) for s in slots], {"_q_src": pa.string(), "_q_a": pa.int32()}))
    own = own.join(per_source, F.col("_src") == F.col("_q_src")).withColumn("_j", F.pmod("block", "_q_a").cast("int")).withColumn("_r", F.expr("block div _q_a"))
    own = own.join(F.broadcast(plan), (F.col("_src") == F.col("_p_src")) & (F.col("_j") == F.col("_p_j")))
    own = own.select("*", *[(F.col("_r") * period + F.col(f"_p_{k}")).alias(c) for k, c in (("r", "release"), ("d", "deadline"), ("t", "mix_slot"))])
    blocks = max(1, size // block_bytes)
    per_bucket = max(1, int(ROWS_PER_BUCKET / (rows / blocks)), -(-(blocks + period) * len(sums) // MOST_BUCKETS))
    out = numbered(own.withColumn("_b", F.expr(f"mix_slot div {per_bucket}")), [], "_b", [F.col("mix_slot"), F.col("_start"), F.col("_u"), F.col("doc_id")], "position", ranged=True)
    return out.select("_row.*", *added)
