"""Sharding by k-d tree: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.runtime import buckets_for, numbered, written

#: Bins of one histogram pass, as a power of two.
BITS = 12
#: A group of equal texts that outweighs a shard is dealt out in parts of a quarter of a shard.
PARTS_PER_SHARD = 4


def _scaled(value: Column, low: float, high: float) -> Column:
    """value in low..high as an integer of 30 bits."""
    span = high - low
    return F.lit(0).cast("long") if span <= 0 else F.floor((value - F.lit(low)) / F.lit(span) * F.lit((1 << 30) - 1)).cast("long")


def _cuts(parts: DataFrame, node: Column, wanted: dict[int, tuple[int, int, int, int, float]], dims: list[str], slack: float) -> dict[int, int]:
    """For each node the largest coordinate of its left side.

    wanted: node -> (dimension, low, high, weight, left share). Histograms of at most 4096 bins a node come to the
    driver; a pass zooms into the bin in which the weighted quantile lies, until a border is within `slack`.
    """
    state = {n: [low, max(0, (high - low).bit_length() - BITS), 0.0] for n, (_, low, high, _, _) in wanted.items()}
    open_, cut = set(wanted), {}
    while open_:
        binned = None
        for n in sorted(open_):
            low, shift, _ = state[n]
            c = F.col(dims[wanted[n][0]])
            one = F.when((c >= low) & (c < low + (1 << (shift + BITS))), F.shiftright(c - F.lit(low), shift))
            binned = F.when(node == n, one) if binned is None else binned.when(node == n, one)
        rows = parts.select(node.alias("n"), binned.alias("b"), "w").where("b is not null").groupBy("n", "b").agg(F.sum("w").alias("w")).collect()
        for n in list(open_):
            dim, _, high, total, share = wanted[n]
            low, shift, acc = state[n]
            goal = total * share
            for b, w in sorted((r["b"], r["w"]) for r in rows if r["n"] == n):
                start, end = low + (b << shift), low + ((b + 1) << shift) - 1
                if acc + w >= goal:
                    left, right = goal - acc, acc + w - goal
                    if shift == 0 or min(left, right) <= slack:
                        cut[n] = min(end if right <= left else start - 1, high)
                        open_.discard(n)
                    else:
                        state[n] = [start, max(0, shift - BITS), acc]
                    break
                acc += w
            else:
                cut[n] = high
                open_.discard(n)
    return cut


def kd_leaves(parts: DataFrame, dims: list[str], shards: int) -> Column:
    """The expression of the leaf, 0 to shards-1, for rows of parts (dims: coordinates, w: weight; a written table).

    A node for k leaves is split floor(k/2) : k - floor(k/2) by weight, along the dimension in which its rows
    spread most (the first one of equals). All nodes of a level share their passes over the data.
    """
    nodes, done = {0: shards}, {}
    leaf: Column = F.lit(0)
    tree: dict[int, tuple[int, int, int, int]] = {}
    total, number = None, 1
    while nodes:
        node = leaf
        aggs = [f(c).alias(f"{k}_{c}") for c in dims for k, f in (("lo", F.min), ("hi", F.max))]
        seen = {r["n"]: r for r in parts.select(node.alias("n"), *dims, "w").groupBy("n").agg(F.sum("w").alias("w"), *aggs).collect()}
        total = sum(r["w"] for r in seen.values()) if total is None else total
        wanted = {}
        for n, k in nodes.items():
            if k > 1 and n in seen:
                r = seen[n]
                dim = max(range(len(dims)), key=lambda i: ((r[f"hi_{dims[i]}"] >> 32) - (r[f"lo_{dims[i]}"] >> 32), -i))  # noqa: B023
                wanted[n] = (dim, r[f"lo_{dims[dim]}"], r[f"hi_{dims[dim]}"], r["w"], (k // 2) / k)
        cuts = _cuts(parts, node, wanted, dims, (total or 0) / shards / 10_000)
        following = {}
        for n, k in nodes.items():
            if k == 1:
                done[n] = True
            elif n not in cuts:  # no rows: its leaves stay empty
                done[n] = True
            else:
                tree[n] = (wanted[n][0], cuts[n], number, number + 1)
                following |= {number: k // 2, number + 1: k - k // 2}
                number += 2
        nodes = following

        def walk(n: int) -> Column:
            if n not in tree:
                return F.lit(n)
            d, cut, a, b = tree[n]
            return F.when(F.col(dims[d]) <= F.lit(cut), walk(a)).otherwise(walk(b))

        leaf = walk(0)
    order: list[int] = []

    def visit(n: int) -> None:
        if n in tree:
            visit(tree[n][2])
            visit(tree[n][3])
        else:
            order.append(n)

    visit(0)
    rank = {n: i for i, n in enumerate(order)}

    def named(n: int) -> Column:
        if n not in tree:
            return F.lit(rank[n])
        d, cut, a, b = tree[n]
        return F.when(F.col(dims[d]) <= F.lit(cut), named(a)).otherwise(named(b))

    return named(0)


def shard(docs: DataFrame, shards: int = 16, order: str | None = None) -> DataFrame:
    """Deal all rows out to `shards` shards of nearly equal bytes (law `bytes`).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`), and the column `order` if it is named.
    A row's size is its text's UTF-8 bytes (null: none) plus 1. Metadata dimensions: size (its logarithm), the smallest
    doc_id, source and lang of the rows with the same text, the last two hashed. Rows with equal texts stay together,
    null texts too (a group apart from empty ones); only a group heavier than a whole shard is dealt out in parts, by a hash of doc_id.
    slot numbers each shard's rows without gaps, in the order of the column `order` (whole numbers from 0 on, none null, near gapless over all rows) if it is named.
    An empty table gives an empty result, null doc_ids are kept,
    repeated rows are rows. Other columns of docs are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.col("text").isNull(), text).alias("g"), F.crc32(F.coalesce(F.col("source"), F.lit(""))).alias("src"), F.crc32(F.coalesce(F.col("lang"), F.lit(""))).alias("lng"),
            *([F.col(order).cast("long").alias("_at")] if order else []),
        ),
        "shard-rows",
    )
    key = ["g", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("w"), F.min("doc_id").alias("first"), F.min("src").alias("src"), F.min("lng").alias("lng"))
    groups = written(groups, "shard-groups")
    lows = groups.agg(F.sum("w").alias("w"), *[f(c).alias(f"{k}_{c}") for c in ("size", "first") for k, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    if not lows["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *([F.lit(0).cast("long").alias(order)] if order else []))
    target = lows["w"] / shards
    m = F.when(F.col("w") > target, F.ceil(F.col("w") * PARTS_PER_SHARD / F.lit(target))).otherwise(1).cast("int")
    parts = groups.withColumn("m", m).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    tie = F.shiftrightunsigned(F.xxhash64("g", "text_crc32", "size", "part"), 32)
    high = [
        _scaled(F.log(F.col("size").cast("double")), *(math.log(lows[k]) for k in ("lo_size", "hi_size"))),
        _scaled(F.coalesce(F.col("first").cast("double"), F.lit(float(lows["lo_first"] or 0))), float(lows["lo_first"] or 0), float(lows["hi_first"] or 0)),
        _scaled(F.col("src").cast("double"), 0.0, float((1 << 32) - 1)), _scaled(F.col("lng").cast("double"), 0.0, float((1 << 32) - 1)),
    ]
    dims = [f"c{i}" for i in range(len(high))]
    parts = written(parts.select(*key, "part", (F.col("w") / F.col("m")).alias("w"), *[(F.shiftleft(h, 32) + tie).alias(c) for h, c in zip(high, dims, strict=True)]), "shard-parts")
    at = parts.withColumn("shard", kd_leaves(parts, dims, shards))
    at = at.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "shard"))), lambda x: x["shard"]).alias("at"))
    at = written(at, "shard-at")
    cond = (F.col("g") == F.col("_g")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size"))
    # Groups in parts are each heavier than a shard, so there are fewer of them than shards; their rows are not gathered.
    heavy = rows.join(F.broadcast(at.where(F.size("at") > 1)), cond, "left")
    own = ["doc_id", "size", "text_crc32", *(["_at"] if order else [])]
    light = heavy.where("at is null").select(*own, "g").join(at.where(F.size("at") == 1), cond).select(*own, F.col("at")[0].alias("shard"))
    dealt = heavy.where("at is not null").select(*own, F.col("at")[F.pmod(F.xxhash64("doc_id"), F.size("at")).cast("int")].alias("shard")).unionByName(light)
    dealt = written(dealt, "shard-dealt")
    n = buckets_for(dealt.count(), shards)
    if order:
        last = dealt.agg(F.max("_at")).first()[0]
        dealt = dealt.withColumn("_b", F.expr(f"_at div {last // n + 1}"))
    else:
        dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n)))
    out = numbered(dealt, ["shard"], "_b", [F.col("_at")] if order else [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *([F.col("_at").alias(order)] if order else []))
