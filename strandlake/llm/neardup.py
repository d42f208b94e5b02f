"""Near duplicates by BagMinHash: weighted minima of shingle multisets, banded, then verified on the multisets themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.graph import components
from strandlake.llm.runtime import discard, written
from strandlake.llm.words import common, mix64, shingles, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Shingles that are sketched at once.
BATCH = 1 << 19
#: Members that are compared with one copy of their hub's text.
MEMBERS = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bagminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """docs x m minima (float64) of weighted sets given as (document, element hash, whole weight); inf for a document without elements.

    Each element has Poisson processes over time, m a unit of weight, one for each octave (0,1], (1,2], (2,4], (4,8], ... of the weight that it
    reaches. A point falls on a component and, by further bits (the descent through the octave's halves), on one weight level in
    the octave; it counts if the element's weight reaches that level. So two documents share each component's first
    point with the probability of their weighted Jaccard similarity. Points beyond a time by which all components are almost surely
    met are not drawn; documents in which one is still open are drawn again up to twice the time.
    """
    out = np.full((docs, m), np.inf)
    total = np.bincount(doc, weights=weight, minlength=docs)
    todo, limit = np.flatnonzero(total), np.zeros(docs)
    limit[todo] = (math.log(m) + 4) / total[todo]
    while len(todo):
        chosen = np.zeros(docs, dtype=bool)
        chosen[todo] = True
        pick = chosen[doc]
        d0, e0, w0 = doc[pick], element[pick], weight[pick]
        low = np.full(docs * m, np.inf)
        octave, part = 0, np.arange(len(d0))
        while len(part):
            width = 1 if octave == 0 else 1 << (octave - 1)
            d, w = d0[part], w0[part]
            seed = mix64(e0[part] + np.uint64(octave * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            t = np.zeros(len(part))
            while len(d):
                seed = seed + _STEP
                r = mix64(seed)
                t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
                on = t <= limit[d]
                d, w, seed, t, r = d[on], w[on], seed[on], t[on], r[on]
                slot = d * m + (((r & np.uint64(2047)) * np.uint64(m)) >> np.uint64(11)).astype(np.int64)
                if octave:
                    level = width + 1 + (mix64(r) & np.uint64(width - 1)).astype(np.int64)
                    reached = level <= w
                    np.minimum.at(low, slot[reached], t[reached])
                else:
                    np.minimum.at(low, slot, t)
            octave += 1
            part = part[w0[part] > (1 << (octave - 1))]
        low = low.reshape(docs, m)
        done = np.isfinite(low).all(axis=1)
        out[done] = low[done]
        todo = todo[~done[todo]]
        limit[todo] *= 2
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """docs x bands keys (int64): a hash of the band's number and its minima."""
    bits = minima.view(np.uint64).reshape(len(minima), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(minima), bands))
    for i in range(rows):
        key = mix64(key * _STEP + bits[:, :, i])
    return key.view(np.int64)


def content_key(words: np.ndarray) -> int:
    """A hash of the sequence of words, as a signed 64-bit number."""
    if not len(words):
        return 0
    at = mix64(np.arange(1, len(words) + 1, dtype=np.uint64) * _STEP)
    return int(np.bitwise_xor.reduce(mix64(words + at)).view(np.int64))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tk, c1, size, bands) of all rows (doc_id, tk, text) with at least one word: content key, number of shingles, band keys."""

    def flush(held: list) -> pa.RecordBatch:
        sets = [np.unique(h[3], return_counts=True) for h in held]
        doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in sets])
        minima = bagminhash(doc, np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets]), len(held), bands * rows)
        keys = band_keys(minima, bands, rows)
        offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
        columns = [*[pa.array([h[i] for h in held], pa.int64()) for i in range(3)], pa.array([len(h[3]) for h in held], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "c1", "size", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, tk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = word_hashes(text.as_py())
                if not len(words):
                    continue
                s = shingles(words)
                held.append((doc_id, tk, content_key(words), s))
                n += len(s)
                if n >= BATCH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "doc_id long, tk long, c1 long, size long, bands array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text) of the rows of docs whose text is not null; tk is the text's hash."""
    text = F.col("text").cast("string")
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _texts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (rep: doc_id and tk of a row, other columns) with text, and without rep. Rows without doc_id are aggregated by text before they are joined."""
    asked = asked.select("*", F.col("rep.doc_id").alias("_d"), F.col("rep.tk").alias("_t")).drop("rep")
    named = rows.where("doc_id is not null").join(asked.where("_d is not null"), (F.col("doc_id") == F.col("_d")) & (F.col("tk") == F.col("_t")))
    bare = rows.where("doc_id is null").groupBy("tk").agg(F.first("text").alias("text")).join(asked.where("_d is null"), F.col("tk") == F.col("_t"))
    keep = [c for c in asked.columns if c not in ("_d", "_t")] + ["text"]
    return named.select(*keep).unionByName(bare.select(*keep))


def verify(rows: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, both, sim) of the pairs (hub, member: content keys): how many shingles their texts have in common, and their weighted Jaccard similarity.

    Texts are fetched by the representatives' rows. A hub's members are dealt out MEMBERS at a time, each part with a copy of the hub's text,
    so neither a popular hub nor its members meet in one task.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "parts")
    members = dealt.select("hub", "part", F.col("member").alias("node"), F.lit(1).alias("side"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    asked = members.unionByName(hubs).join(reps.select(F.col("c1").alias("node"), "rep"), "node")
    asked = _texts_of(rows, asked).select("hub", "part", "side", "node", "text")
    asked = asked.repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        last: tuple | None = None
        for batch in batches:
            found = []
            for hub, part, side, node, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if (hub, part, node) == last:  # a repeated row
                    continue
                words = word_hashes(text.as_py())
                if content_key(words) != node:
                    continue
                last = (hub, part, node)
                mine = np.unique(shingles(words), return_counts=True)
                if side == 0:
                    at, own = (hub, part), mine
                elif at == (hub, part):
                    both = common(own, mine)
                    found.append((hub, node, both, both / (int(own[1].sum() + mine[1].sum()) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "both", "sim"])

    return asked.mapInArrow(run, "a long, b long, both long, sim double")


def own_shingles(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c1, own): how many shingles of each node (c1, rep) stand in no other of the nodes; nodes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = word_hashes(text.as_py())
                if content_key(words) == c1:
                    s, n = np.unique(shingles(words), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c1)), pa.array(s.view(np.int64)), pa.array(n)], names=["c1", "s", "n"])

    each = _texts_of(rows, nodes).select("c1", "text").mapInArrow(run, "c1 long, s long, n long")
    lone = each.groupBy("s").agg(F.min("c1").alias("c1"), F.max("c1").alias("_last"), F.max("n").alias("n")).where("c1 = _last")
    return lone.groupBy("c1").agg(F.sum("n").alias("own"))


def _leftovers(rows: DataFrame, keyed: DataFrame, hubs: DataFrame, held: DataFrame, comps: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(hub, member): pairs of a bucket that lie in different components, none of them its hub, and that can reach the threshold. held: as `verify` has it for the hubs.

    A text of size a that shares h shingles with all other candidates together reaches t with a text of size b only if h >= t (a + b) / (1 + t): so its
    partner has b <= reach = (1 + t) h / t - a. Texts of one origin with many edits of their own have no partner left, and drop out before any pair is made. For a pair, h is bounded once more by what both share with their bucket's hub, plus what either shares with others beside it.
    """
    named = keyed.join(comps.withColumnRenamed("node", "c1"), "c1", "left").withColumn("comp", F.coalesce("comp", "c1"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi and c > 2").select("key")
    left = named.join(mixed, "key").join(hubs, "key").where("c1 <> hub").join(held.select(F.col("a").alias("hub"), F.col("b").alias("c1"), "both"), ["hub", "c1"], "left")
    left = written(left.select("key", "hub", "c1", "comp", "size", F.coalesce("both", "size").alias("both")), "nd-left")
    nodes = left.select("c1").unionByName(left.select(F.col("hub").alias("c1"))).distinct()
    own = own_shingles(rows, nodes.join(reps.select("c1", "rep"), "c1"))
    step = 2 / math.log(1 / threshold) * (1 - 1e-9)  # two bins for the ratio of the threshold
    bin_ = lambda c: F.floor(F.log(c) * F.lit(step)).cast("int")
    reach = F.lit((1 + threshold) / threshold) * (F.col("size") - F.coalesce("own", F.lit(0))) - F.col("size") + F.lit(1e-6)
    alive = left.join(own, "c1", "left").withColumn("reach", reach).where(F.col("reach") >= threshold * F.col("size"))
    alive = written(alive.withColumn("beside", F.greatest(F.lit(0), F.col("size") - F.col("both") - F.coalesce("own", F.lit(0)))).drop("own", "hub"), "nd-alive")
    # x is the larger text of a pair, or as large.
    bins = F.sequence(bin_(F.lit(threshold * (1 - 1e-9)) * F.col("size")), bin_(F.least(F.col("size").cast("double"), F.col("reach"))))
    two = alive.where("reach >= size").select("key", F.col("c1").alias("y"), F.col("comp").alias("yc"), F.col("size").alias("ys"), F.col("reach").alias("yr"), F.col("both").alias("yb"), F.col("beside").alias("yd"), bin_(F.col("size").cast("double")).alias("bin"))
    some = two.groupBy("key", "bin").agg(F.min("yc").alias("lo"), F.max("yc").alias("hi"))
    one = alive.select("key", F.col("c1").alias("x"), F.col("comp").alias("xc"), F.col("size").alias("xs"), F.col("reach").alias("xr"), F.col("both").alias("xb"), F.col("beside").alias("xd"), F.explode(bins).alias("bin"))
    one = one.join(some, ["key", "bin"]).where("lo <> xc or hi <> xc").drop("lo", "hi")
    able = f"(least(xb, yb) + least(xd, yd)) * {(1 + threshold) / threshold * (1 + 1e-9)} >= xs + ys"
    met = one.join(two, ["key", "bin"]).where(F.expr(f"x <> y and xc <> yc and ys <= xs and ys <= xr and xs <= yr and ys >= {threshold} * xs and {able}"))
    out = written(met.select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("member")).distinct(), "nd-rest")
    discard(left, alive)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, kept, and tk, a hash of the text (null: null).

    Texts that agree word for word (without regard to case and blanks) are one node. Nodes that share a band are candidates. In a band's bucket
    the member that meets most others is the hub, and all are verified against it; what the hub does not tie together is
    compared across the parts that are left, where sizes and the shingles shared with others allow the threshold. class_id is the smallest doc_id of a component of verified
    links, null if none has one; kept marks the class's rows with the smallest (doc_id, tk), nulls last (repeated rows of it all). Multisets of five-word shingles; shorter
    texts are one shingle. Null texts and texts without words are classes of their own row's doc_id. Other columns are ignored. An empty table gives an empty result.
    A link at exactly the threshold is missed with a probability of about 6e-5 (no band shared).
    """
    texts = keyed_texts(docs)
    sketch = written(sketches(texts, bands, rows), "nd-sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    reps = written(sketch.groupBy("c1").agg(first.alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nd-reps")
    keyed = reps.select("c1", "size", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(met, "key"), "nd-buckets")
    reach = keyed.groupBy("c1").agg(F.sum("n").alias("reach"))
    hubs = keyed.join(reach, "c1").groupBy("key").agg(F.max(F.struct("reach", F.col("c1").alias("hub"))).alias("h")).select("key", "h.hub")
    hubs = written(hubs, "nd-hubs")
    pairs = written(keyed.join(hubs, "key").where("c1 <> hub").select("hub", F.col("c1").alias("member")).distinct(), "nd-pairs")
    held = written(verify(texts, pairs, reps), "nd-held")
    links = held.where(F.col("sim") >= threshold).select("a", "b")
    comps = written(components(links), "nd-comps")
    known = pairs.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member"))
    rest = _leftovers(texts, keyed, hubs, held, comps, reps, threshold).join(known, ["hub", "member"], "left_anti")
    rest = written(rest, "nd-rest")
    discard(keyed, hubs, pairs)
    if not rest.isEmpty():
        more = written(verify(texts, rest, reps).where(F.col("sim") >= threshold).select("a", "b"), "nd-links")
        comps = written(components(links.unionByName(more)), "nd-comps")
    nodes = reps.select("c1", "rep").join(comps.withColumnRenamed("node", "c1"), "c1", "left").withColumn("comp", F.coalesce("comp", "c1"))
    label = nodes.groupBy("comp").agg(F.min("rep").alias("own"))
    nodes = nodes.join(label, "comp").select("c1", "own")
    out = sketch.select("doc_id", "tk", "c1").join(nodes, "c1")
    kept = F.col("doc_id").eqNullSafe(F.col("own.doc_id")) & (F.col("tk") == F.col("own.tk"))
    out = out.select("doc_id", F.col("own.doc_id").alias("class_id"), kept.alias("kept"), "tk")
    blank = docs.where(F.col("text").isNull() | ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\t-\r\x1c- ]"))
    doc_id = F.col("doc_id").cast("long")
    blank = blank.select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(True).alias("kept"), F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string"))).alias("tk"))
    return out.unionByName(blank)
