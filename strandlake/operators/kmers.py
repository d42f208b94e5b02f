"""k-mers as packed numbers, and an index of the k-mers that start at closed syncmers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators import intervals
from strandlake.operators.ordered import running
from strandlake.operators.sequences import codes

#: Bases of a k-mer, of a syncmer and of the words whose ranks pick it.
K, SYNCMER, WORD = 40, 12, 8
#: Bases in the first of a k-mer's two numbers.
HALF = 20
#: Rank of each 4-mer, by a rule; any other permutation of 0 to 255 can be given in its place, as the genome at hand wants.
RANKS = tuple((w * 167 + 13) % 256 for w in range(256))


def word_codes(code: np.ndarray, k: int) -> np.ndarray:
    """The numbers (base 4, first base highest) of all runs of k <= 31 bases, by doubling."""
    if len(code) < k:
        return np.zeros(0, dtype=np.int64)
    out, have, power, width = None, 0, code.astype(np.int64), 1
    while k:
        if k & 1:
            out = power if out is None else (out[: len(power) - have] << (2 * width)) | power[have : have + len(out[: len(power) - have])]
            have += width
        k >>= 1
        if k:
            power = (power[: len(power) - width] << (2 * width)) | power[width:]
            width *= 2
    return out


def word_ranks(ranks: Sequence[int] = RANKS) -> np.ndarray:
    """The rank of each of the 65,536 8-mers: the smaller of its own and its complement's."""
    table = np.asarray(ranks, dtype=np.int64)
    if sorted(table.tolist()) != list(range(256)):
        raise ValueError("ranks are no permutation of 0 to 255")
    w = np.arange(1 << 16)
    own = table[w >> 8] << 8 | table[w & 255]
    other, rest = np.zeros_like(w), w.copy()
    for _ in range(WORD):
        other, rest = other << 2 | (3 - (rest & 3)), rest >> 2
    return np.minimum(own, own[other])


def syncmers(code: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The starts of the 12-mers whose first or last 8-mer has the least rank of their five."""
    r = rank[word_codes(code, WORD)]
    n = len(r) - (SYNCMER - WORD)
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = np.minimum.reduce([r[i : i + n] for i in range(SYNCMER - WORD + 1)])
    return np.flatnonzero((r[:n] == least) | (r[SYNCMER - WORD : SYNCMER - WORD + n] == least))


def check_k(k: int) -> int:
    if k % 4 or not 2 * HALF >= k >= HALF:
        raise ValueError(f"{k} is no multiple of 4 from {HALF} to {2 * HALF}")
    return k


def _pairs(code: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    first, rest = word_codes(code, HALF), word_codes(code, k - HALF) if k > HALF else np.zeros(len(code) + 1, dtype=np.int64)
    return first[at], rest[at + HALF] if k > HALF else np.zeros(len(at), dtype=np.int64)


def index(seqs: DataFrame, key: str, k: int = K, ranks: Sequence[int] = RANKS) -> DataFrame:
    """(key, pos, neg, k1, k2): the k-mers at the syncmers of sequences (key, seq), both strands.

    A syncmer at j gives the k-mer from j (pos j) and the complement of the k bases that end where it ends (pos j + 12, neg), where they fit. k1 holds the first 20
    bases, k2 the others, first base highest, so (k1, k2) sorts as the letters do. Null and short sequences give nothing.
    """
    check_k(k)
    rank = word_ranks(ranks)
    names = [key, "pos", "neg", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                code = codes(batch.column(1)[row].as_py())
                at = syncmers(code, rank)
                ahead, back = at[at <= len(code) - k], at[at >= k - SYNCMER]
                a1, a2 = _pairs(code, ahead, k)
                b1, b2 = _pairs((3 - code)[::-1], len(code) - (back + SYNCMER), k)
                n = len(ahead) + len(back)
                if n:
                    cols = [np.concatenate(x) for x in ((ahead, back + SYNCMER), (np.zeros(len(ahead), bool), np.ones(len(back), bool)), (a1, b1), (a2, b2))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, row))), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=names)

    kind = f"`{key}` {seqs.schema[key].dataType.simpleString()}, pos long, neg boolean, k1 long, k2 long"
    return seqs.where(F.length("seq") >= k).select(key, "seq").mapInArrow(run, kind)


def spelled(k1: Column, k2: Column, k: int = K) -> Column:
    """The letters of a packed k-mer."""
    base = lambda c, left: F.substring(F.lit("acgt"), (F.shiftright(c, 2 * left).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return F.concat(*[base(k1, HALF - 1 - i) for i in range(HALF)], *[base(k2, k - HALF - 1 - i) for i in range(k - HALF)])


def lcp(a1: Column, a2: Column, b1: Column, b2: Column, k: int = K) -> Column:
    """Leading bases that two packed k-mers have in common."""
    same = lambda x, y, n: n - F.expr("0") - F.ceil(F.when(x == y, 0).otherwise(F.length(F.bin(x.bitwiseXOR(y)))) / 2)
    return F.when(a1 == b1, HALF + same(a2, b2, k - HALF)).otherwise(same(a1, b1, HALF)).cast("int")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def common(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray, k: int) -> np.ndarray:
    """Leading bases that k-mers have in common."""
    return np.where(a1 == b1, HALF + (k - HALF) - (_bits(a2 ^ b2) + 1) // 2, HALF - (_bits(a1 ^ b1) + 1) // 2)


def with_lcp(rows: DataFrame, k: int = K) -> DataFrame:
    """rows (k1, k2, ...) with lcp: the bases in common with the k-mer before in the order of all k-mers (0 for the first of a 12-mer, k for an equal one).

    Windows go by the first 12 bases, so k-mers that share fewer are not compared; equal k-mers are compared once.
    """
    each = rows.groupBy("k1", "k2").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(F.shiftright("k1", 2 * (HALF - SYNCMER))).orderBy("k1", "k2")
    with_last = each.select("k1", "k2", F.lag("k1").over(order).alias("_p1"), F.lag("k2").over(order).alias("_p2"))
    first = with_last.select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), F.when(F.col("_p1").isNull(), 0).otherwise(lcp(F.col("k1"), F.col("k2"), F.col("_p1"), F.col("_p2"), k)).alias("_first"))
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*[c for c in rows.columns if c not in ("k1", "k2")]))
    both = rows.withColumn("_turn", turn).join(first, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")))
    return both.select(*rows.columns, F.when(F.col("_turn") == 1, F.col("_first")).otherwise(k).cast("int").alias("lcp"))


def lcp_counts(seqs: DataFrame, k: int = K, ranks: Sequence[int] = RANKS, at_once: int = 1 << 21) -> DataFrame:
    """(lcp, n): how many k-mers of the index of sequences (seq) have how many bases in common with the one before, as `with_lcp` has them.

    k-mers are dealt out by their first 12 bases, ten bytes each and nothing else; a part is sorted in as many turns (by a hash of these bases) as it wants.
    """
    check_k(k)
    rank, shift = word_ranks(ranks), 2 * (HALF - SYNCMER)
    mixed = lambda k1: ((k1 >> shift) * 0x9E3779B1) >> 7

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        k1, k2 = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (mixed(k1) % PARTS).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        five = [x[order].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].copy() for x in (k1, k2)]
        at = np.concatenate((np.zeros(1, dtype=np.int64), np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])).tolist()
        cols = [pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary()) for x in five]
        return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), *cols], names=["part", "k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for seq in batch.column(0):
                code = codes(seq.as_py())
                at = syncmers(code, rank)
                ahead, back = at[at <= len(code) - k], at[at >= k - SYNCMER]
                held += [x for x in (_pairs(code, ahead, k), _pairs((3 - code)[::-1], len(code) - (back + SYNCMER), k)) if len(x[0])]
                size += len(ahead) + len(back)
                if size > CUT:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def whole(data: list[bytes]) -> np.ndarray:
        five = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 5)
        return sum(five[:, i].astype(np.int64) << 8 * i for i in range(5))

    def count(own: pa.Table) -> pa.Table:
        a1, a2 = (whole(own.column(c).to_pylist()) for c in ("k1", "k2"))
        turns = -(-len(a1) // at_once)
        found = np.zeros(k + 1, dtype=np.int64)
        for turn in range(turns):
            k1, k2 = a1, a2
            if turns > 1:
                mine = (mixed(a1) // PARTS) % turns == turn
                k1, k2 = a1[mine], a2[mine]
            order = np.lexsort((k2, k1))
            k1, k2 = k1[order], k2[order]
            same = common(k1[1:], k2[1:], k1[:-1], k2[:-1], k)
            found += np.bincount(np.where(same < SYNCMER, 0, same), minlength=k + 1)
            found[0] += min(1, len(k1))
        some = np.flatnonzero(found)
        return pa.table({"lcp": pa.array(some, pa.int32()), "n": pa.array(found[some], pa.int64())})

    rows = seqs.where(F.length("seq") >= k).select("seq").mapInArrow(cut, "part int, k1 binary, k2 binary")
    return rows.groupBy("part").applyInArrow(count, "lcp int, n long").groupBy("lcp").agg(F.sum("n").alias("n"))


def with_mask(rows: DataFrame, mask: DataFrame, key: str, k: int = K) -> DataFrame:
    """rows (key, pos, neg, ...) with mask: how many bases of the k-mer, from its start, lie in the interval of mask (key, beg, end; none overlap) that holds its post.

    A forward k-mer runs up from pos, a complement's down from it.
    """
    base = F.when(F.col("neg"), F.col("pos") - 1).otherwise(F.col("pos"))
    at = rows.withColumn("_at", base)
    spans = mask.select(key, F.col("beg").alias("rbeg"), F.col("end").alias("rend"))
    hit = intervals.holding(at.select(key, "pos", "neg", "_at").distinct(), spans, key, "_at")
    hit = hit.select(F.col(key).alias("_k"), F.col("pos").alias("_p"), F.col("neg").alias("_s"), F.least(F.lit(k), F.when(F.col("neg"), F.col("pos") - F.col("rbeg")).otherwise(F.col("rend") - F.col("pos"))).cast("int").alias("mask"))
    both = rows.join(hit, (F.col(key) == F.col("_k")) & (F.col("pos") == F.col("_p")) & (F.col("neg") == F.col("_s")), "left")
    return both.select(*rows.columns, F.coalesce("mask", F.lit(0)).alias("mask"))


def length_ranks(contigs: DataFrame, key: str) -> DataFrame:
    """(key, clen, crank): contigs numbered from 0, the longest first, ties by key; lengths go in bins, so no task sorts them all."""
    sizes = contigs.groupBy("clen").agg(F.count("*").alias("n"))
    before = running(sizes, "clen", "n", "_upto", descending=True).select(F.col("clen").alias("_len"), (F.col("_upto") - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("clen").orderBy(key))
    return contigs.withColumn("_own", own).join(before, F.col("clen") == F.col("_len")).select(key, "clen", (F.col("_before") + F.col("_own") - 1).cast("long").alias("crank"))


def prefix_counts(rows: DataFrame, bases: int = SYNCMER) -> DataFrame:
    """(prefix, n): k-mers by their first bases, as a number."""
    return rows.groupBy(F.shiftright("k1", 2 * (HALF - bases)).alias("prefix")).agg(F.count("*").alias("n"))


def sharing(rows: DataFrame, others: DataFrame, bases: int = SYNCMER) -> DataFrame:
    """The rows of an index whose first bases begin a k-mer of the index `others` too.

    What others begin with is one row, a bit for each of the 4**bases prefixes (2 MB for 12 bases, however long the indices are), so rows are looked up where they are made.
    """
    wide = 2 * (HALF - bases)
    word, bit = f"shiftright(k1, {wide + 6})", f"cast(shiftright(k1, {wide}) & 63 as int)"
    held = others.select(F.expr(word).alias("_w"), F.expr(f"shiftleft(1L, {bit})").alias("_b")).unionByName(rows.sparkSession.range(4**bases // 64).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_b")))
    marks = held.groupBy("_w").agg(F.bit_or("_b").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_w", "_b"))).alias("_x")).select(F.transform("_x", lambda x: x["_b"]).alias("_marks"))
    known = F.expr(f"shiftrightunsigned(get(_marks, cast({word} as int)), {bit}) & 1L = 1L")
    return rows.join(F.broadcast(marks), known, "left_semi")


def _bound(prefix: str) -> tuple[int, int]:
    value = int("".join(str("acgt".index(b)) for b in prefix.lower()) or "0", 4)
    return value << 2 * (HALF - len(prefix)), (value + 1) << 2 * (HALF - len(prefix))


def prefix_range(rows: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """The k-mers from prefix `first` to prefix `last` (inclusive; without last: those that start with first), prefixes of at most 20 bases; a pushed-down range of k1."""
    lo, hi = _bound(first)[0], _bound(last if last is not None else first)[1]
    return rows.where((F.col("k1") >= lo) & (F.col("k1") < hi))


def lookup(rows: DataFrame, kmer: str) -> DataFrame:
    """The rows of one k-mer."""
    code = codes(kmer).astype(np.int64)
    return rows.where((F.col("k1") == int(word_codes(code, HALF)[0])) & (F.col("k2") == (int(word_codes(code[HALF:], len(kmer) - HALF)[0]) if len(kmer) > HALF else 0)))


def stored(rows: DataFrame, path: str) -> DataFrame:
    """Write an index in the order of its k-mers, a range a file, and read it again: ranges and lookups then skip files and row groups."""
    rows.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def words(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pos, k1, k2) of all k-mers (k <= 40) of sequences (key, seq); k2 is 0 for k <= 20."""
    if not 1 <= k <= 2 * HALF:
        raise ValueError(f"k-mers have 1 to {2 * HALF} bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                code = codes(batch.column(1)[row].as_py())
                n = len(code) - k + 1
                first = word_codes(code, min(k, HALF))[:n]
                rest = word_codes(code[HALF:], k - HALF) if k > HALF else np.zeros(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, row))), pa.array(np.arange(n)), pa.array(first), pa.array(rest)], names=[key, "pos", "k1", "k2"])

    kind = f"`{key}` {seqs.schema[key].dataType.simpleString()}, pos long, k1 long, k2 long"
    return seqs.where(F.length("seq") >= k).select(key, "seq").mapInArrow(run, kind)


def histogram(rows: DataFrame, low: int = 1, high: int | None = None, distinct: bool = True) -> DataFrame:
    """(count, kmers): how many different k-mers of rows (k1, k2) occur how often, or (not distinct) how many occurrences they have; counts below low are in low, those above high in high."""
    each = rows.groupBy("k1", "k2").agg(F.count("*").alias("count"))
    count = F.greatest(F.lit(low).cast("long"), F.col("count"))
    count = count if high is None else F.least(F.lit(high).cast("long"), count)
    return each.select(count.alias("count"), (F.lit(1).cast("long") if distinct else F.col("count")).alias("w")).groupBy("count").agg(F.sum("w").alias("kmers"))


#: Bases of the words whose hashes deal k-mers out, parts that they are dealt out to, bases that are cut at once, k-mers that are counted at once.
MINIMIZER, PARTS, CUT, COUNTED = 15, 4096, 1 << 20, 1 << 21


def _runs(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, k-mers, part) of the runs of neighbouring k-mers, 255 at most, that hold the same least hash of a word; equal k-mers have equal parts."""
    m = min(MINIMIZER, k)
    h = word_codes(code, m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    have, want = 1, k - m + 1
    while have < want:
        step = min(have, want - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    cuts = np.concatenate((np.zeros(1, dtype=np.int64), np.flatnonzero(h[1:] != h[:-1]) + 1))
    size = np.diff(np.append(cuts, len(h)))
    times = (size + 254) // 255
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = np.repeat(cuts, times) + 255 * turn
    return start, np.minimum(255, np.repeat(size, times) - 255 * turn), (h[start] % np.uint64(PARTS)).astype(np.int32)


def _cut(codes_of: list[np.ndarray], k: int) -> pa.RecordBatch:
    """(part, sizes, bases): a row a part with the runs of k-mers of some sequences: how many k-mers each holds, in a byte, and its bases in two bits each, filled up to whole bytes."""
    found, off = [], 0
    for code in codes_of:
        start, size, part = _runs(code, k)
        found.append((start + off, size, part))
        off += len(code)
    start, size, part = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(part, kind="stable")
    start, size, part = start[order], size[order], part[order]
    wide = size + k - 1
    room = (wide + 3) // 4
    first = np.cumsum(room) - room
    out = np.zeros(4 * int(room.sum()), dtype=np.uint8)
    turn = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    out[np.repeat(4 * first, wide) + turn] = np.concatenate(codes_of)[np.repeat(start, wide) + turn]
    four = out.reshape(-1, 4)
    bits = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()
    small = size.astype(np.uint8).tobytes()
    at = np.concatenate((np.zeros(1, dtype=np.int64), np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    byte = np.append(first, len(four))[at].tolist()
    at = at.tolist()
    rows = [small[i:j] for i, j in zip(at, at[1:], strict=False)], [bits[i:j] for i, j in zip(byte, byte[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), *(pa.array(x, pa.binary()) for x in rows)], names=["part", "sizes", "bases"])


def _kmers_of(size: np.ndarray, bits: np.ndarray, k: int, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k1, k2) of runs of k-mers, some runs at a time."""
    room = (size + k + 2) // 4
    ends = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(room)))
    for i in range(0, len(size), step):
        own, b = size[i : i + step], bits[ends[i] : ends[min(i + step, len(size))]]
        code = np.stack((b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3), axis=1).ravel()
        at = np.repeat(4 * (ends[i : i + len(own)] - ends[i]), own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        first = word_codes(code, min(k, HALF))
        rest = word_codes(code, k - HALF)[at + HALF] if k > HALF else np.zeros(len(at), dtype=np.int64)
        yield first[at], rest


def frequencies(seqs: DataFrame, k: int, at_once: int = COUNTED) -> DataFrame:
    """(count, n): how many different k-mers of sequences (seq) occur how often.

    Neighbouring k-mers travel together, as the bases of a run that share the least hash of their words: about a byte a k-mer, whereas a row a k-mer has two dozen. A part's runs are unpacked and counted
    in as many turns (by a hash of the k-mer) as its k-mers want, so a very common word makes a part long, not large.
    """
    if not 1 <= k <= 2 * HALF:
        raise ValueError(f"k-mers have 1 to {2 * HALF} bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for seq in batch.column(0):
                code = codes(seq.as_py())
                for i in range(0, len(code) - k + 1, CUT):
                    held.append(code[i : i + CUT + k - 1])
                    size += len(held[-1])
                    if size >= CUT:
                        yield _cut(held, k)
                        held, size = [], 0
        if held:
            yield _cut(held, k)

    def count(own: pa.Table) -> pa.Table:
        size = np.frombuffer(b"".join(own.column("sizes").to_pylist()), dtype=np.uint8).astype(np.int64)
        bits = np.frombuffer(b"".join(own.column("bases").to_pylist()), dtype=np.uint8)
        turns = -(-int(size.sum()) // at_once)
        found: dict[int, int] = {}
        for turn in range(turns):
            parts = []
            for k1, k2 in _kmers_of(size, bits, k):
                if turns > 1:
                    mine = ((k1 * 31 + k2) * 0x2545F491 >> 20) % turns == turn
                    k1, k2 = k1[mine], k2[mine]
                parts.append((k1, k2))
            k1, k2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((k2, k1))
            k1, k2 = k1[order], k2[order]
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            times = np.diff(np.concatenate(([0], new, [len(k1)]))) if len(k1) else np.zeros(0, dtype=np.int64)
            for c, n in zip(*(x.tolist() for x in np.unique(times, return_counts=True)), strict=True):
                found[c] = found.get(c, 0) + n
        return pa.table({"count": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    runs = seqs.where(F.length("seq") >= k).select("seq").mapInArrow(cut, "part int, sizes binary, bases binary")
    each = runs.groupBy("part").applyInArrow(count, "count long, n long")
    return each.groupBy("count").agg(F.sum("n").alias("n"))


def histogram_of(seqs: DataFrame, k: int, low: int = 1, high: int | None = None, distinct: bool = True) -> DataFrame:
    """What `histogram` gives for all k-mers of sequences (seq), by `frequencies`."""
    count = F.greatest(F.lit(low).cast("long"), F.col("count"))
    count = count if high is None else F.least(F.lit(high).cast("long"), count)
    weight = F.col("n") if distinct else F.col("count") * F.col("n")
    return frequencies(seqs, k).select(count.alias("count"), weight.alias("w")).groupBy("count").agg(F.sum("w").alias("kmers"))


def profiles(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, profile): for each sequence how often its k-mers occur in all sequences, in the order of their positions (one sequence's own array)."""
    rows = words(seqs, key, k)
    each = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    own = rows.join(each, ["k1", "k2"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("x"))
    return own.select(key, F.transform("x", lambda x: x["n"]).alias("profile"))
