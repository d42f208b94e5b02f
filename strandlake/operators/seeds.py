"""Seeds of two sequences: exact k-mer matches, and adaptive ones by a longest-prefix-match join of two k-mer indices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.kmers import HALF, K, SYNCMER, common, sharing, words
from strandlake.storage import written

#: A k-mer that matches so many or more is left out.
FREQ = 10
#: Parts that the k-mers are dealt out to, by their first 12 bases.
BUCKETS = 64


def exact_seeds(a: DataFrame, b: DataFrame, k: int, cap: int) -> DataFrame:
    """(akey, apos, bkey, bpos) of the k-mers that a (akey, seq) and b (bkey, seq) share, without those that occur cap times or more in b.

    b is read once, and only its k-mers that a has go on: they are counted and joined.
    """
    asked = words(a, "akey", k).withColumnRenamed("pos", "apos")
    index = words(b, "bkey", k).withColumnRenamed("pos", "bpos").join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    rare = index.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") < cap).select("k1", "k2")
    return asked.join(rare, ["k1", "k2"], "left_semi").join(index, ["k1", "k2"]).select("akey", "apos", "bkey", "bpos")


class _Sorted:
    """Different k-mers with their weights, in order."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, k: int):
        order = np.lexsort((k2, k1))
        self.k1, self.k2, self.k = k1[order], k2[order], k
        self.upto = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(n[order])))
        self.first = np.unique(self.k1)
        self.key = np.searchsorted(self.first, self.k1) * (1 << 2 * (k - HALF)) + self.k2

    def range_of(self, a1: np.ndarray, a2: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the k-mers that share the first `size` bases (which at least one does) begin and end."""
        wide = 2 * np.maximum(0, HALF - size)
        low = a1 >> wide << wide
        lo, hi = np.searchsorted(self.k1, low), np.searchsorted(self.k1, low + (1 << wide))
        deep = size > HALF
        if deep.any():
            wide = 2 * (self.k - size[deep])
            low = np.searchsorted(self.first, a1[deep]) * (1 << 2 * (self.k - HALF)) + (a2[deep] >> wide << wide)
            lo[deep], hi[deep] = np.searchsorted(self.key, low), np.searchsorted(self.key, low + (1 << wide))
        return lo, hi

    def place(self, a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
        """How many k-mers come before each (a1, a2)."""
        at = np.searchsorted(self.first, a1)
        known = (at < len(self.first)) & (self.first[np.minimum(at, len(self.first) - 1)] == a1)
        return np.where(known, np.searchsorted(self.key, at * (1 << 2 * (self.k - HALF)) + np.where(known, a2, 0)), np.searchsorted(self.k1, a1))


_FOUND = "a1 long, a2 long, len int, b1 long, b2 long"


def _expanded(a1: np.ndarray, a2: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: _Sorted) -> pa.Table:
    n = hi - lo
    row = np.repeat(np.arange(len(a1)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return pa.table({"a1": a1[row], "a2": a2[row], "len": pa.array(size[row], pa.int32()), "b1": b.k1[at], "b2": b.k2[at]})


def _empty() -> pa.Table:
    return pa.table({"a1": pa.array([], pa.int64()), "a2": pa.array([], pa.int64()), "len": pa.array([], pa.int32()), "b1": pa.array([], pa.int64()), "b2": pa.array([], pa.int64())})


def longest_prefix_matches(a: DataFrame, b: DataFrame, freq: int = FREQ, k: int = K, buckets: int = BUCKETS) -> DataFrame:
    """(a1, a2, len, b1, b2): for each different k-mer of a those of b that share its longest matching prefix, 12 bases at least; none if they occur freq times or more in b.

    k-mers are counted first, so a repeat is one row however often it occurs, and dealt out by a hash of their first 12 bases. In each part the longest match of a k-mer
    is with a neighbour in sorted order, and all its matches stand next to each other.
    """
    part = F.pmod(F.xxhash64(F.shiftright("k1", 2 * (HALF - SYNCMER))), F.lit(buckets)).cast("int").alias("part")
    one = lambda df: df.groupBy("k1", "k2").agg(F.count("*").alias("n")).select(part, "k1", "k2", "n")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty()
        own = _Sorted(*(right.column(c).to_numpy() for c in ("k1", "k2", "n")), k)
        a1, a2 = left.column("k1").to_numpy(), left.column("k2").to_numpy()
        at = own.place(a1, a2)
        up, down = np.minimum(at, len(own.k1) - 1), np.maximum(at - 1, 0)
        size = np.maximum(common(a1, a2, own.k1[up], own.k2[up], k), common(a1, a2, own.k1[down], own.k2[down], k))
        some = size >= SYNCMER
        a1, a2, size = a1[some], a2[some], size[some]
        lo, hi = own.range_of(a1, a2, size)
        few = own.upto[hi] - own.upto[lo] < freq
        return _expanded(a1[few], a2[few], size[few], lo[few], hi[few], own)

    return one(a).groupBy("part").cogroup(one(b).groupBy("part")).applyInArrow(run, _FOUND)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k-mers of b that can match any of a, written once: a match has 12 bases at least, so the others are not dealt out."""
    return written(sharing(b, a), "index")


def adaptive_seeds(a: DataFrame, b: DataFrame, freq: int = FREQ, k: int = K, soft_mask: bool = False) -> DataFrame:
    """(len, actg, apos, bctg, bpos, comp) of the indices a and b (ctg, pos, neg, k1, k2, and mask with soft_mask): forward k-mers of a against both strands of b.

    With soft_mask a k-mer of either side that is masked over all of the match gives no seed; the cap holds before that.
    """
    ahead = a.where("not neg")
    b = _met(ahead, b)
    return _adaptive_seeds(ahead, b, freq, k, soft_mask)


def _adaptive_seeds(ahead: DataFrame, b: DataFrame, freq: int, k: int, soft_mask: bool = False) -> DataFrame:
    met = longest_prefix_matches(ahead, b, freq, k)
    own = ["mask"] if soft_mask else []
    left = ahead.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("ctg").alias("actg"), F.col("pos").alias("apos"), *[F.col(c).alias(f"a{c}") for c in own])
    right = b.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("ctg").alias("bctg"), F.col("pos").alias("bpos"), F.col("neg").alias("comp"), *[F.col(c).alias(f"b{c}") for c in own])
    out = met.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
    out = out.where("amask < len and bmask < len") if soft_mask else out
    return out.select("len", "actg", "apos", "bctg", "bpos", "comp")


def symmetric_seeds(a: DataFrame, b: DataFrame, freq: int = FREQ, k: int = K, unique: bool = True) -> DataFrame:
    """Seeds in both directions: those of `adaptive_seeds`, and those of the k-mers of b (both strands) against a of which the forward ones of a stay; unique drops what both have."""
    b = _met(a, b)
    met = longest_prefix_matches(b, a, freq, k)
    left = b.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("ctg").alias("bctg"), F.col("pos").alias("bpos"), F.col("neg").alias("comp"))
    right = a.where("not neg").select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("ctg").alias("actg"), F.col("pos").alias("apos"))
    back = met.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("len", "actg", "apos", "bctg", "bpos", "comp")
    both = _adaptive_seeds(a.where("not neg"), b, freq, k).unionByName(back)
    return both.distinct() if unique else both


def self_seeds(rows: DataFrame, freq: int = FREQ, k: int = K, buckets: int = BUCKETS) -> DataFrame:
    """(len, actg, apos, bctg, bpos, comp): each k-mer of an index (ctg, pos, neg, k1, k2), both strands, with all others that share its longest match with any other row.

    None if the k-mers that share it, itself included, are freq or more; comp: the strands differ.
    """
    part = F.pmod(F.xxhash64(F.shiftright("k1", 2 * (HALF - SYNCMER))), F.lit(buckets)).cast("int").alias("part")
    each = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).select(part, "k1", "k2", "n")

    def run(own: pa.Table) -> pa.Table:
        s = _Sorted(*(own.column(c).to_numpy() for c in ("k1", "k2", "n")), k)
        n = np.diff(s.upto)
        step = common(s.k1[1:], s.k2[1:], s.k1[:-1], s.k2[:-1], k) if len(s.k1) > 1 else np.zeros(0, dtype=np.int64)
        edge = np.zeros(1, dtype=np.int64)
        size = np.where(n > 1, k, np.maximum(np.concatenate((edge, step)), np.concatenate((step, edge))))
        some = size >= SYNCMER
        a1, a2, size = s.k1[some], s.k2[some], size[some]
        lo, hi = s.range_of(a1, a2, size)
        few = s.upto[hi] - s.upto[lo] < freq
        return _expanded(a1[few], a2[few], size[few], lo[few], hi[few], s)

    met = each.groupBy("part").applyInArrow(run, _FOUND)
    side = lambda p, c: rows.select(F.col("k1").alias(f"{p}1"), F.col("k2").alias(f"{p}2"), F.col("ctg").alias(f"{p}ctg"), F.col("pos").alias(f"{p}pos"), F.col("neg").alias(c))
    out = met.join(side("a", "_an"), ["a1", "a2"]).join(side("b", "_bn"), ["b1", "b2"])
    return out.where("not (actg = bctg and apos = bpos and _an = _bn)").select("len", "actg", "apos", "bctg", "bpos", (F.col("_an") != F.col("_bn")).alias("comp"))


def similarity(a: DataFrame, b: DataFrame, k: int = K) -> DataFrame:
    """(len, kmers, unique_kmers): how many k-mers of index a have a longest match of which length in b, and how many of them with a single row on both sides."""
    b = _met(a, b)
    met = longest_prefix_matches(a, b, 1 << 62, k)
    count = lambda df, x, y: df.groupBy(F.col("k1").alias(x), F.col("k2").alias(y)).agg(F.count("*").alias(f"n_{x}"))
    best = met.join(count(b, "b1", "b2"), ["b1", "b2"]).groupBy("a1", "a2", "len").agg(F.sum("n_b1").alias("nb"))
    best = best.join(count(a, "a1", "a2"), ["a1", "a2"])
    return best.groupBy("len").agg(F.sum("n_a1").alias("kmers"), F.sum(F.when((F.col("nb") == 1) & (F.col("n_a1") == 1), 1).otherwise(0)).cast("long").alias("unique_kmers"))
