"""Benchmark decontamination: pigeonhole pieces of each test item, exact piece hits, Myers' bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.runtime import written

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: UTF-8 bytes of the items that one pass over the documents looks for; more items take more passes.
PASS_BYTES = 4 << 20
_APART = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, one blank for each run of other characters than letters and digits, a blank at both ends; empty if nothing is left."""
    words = _APART.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): pattern in budget + 1 pieces of nearly equal lengths. Within `budget` edits one of them at least stays whole."""
    cuts = [i * len(pattern) // (budget + 1) for i in range(budget + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text, and the end of the first such substring."""
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(d | up)), up & d
        score += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        if score < best:
            best, end = score, j
    return best, end


class Finder:
    """All items of a pass: (item_id, normal text), texts unique."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, p, int(rate * len(p))) for i, p in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, p, k) in enumerate(self.items):
            for offset, piece in pieces(p, k):
                where.setdefault(piece, []).append((n, offset))
        self.machine = ahocorasick.Automaton()
        for piece, at in where.items():
            self.machine.add_word(piece, (len(piece), at))
        if where:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, words) of each item within its budget in text: its best place, the first of equals."""
        doc = normal(text)
        if not doc or not self.items:
            return []
        spans: dict[int, list[int]] = {}
        for end, (size, at) in self.machine.iter(doc):
            for n, offset in at:
                spans.setdefault(n, []).append(end + 1 - size - offset)
        out = []
        for n, starts in spans.items():
            item, p, k = self.items[n]
            m = len(p)
            exact = min((s for s in starts if s >= 0 and doc.startswith(p, s)), default=None)
            if exact is not None:
                best, a, b = 0, exact, exact + m
            else:
                best, a, b = k + 1, 0, 0
                windows: list[list[int]] = []
                for s in sorted(set(starts)):
                    lo, hi = max(0, s - k), min(len(doc), s + m + k)
                    if windows and lo <= windows[-1][1]:
                        windows[-1][1] = hi
                    else:
                        windows.append([lo, hi])
                for lo, hi in windows:
                    d, e = myers(p, doc[lo:hi])
                    if d < best:
                        back = myers(p[::-1], doc[max(lo, lo + e - m - k) : lo + e][::-1])[1]
                        best, a, b = d, lo + e - back, lo + e
            if best <= k:
                out.append((item, best, doc.count(" ", 0, a + 1) - doc.startswith(" ", a), len(doc[a:b].split())))
        return sorted(out)


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Lists of about PASS_BYTES of items with different normal texts; of equal ones the smallest item_id stays, whatever the number of passes."""

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())], names=["item_id", "p"])

    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    kept = written(named.mapInArrow(normalised, "item_id long, p string").where("p <> ''").groupBy("p").agg(F.min("item_id").alias("item_id")), "bd-items")
    size = kept.agg(F.sum(F.octet_length("p") + 1)).first()[0]
    n = -(-(size or 0) // PASS_BYTES)
    for i in range(n):
        yield sorted((r["item_id"], r["p"]) for r in kept.where(F.pmod(F.xxhash64("p"), F.lit(n)) == i).collect())  # bounded by PASS_BYTES, on average


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, first_word, words) for each row of docs (doc_id, text) and item (item_id, text) that it holds.

    An item of n normal characters (see `normal`) is held where some passage of the whole text is within floor(rate n) edits. Items with
    the same normal text are reported under their smallest item_id; null and wordless items and texts match nothing. Repeated rows match
    each for itself; a null doc_id is reported as such. first_word counts the text's words from 0. Other columns are ignored.
    """
    spark, kind = docs.sparkSession, "doc_id long, item_id long, distance int, first_word int, words int"
    out = spark.createDataFrame([], kind)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for some in _passes(items):

        def run(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            finder = Finder(some, rate)
            for batch in batches:
                found = [(d, *x) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in finder.find(text.as_py())]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=["doc_id", "item_id", "distance", "first_word", "words"])

        out = out.unionByName(rows.mapInArrow(run, kind))
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, with all columns, that hold no item (as `matches` has it). Null texts stay."""
    for some in _passes(items):

        def run(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            finder = Finder(some, rate)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not finder.find(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
