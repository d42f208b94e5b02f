"""Sequences as DataFrames: contigs between runs of N, masks, complements, base counts, packing, pieces, coordinate maps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("acgt" * 7)[:26]
#: Bytes, about, that rows made of several sequences hold before they leave Python.
HELD = 1 << 22


_ASCII = (_LETTERS + _LETTERS.upper()).encode()
_OTHERS = bytes(x for x in range(256) if x not in _ASCII)
_PLAIN = bytes.maketrans(_ASCII, 2 * _BASES.encode())
_CASED = bytes.maketrans(_ASCII + b".", (_BASES + _BASES.upper() + "N").encode())


def _translated(text: Column, table: bytes, drop: bytes, lower: bool) -> Column:
    """The bytes of a text by a table, some of them left out; Spark's own translate looks each character up in a map of strings. lower: the two other characters whose lower case is an ASCII letter count as such."""

    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        if lower and not x.isascii():
            x = x.replace("\u212a".encode(), b"k").replace("\u0130".encode(), b"i")
        return x.translate(table, drop)

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([one(v.as_py()) for v in x.cast(pa.binary())], pa.binary()).cast(pa.string())

    return run(text)


def dna(text: Column) -> Column:
    """The letters a to z of a text in lower case as bases, a deterministic bridge from prose to sequence."""
    return _translated(text, _PLAIN, _OTHERS, True)


def gapped_dna(text: Column) -> Column:
    """The letters of a text as bases in their own case, and each full stop as an N."""
    return _translated(text, _CASED, _OTHERS.replace(b".", b""), False)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def numeric(seq: Column) -> Column:
    """The bases as digits: a 0, c 1, g 2, t 3."""
    return F.translate(F.lower(seq), "acgt", "0123")


def from_numeric(digits: Column) -> Column:
    return F.translate(digits, "0123", "acgt")


def piece(seq: Column, beg: Column, end: Column) -> Column:
    """The bases from beg to end (exclusive) of an ASCII sequence, at a cost that does not grow with beg."""
    return F.substring(seq.cast("binary"), beg.cast("int") + 1, (end - beg).cast("int")).cast("string")


def _mapped(df: DataFrame, keep: list[str], kind: str, make) -> DataFrame:
    """For each row of df its columns `keep`, and the columns of `kind` of each row that make(seq) yields."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [x.split()[0] for x in kind.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = [types[x.split()[1]] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols, held = [], [[] for _ in names], 0

            def out() -> pa.RecordBatch:
                own = batch.select(list(range(len(keep)))).take(pa.array(np.concatenate(at)))  # noqa: B023
                return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, t) for x, t in zip(cols, arrow, strict=True))], names=[*keep, *names])  # noqa: B023

            for row, seq in enumerate(batch.column(len(keep))):
                made = make(text := seq.as_py())
                size = len(made[0])
                if size:
                    at.append(np.full(size, row))
                    for x, y in zip(cols, made, strict=True):
                        x += y
                    held += len(text) + 32 * size
                if held > HELD:
                    yield out()
                    at, cols, held = [], [[] for _ in names], 0
            if at:
                yield out()

    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keep), kind])
    return df.where("seq is not null").select(*keep, "seq").mapInArrow(run, schema)


def contigs(scaffolds: DataFrame, min_gap: int = 0) -> DataFrame:
    """(scaf, ctg, sbeg, clen, seq) of scaffolds (scaf, seq): what lies between runs of other characters than a, c, g, t in either case; ctg counts from 0 in each scaffold.

    A run of fewer than min_gap characters is no gap: it becomes as many a's. Null sequences and those without bases have no contigs.
    """
    gap = re.compile("[^acgtACGT]+")

    def make(seq: str) -> tuple:
        if min_gap > 1:
            seq = gap.sub(lambda m: "a" * len(m[0]) if len(m[0]) < min_gap else m[0], seq)
        runs = [(m.start(), m[0]) for m in re.finditer("[acgtACGT]+", seq)]
        return range(len(runs)), [s for s, _ in runs], [len(r) for _, r in runs], [r for _, r in runs]

    return _mapped(scaffolds, ["scaf"], "ctg int, sbeg long, clen long, seq string", make)


def masks(seqs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, beg, end): the lower-case runs of the sequences that hold an upper-case base too."""

    def make(seq: str) -> tuple:
        runs = [m.span() for m in re.finditer("[a-z]+", seq)] if re.search("[A-Z]", seq) else []
        return [b for b, _ in runs], [e for _, e in runs]

    return _mapped(seqs, keep, "beg long, end long", make)


def soft_masked(seqs: DataFrame, mask: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, seq): upper-case sequences (keep, seq) with the intervals of mask (keep, beg, end) in lower case; overlaps do no harm."""
    own = mask.groupBy(*keep).agg(F.collect_list(F.struct(F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"))).alias("_m"))  # one sequence's own
    both = seqs.join(own, keep, "left").select(*keep, "seq", "_m")
    schema = both.select(*keep, "seq").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, spans in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                if seq is None:
                    out.append(None)
                    continue
                letters = np.frombuffer(seq.upper().encode("ascii"), dtype=np.uint8).copy()
                for x in spans or ():
                    letters[x["beg"] : x["end"]] |= 32
                out.append(letters.tobytes().decode("ascii"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "seq"])

    return both.mapInArrow(run, schema)


def pack(seq: str | None) -> bytes | None:
    """Four bases a byte, the first one in the highest bits; the last byte is filled with a's."""
    if seq is None:
        return None
    code = codes(seq)
    code = np.concatenate((code, np.zeros(-len(code) % 4, dtype=np.uint8))).reshape(-1, 4)
    return (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).tobytes()


def unpack(data: bytes | None, size: int | None) -> str | None:
    """The first `size` bases of what pack made."""
    if data is None or size is None:
        return None
    b = np.frombuffer(data, dtype=np.uint8)
    four = np.stack((b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3), axis=1).ravel()[:size]
    return np.frombuffer(b"acgt", dtype=np.uint8)[four].tobytes().decode("ascii")


def packed(seqs: DataFrame, key: str) -> DataFrame:
    """(key, len, bits): sequences in two bits a base, for storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if s is None else len(s) for s in own], pa.int64()), pa.array([pack(s) for s in own], pa.binary())], names=[key, "len", "bits"])

    return seqs.select(key, "seq").mapInArrow(run, f"`{key}` {seqs.schema[key].dataType.simpleString()}, len long, bits binary")


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """(key, seq) of what `packed` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpack(b, n) for n, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.string())], names=[key, "seq"])

    return rows.select(key, "len", "bits").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, seq string")


_CODE = np.zeros(256, dtype=np.uint8)
for _i, _b in enumerate("acgt"):
    _CODE[[ord(_b), ord(_b.upper())]] = _i


def codes(seq: str) -> np.ndarray:
    """0 to 3 for a, c, g, t in either case, 0 for all else."""
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]


def base_counts(seqs: DataFrame, key: str) -> DataFrame:
    """(key, len, a, c, g, t): bases without regard to case."""
    low = F.lower("seq")
    return seqs.select(key, F.length("seq").cast("long").alias("len"), *[(F.length("seq") - F.length(F.replace(low, F.lit(b), F.lit("")))).cast("long").alias(b) for b in "acgt"])


def to_scaffold(pos: Column, sbeg: Column, clen: Column, comp: Column) -> Column:
    """A position of a contig (of its complement, if comp) in the contig's scaffold."""
    return F.when(comp, sbeg + clen - pos).otherwise(sbeg + pos)


def to_contig(pos: Column, sbeg: Column, clen: Column, comp: Column) -> Column:
    """The inverse of to_scaffold."""
    return F.when(comp, sbeg + clen - pos).otherwise(pos - sbeg)


def complement_position(pos: Column, sbeg: Column, clen: Column, slen: Column) -> Column:
    """A position of a contig's complement, counted along the complement of the whole scaffold."""
    return slen - (sbeg + clen - pos)
