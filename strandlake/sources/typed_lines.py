"""Typed line files as tables, and back: sequences, genome skeletons, annotations, alignments.

A file is a header and lines of a letter and its fields; texts and lists follow their length. Each partition becomes files of about FILE characters with a header each. A file is read as a whole, so one must fit a task,
but its lines are parsed one by one and leave Python HELD characters at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a file that is written, and of the values that leave Python at once, about; a row is never cut.
FILE, HELD = 1 << 24, 1 << 22
#: Fixed values of the format: for each kind of file its lines' fields: i whole number, c character, t text, l list of whole numbers, r real number.
SCHEMAS = {
    "seq": {"s": "it", "n": "ci", "S": "t", "I": "t", "M": "l", "u": ""},
    "gdb": {"f": "rrrr", "u": "", "S": "t", "G": "i", "C": "i", "M": "l"},
    "ano": {"g": "", "S": "t", "G": "i", "C": "i", "M": "iii", "L": "t", "X": "i", "P": "l"},
    "aln": {"t": "i", "g": "", "S": "t", "G": "i", "C": "i", "a": "", "p": "ii", "A": "iiiiii", "L": "ii", "R": "", "D": "i", "T": "l", "X": "l", "Q": "i", "E": "i", "Z": "t", "U": "i"},
}


def line(letter: str, *fields) -> str:
    """One line; texts and lists get their length in front."""
    out = [letter]
    for x in fields:
        out += [str(len(x)), x] if isinstance(x, str) and len(x) != 1 or x == "" else [str(len(x)), *map(str, x)] if isinstance(x, (list, tuple)) else [str(x)]
    return " ".join(out)


def text_line(letter: str, *fields) -> str:
    """As line, for a last field that is a text of any length."""
    return " ".join([letter, *map(str, fields[:-1]), str(len(fields[-1])), fields[-1]])


def parsed(kind: str, text: str) -> Iterator[tuple]:
    """(letter, fields...) of the lines of a file of a kind; its header's kind must be that one, and lines it does not know are errors."""
    schema = SCHEMAS[kind]
    first = text[: text.find("\n")] if "\n" in text else text
    head = first.split(" ")
    if len(head) < 3 or head[0] != "1" or head[2] != kind:
        raise ValueError(f"no {kind} file: {first[:40]!r}")
    at = len(first) + 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        row, at = text[at:end], end + 1
        if not row or row[0] in "~!#+@<>.-/%":
            continue
        if row[0] not in schema:
            raise ValueError(f"a {kind} file has no lines {row[0]}")
        rest, out = row[2:], [row[0]]
        for k in schema[row[0]]:
            if k in "tl":
                n, _, rest = rest.partition(" ")
                if k == "t":
                    out.append(rest[: int(n)])
                    rest = rest[int(n) + 1 :]
                else:
                    parts = rest.split(" ", int(n))
                    out.append([int(x) for x in parts[: int(n)]])
                    rest = parts[int(n)] if len(parts) > int(n) else ""
            else:
                x, _, rest = rest.partition(" ")
                out.append(x if k == "c" else float(x) if k == "r" else int(x))
        yield tuple(out)


def _read(spark: SparkSession, path: str, kind: str, schema: str, rows_of: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    want = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(want)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows, held = [], 0
                for row in rows_of(parsed(kind, text.as_py())):
                    rows.append(row)
                    held += 64 + sum(len(x) for x in row if isinstance(x, (str, list)))
                    if held > HELD:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return spark.read.text(path, wholetext=True).select("value").mapInArrow(run, schema)


def _write(rows: DataFrame, path: str, kind: str, lines_of: Callable[..., list[str]], first: tuple[str, ...] = ()) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = "\n".join([f"1 {len(kind)} {kind} 2 1", *first])
        made = lambda own: pa.RecordBatch.from_arrays([pa.array(["\n".join([head, *own])], pa.string())], names=["value"])
        out, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                out.append("\n".join(lines_of(*(x.as_py() for x in row))))
                size += len(out[-1]) + 64
                if size > FILE:
                    yield made(out)
                    out, size = [], 0
        if out:
            yield made(out)

    rows.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_sequences(scaffolds: DataFrame, path: str) -> None:
    """Write scaffolds (name, seq): sequences of a, c, g, t between runs of other characters, lower-case runs as masks where a sequence has upper case too."""

    def lines(name: str, seq: str) -> list[str]:
        out = [text_line("s", len(seq), name)]
        for m in re.finditer("[acgtACGT]+|[^acgtACGT]+", seq):
            run = m[0]
            if run[0] in "acgtACGT":
                out.append(text_line("S", run.lower()))
                spans = [x for w in re.finditer("[a-z]+", run) for x in w.span()]
                if re.search("[A-Z]", run) and spans:
                    out.append(line("M", spans))
                elif re.search("[A-Z]", run):
                    out.append(line("M", []))
            else:
                out += [f"n {c[0]} {len(c)}" for c in (k[0] for k in re.finditer(r"(.)\1*", run))]
        return out

    _write(scaffolds.where("seq is not null").select("name", "seq"), path, "seq", lines)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): scaffolds put together, or sequences on their own (I names them, else their number); files that mix both are errors. Bases are lower-case unless a mask line makes those outside it upper-case."""

    def rows(lines: Iterator[tuple]) -> Iterator[tuple]:
        name, parts, mode, plain, n = None, [], None, None, 0
        for x in lines:
            if x[0] == "s":
                if mode == "plain":
                    raise ValueError("sequences with and without scaffolds in one file")
                if mode:
                    yield name, "".join(parts)
                name, parts, mode = x[2], [], "scaffolds"
            elif x[0] == "n":
                parts.append(x[1] * x[2])
            elif x[0] == "S":
                if mode is None:
                    mode = "plain"
                if mode == "plain":
                    if plain:
                        yield tuple(plain)
                    n += 1
                    plain = [str(n), x[1]]
                else:
                    parts.append(x[1])
            elif x[0] == "I" and plain:
                plain[0] = x[1]
            elif x[0] == "M":
                own = plain if mode == "plain" else parts
                seq, last = [], 0
                for b, e in sorted(zip(x[1][::2], x[1][1::2], strict=True)):
                    seq += [own[-1][last:b].upper(), own[-1][max(last, b) : e]]
                    last = max(last, e)
                own[-1] = "".join([*seq, own[-1][last:].upper()])
        if mode == "scaffolds":
            yield name, "".join(parts)
        if plain:
            yield tuple(plain)

    return _read(spark, path, "seq", "name string, seq string", rows)


def write_skeleton(scaffolds: DataFrame, contigs: DataFrame, path: str) -> None:
    """Write the names of scaffolds (scaf, name, slen) with their contigs (scaf, sbeg, clen) and gaps."""
    own = contigs.groupBy("scaf").agg(F.array_sort(F.collect_list(F.struct("sbeg", "clen"))).alias("c"))  # one scaffold's own

    def lines(name: str, slen: int, held: list | None) -> list[str]:
        out, at = [text_line("S", name)], 0
        for c in held or []:
            out += [f"G {c['sbeg'] - at}"] if c["sbeg"] > at else []
            out.append(f"C {c['clen']}")
            at = c["sbeg"] + c["clen"]
        return [*out, f"G {slen - at}"] if slen > at else out

    _write(scaffolds.join(own, "scaf", "left").select("name", "slen", "c"), path, "gdb", lines)


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    """(name, slen, contigs: array of (sbeg, clen)) of each scaffold."""

    def rows(lines: Iterator[tuple]) -> Iterator[tuple]:
        name, at, held = None, 0, []
        for x in lines:
            if x[0] == "S":
                if name is not None:
                    yield name, at, held
                name, at, held = x[1], 0, []
            elif x[0] in "GC":
                if x[0] == "C":
                    held.append({"sbeg": at, "clen": x[1]})
                at += x[1]
        if name is not None:
            yield name, at, held

    return _read(spark, path, "gdb", "name string, slen long, contigs array<struct<sbeg: long, clen: long>>", rows)


def write_annotations(rows: DataFrame, path: str) -> None:
    """Write annotations (scaf, beg, end, orient, score, label, parse); those with orient 1 run from end to beg."""

    def lines(scaf: int, beg: int, end: int, orient: int, score: int, label: str | None, parse: list | None) -> list[str]:
        out = [f"M {scaf} {end} {beg}" if orient else f"M {scaf} {beg} {end}"]
        out += [text_line("L", label)] if label is not None else []
        out += [f"X {score}"] if score else []
        return [*out, line("P", parse)] if parse else out

    _write(rows.select("scaf", "beg", "end", "orient", "score", "label", "parse"), path, "ano", lines)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(scaf, beg, end, orient, score, label, parse)."""

    def rows(lines: Iterator[tuple]) -> Iterator[tuple]:
        own: list | None = None
        for x in lines:
            if x[0] == "M":
                if own:
                    yield tuple(own)
                turned = x[2] > x[3]
                own = [x[1], min(x[2:4]), max(x[2:4]), int(turned), 0, None, None]
            elif own and x[0] in "LXP":
                own[{"L": 5, "X": 4, "P": 6}[x[0]]] = x[1]
        if own:
            yield tuple(own)

    return _read(spark, path, "ano", "scaf long, beg long, end long, orient int, score int, label string, parse array<long>", rows)


def write_alignments(rows: DataFrame, path: str, spacing: int = 100) -> None:
    """Write alignments (actg, abpos, aepos, bctg, bbpos, bepos, comp, diffs, tpoints, tdiffs) with the spacing of their trace points."""

    def lines(a: int, ab: int, ae: int, b: int, bb: int, be: int, comp: bool, diffs: int, points: list, each: list) -> list[str]:
        return [f"A {a} {ab} {ae} {b} {bb} {be}", *(["R"] if comp else []), f"D {diffs}", line("T", points), line("X", each)]

    _write(rows.select("actg", "abpos", "aepos", "bctg", "bbpos", "bepos", "comp", "diffs", "tpoints", "tdiffs"), path, "aln", lines, (f"t {spacing}",))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(actg, abpos, aepos, bctg, bbpos, bepos, comp, diffs, tpoints, tdiffs, spacing); a file without a spacing is an error."""

    def rows(lines: Iterator[tuple]) -> Iterator[tuple]:
        own, spacing = None, None
        for x in lines:
            if x[0] == "t":
                spacing = x[1]
            elif x[0] == "A":
                if spacing is None:
                    raise ValueError("no trace point spacing before the first alignment")
                if own:
                    yield tuple(own)
                own = [*x[1:], False, 0, [], [], spacing]
            elif own and x[0] in "RDTX":
                own[{"R": 6, "D": 7, "T": 8, "X": 9}[x[0]]] = True if x[0] == "R" else x[1]
        if own:
            yield tuple(own)

    return _read(spark, path, "aln", "actg long, abpos long, aepos long, bctg long, bbpos long, bepos long, comp boolean, diffs long, tpoints array<long>, tdiffs array<long>, spacing long", rows)
