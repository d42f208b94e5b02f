"""The selection language: which parts of a genome to look at, as people write it, and as a table.

A location is a scaffold (a number from 1, `#` for the last, or a name), then optionally `.` and a contig of it, then optionally `:` and a position. `@` (scaffolds) or `.` (contigs)
alone is everything. A range is location `-` location or one location, with a `-` or `+` at the end for its orientation. Several ranges are separated by blanks or commas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.records import position
from strandlake.operators import intervals

_LOCATION = re.compile(r"(?P<scaf>@?(?:#|\d+|[A-Za-z_][\w|]*)?)(?:\.(?P<ctg>#|\d+))?(?::(?P<pos>#|\d+(?:\.\d+)?[kMG]?))?$")


@dataclass(frozen=True)
class Contig:
    """One contig as selections need it: ctg and scaf count from 0."""

    ctg: int
    scaf: int
    name: str
    sbeg: int
    clen: int
    slen: int


class Genome:
    """The skeleton of a genome on the driver: one entry a contig. It grows with the contigs, not with their bases."""

    def __init__(self, contigs: list[Contig]):
        self.contigs = sorted(contigs, key=lambda c: c.ctg)
        self.of: dict[int, list[Contig]] = {}
        for c in self.contigs:
            self.of.setdefault(c.scaf, []).append(c)
        self.named = {c.name: c.scaf for c in self.contigs}
        self.scaffolds = sorted(self.of)

    @classmethod
    def of_tables(cls, scaffolds: DataFrame, contigs: DataFrame) -> Genome:
        """From scaffolds (scaf, name, slen) and contigs (scaf, ctg, sbeg, clen), ctg counted over the whole genome or in each scaffold."""
        rows = contigs.select("scaf", "ctg", "sbeg", "clen").join(scaffolds.select("scaf", "name", "slen"), "scaf").orderBy("scaf", "sbeg").collect()
        return cls([Contig(i, r["scaf"], r["name"], r["sbeg"], r["clen"], r["slen"]) for i, r in enumerate(rows)])

    def scaffold(self, text: str) -> int:
        if text == "#":
            return self.scaffolds[-1]
        if text.isdigit():
            if not 1 <= int(text) <= len(self.scaffolds):
                raise ValueError(f"there is no scaffold {text}")
            return self.scaffolds[int(text) - 1]
        if text not in self.named:
            raise ValueError(f"there is no scaffold named {text}")
        return self.named[text]


@dataclass(frozen=True)
class Range:
    """Positions beg to end of a scaffold or, if ctg is given, of a contig (an index into the genome's); orient is 1, -1, or 0 where none is said; ord is the range's place in the selection."""

    scaf: int
    ctg: int | None
    beg: int
    end: int
    orient: int
    ord: int = 0


@dataclass(frozen=True)
class _Place:
    scaf: int
    ctg: int | None
    pos: int | None


def _place(genome: Genome, text: str, default: _Place | None = None) -> _Place:
    m = _LOCATION.match(text)
    if not text or not m:
        raise ValueError(f"no location: {text!r}")
    said = (m["scaf"] or "").lstrip("@")
    if not said and default is None:
        raise ValueError(f"no scaffold in {text!r}")
    scaf = genome.scaffold(said) if said else default.scaf
    ctg = None
    if m["ctg"]:
        own = genome.of[scaf]
        n = len(own) if m["ctg"] == "#" else int(m["ctg"])
        if not 1 <= n <= len(own):
            raise ValueError(f"there is no contig {m['ctg']} in {text!r}")
        ctg = own[n - 1].ctg
    elif not said and default is not None:
        ctg = default.ctg
    pos = None
    if m["pos"]:
        size = genome.contigs[ctg].clen if ctg is not None else genome.of[scaf][0].slen
        pos = size if m["pos"] == "#" else position(m["pos"])
        if pos > size:
            raise ValueError(f"{text!r} lies beyond the end at {size}")
    return _Place(scaf, ctg, pos)


def _split(text: str) -> tuple[str, str | None, int]:
    """first location, second location, orientation."""
    orient = 0
    if text[-1] in "+-":
        orient, text = (1 if text[-1] == "+" else -1), text[:-1]
    first, dash, second = text.partition("-")
    return first, second if dash else None, orient


def parse(genome: Genome, text: str) -> list[Range]:
    """The ranges of a selection, in its order. A second location may leave out what the first one says; a single position is no range."""
    out: list[Range] = []
    for n, part in enumerate(x for x in re.split(r"[\s,]+", text) if x):
        out += [replace(r, ord=n) for r in _ranges(genome, part)]
    return out


def _ranges(genome: Genome, part: str) -> list[Range]:
    if part.rstrip("+-") in ("@", "."):
        orient = {"+": 1, "-": -1}.get(part[-1], 0)
        return [Range(s, None, 0, genome.of[s][0].slen, orient) for s in genome.scaffolds] if part[0] == "@" else [Range(c.scaf, c.ctg, 0, c.clen, orient) for c in genome.contigs]
    first, second, orient = _split(part)
    a = _place(genome, first)
    if second is None:
        if a.pos is not None:
            raise ValueError(f"a single position is no range: {part!r}")
        return [_whole(genome, a, orient)]
    b = _place(genome, second if a.pos is None or not re.fullmatch(r"\d+(\.\d+)?[kMG]?|#", second) else f":{second}", a)
    return _between(genome, a, b, orient, part)


def _whole(genome: Genome, p: _Place, orient: int) -> Range:
    return Range(p.scaf, p.ctg, 0, genome.contigs[p.ctg].clen if p.ctg is not None else genome.of[p.scaf][0].slen, orient)


def _between(genome: Genome, a: _Place, b: _Place, orient: int, said: str) -> list[Range]:
    units = [c.ctg for c in genome.contigs] if a.ctg is not None else genome.scaffolds
    if (a.ctg is None) != (b.ctg is None):
        raise ValueError(f"a scaffold and a contig are no range: {said!r}")
    unit = lambda p: p.ctg if a.ctg is not None else p.scaf
    i, j = units.index(unit(a)), units.index(unit(b))
    if (i, a.pos or 0) > (j, b.pos if b.pos is not None else float("inf")):
        raise ValueError(f"the range runs backwards: {said!r}")
    out = []
    for k in range(i, j + 1):
        place = _Place(genome.contigs[units[k]].scaf, units[k], None) if a.ctg is not None else _Place(units[k], None, None)
        whole = _whole(genome, place, orient)
        out.append(Range(whole.scaf, whole.ctg, a.pos or 0 if k == i else 0, b.pos if k == j and b.pos is not None else whole.end, orient))
    return out


def on_contigs(genome: Genome, ranges: list[Range]) -> list[tuple[int, int, int, int, int]]:
    """(ord, ctg, beg, end, orient) of the parts of contigs in the ranges, in their order."""
    out = []
    for r in ranges:
        for c in genome.of[r.scaf] if r.ctg is None else [genome.contigs[r.ctg]]:
            off = c.sbeg if r.ctg is None else 0
            beg, end = max(0, r.beg - off), min(c.clen, r.end - off)
            if beg < end:
                out.append((r.ord, c.ctg, beg, end, r.orient))
    return out


def hulls(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """One (ord, ctg, beg, end, orient) for each contig: from the least beg to the greatest end, in the order in which contigs are first named; two orientations are an error."""
    seen: dict[int, tuple[int, int, int, int, int]] = {}
    for n, ctg, beg, end, orient in parts:
        if ctg not in seen:
            seen[ctg] = (n, ctg, beg, end, orient)
            continue
        m, _, b, e, o = seen[ctg]
        if o * orient < 0:
            raise ValueError(f"contig {ctg + 1} is selected in both orientations")
        seen[ctg] = (m, ctg, min(b, beg), max(e, end), o or orient)
    return list(seen.values())


def point(genome: Genome, text: str) -> tuple[int, int]:
    """(ctg, position) of a single position; one in a gap is an error."""
    p = _place(genome, text)
    if p.pos is None:
        raise ValueError(f"no position in {text!r}")
    for c in genome.of[p.scaf] if p.ctg is None else [genome.contigs[p.ctg]]:
        off = c.sbeg if p.ctg is None else 0
        if off <= p.pos <= off + c.clen:
            return c.ctg, p.pos - off
    raise ValueError(f"{text!r} lies in a gap")


def read_file(spark: SparkSession, path: str) -> str:
    """A selection from a text file: a range or more a line, # and what follows it are remarks. Selections are written by hand, so one fits the driver."""
    lines = spark.read.text(path, wholetext=False).collect()
    return " ".join(re.split(r"(?:^|\s)#(?=\s|$)", r["value"])[0] for r in lines)


def selected(spark: SparkSession, parts: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(ord, ctg, beg, end, orient) as a table."""
    return spark.createDataFrame(parts, "ord int, ctg long, beg long, end long, orient int")


def alignments_in(alignments: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """The alignments (actg, abpos, aepos, bctg, bbpos, bepos, comp, ...) whose A meets a part of first and, if given, whose B meets one of second that fits in orientation."""
    keyed = alignments.withColumn("_id", F.xxhash64("actg", "abpos", "aepos", "bctg", "bbpos", "bepos", "comp"))
    side = lambda p: keyed.select(F.col(f"{p}ctg").alias("ctg"), F.col(f"{p}bpos").alias("beg"), F.col(f"{p}epos").alias("end"), "_id", "comp")
    spans = lambda s, o: s.select("ctg", F.col("beg").alias("rbeg"), F.col("end").alias("rend"), F.col("orient").alias(o))
    a = intervals.overlaps(side("a"), spans(first, "oa"), "ctg").select("_id", "comp", "oa")
    if second is None:
        good = a.select("_id")
    else:
        b = intervals.overlaps(side("b"), spans(second, "ob"), "ctg").select("_id", "ob")
        good = a.join(b, "_id").where("oa * ob = 0 or (oa * ob < 0) = comp").select("_id")
    return keyed.join(good.distinct(), "_id", "left_semi").drop("_id")
