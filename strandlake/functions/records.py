"""Alignment records: identities, filters, roles, clipping, colours; positions and numbers as people write them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = {"": 1, "k": 1_000, "M": 1_000_000, "G": 1_000_000_000}


def divergence(diffs: Column, la: Column, lb: Column) -> Column:
    """Differences in percent of the average length of both sides."""
    return F.lit(200.0) * diffs / (la + lb)


def identity_estimate(diffs: Column, la: Column, lb: Column) -> tuple[Column, Column]:
    """(matches, block) without an exact alignment, whole numbers."""
    return F.floor((la + lb - diffs) / 2).cast("long"), F.floor((la + lb) / 2).cast("long")


def identity_exact(diffs: Column, la: Column, dels: Column) -> tuple[Column, Column]:
    """(matches, block) of an exact alignment with `dels` dashes in A."""
    return la + dels - diffs, la + dels


def divergence_tag(la: Column, matches: Column) -> Column:
    """The dv tag: (la - matches) / la, four digits, truncated."""
    share = F.floor(F.lit(10_000) * (la - matches) / la).cast("int")
    return F.concat(F.lit("dv:f:"), F.floor(share / 10_000).cast("string"), F.lit("."), F.lpad(F.pmod(share, F.lit(10_000)).cast("string"), 4, "0"))


def long_and_alike(la: Column, lb: Column, matches: Column, block: Column, least: int = 100, share: float = 0.7) -> Column:
    """Whether both sides have `least` bases and matches reach the share; for plots."""
    return (la >= least) & (lb >= least) & (2 * matches / block >= share)


def worth_aligning(length: Column, diffs: Column, least: int = 100, rate: float = 0.3) -> Column:
    """The aligner's own filter: 50 bases and 5 % of slack."""
    return (length >= least - 50) & (diffs <= (rate + 0.05) * length)


def flipped(rows: DataFrame) -> DataFrame:
    """alignments (actg, abpos, aepos, bctg, bbpos, bepos, comp, cigar, alen, blen) with A and B exchanged.

    A complement's B positions count along the complement; so do those of the new B, and its operations run from the other end.
    """
    comp = F.col("comp")
    turn = lambda x, size: F.when(comp, size - F.col(x)).otherwise(F.col(x))
    ends = F.array_join(F.when(comp, F.reverse(F.regexp_extract_all("cigar", F.lit(r"\d*[MIDX=]"), F.lit(0)))).otherwise(F.regexp_extract_all("cigar", F.lit(r"\d*[MIDX=]"), F.lit(0))), "")
    b, e = (F.when(comp, turn("bepos", F.col("blen"))).otherwise(F.col("bbpos")), F.when(comp, turn("bbpos", F.col("blen"))).otherwise(F.col("bepos")))
    x, y = (F.when(comp, turn("aepos", F.col("alen"))).otherwise(F.col("abpos")), F.when(comp, turn("abpos", F.col("alen"))).otherwise(F.col("aepos")))
    return rows.select(F.col("bctg").alias("actg"), b.alias("abpos"), e.alias("aepos"), F.col("actg").alias("bctg"), x.alias("bbpos"), y.alias("bepos"), "comp", F.translate(ends, "ID", "DI").alias("cigar"), F.col("blen").alias("alen"), F.col("alen").alias("blen"))


def trace_valid(tpoints: Column, abpos: Column, aepos: Column, bbpos: Column, bepos: Column, spacing: int = 100) -> Column:
    """Whether a trace has a point for each panel of A and its steps on B add up."""
    panels = F.floor((F.greatest(aepos, abpos + 1) - 1) / spacing) - F.floor(abpos / spacing) + 1
    return (F.size(tpoints) == panels) & (F.aggregate(tpoints, F.lit(0).cast("long"), lambda s, x: s + x) == bepos - bbpos)


def fits_a_byte(values: Column) -> Column:
    """Whether all trace values can be stored in a byte."""
    return F.forall(values, lambda x: x.between(0, 255))


def clipped_segment(x0: str, y0: str, x1: str, y1: str, left: int, right: int, low: int, high: int) -> list[Column]:
    """inside, and the ends cx0, cy0, cx1, cy1 of the part of a segment that lies in the rectangle, rounded half up; the parameter along it is cut from both ends."""
    a, b, c, d = (F.col(v).cast("double") for v in (x0, y0, x1, y1))
    cut = lambda p, q, edge: F.when(q != p, (F.lit(float(edge)) - p) / (q - p))
    enter = F.greatest(F.lit(0.0), F.coalesce(F.least(cut(a, c, left), cut(a, c, right)), F.lit(0.0)), F.coalesce(F.least(cut(b, d, low), cut(b, d, high)), F.lit(0.0)))
    leave = F.least(F.lit(1.0), F.coalesce(F.greatest(cut(a, c, left), cut(a, c, right)), F.lit(1.0)), F.coalesce(F.greatest(cut(b, d, low), cut(b, d, high)), F.lit(1.0)))
    flat = ((a != c) | a.between(left, right)) & ((b != d) | b.between(low, high))
    at = lambda p, q, t: F.floor(p + t * (q - p) + 0.499).cast("long")
    return [(flat & (enter <= leave)).alias("inside"), at(a, c, enter).alias("cx0"), at(b, d, enter).alias("cy0"), at(a, c, leave).alias("cx1"), at(b, d, leave).alias("cy1")]


def segment_colour(abpos: Column, aepos: Column, bbpos: Column, bepos: Column) -> Column:
    """1 where both sides run the same way, 2 where they run against each other, 0 for a point."""
    sign = F.signum((aepos - abpos).cast("double")) * F.signum((bepos - bbpos).cast("double"))
    return F.when(sign > 0, 1).when(sign < 0, 2).otherwise(0)


def same_strand(orient_a: Column, orient_b: Column, comp: Column) -> Column:
    """Whether an alignment fits two selected orientations (1, -1, or 0 for either)."""
    return (orient_a * orient_b == 0) | ((orient_a * orient_b < 0) == comp)


def position(text: str) -> int:
    """Bases as people write them: 10100, 10.1k, 2M; no more digits behind the point than the unit has."""
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?([kMG]?)", text)
    if not m:
        raise ValueError(f"no position: {text}")
    unit = _SCALE[m[3]]
    digits = m[2] or ""
    if 10 ** len(digits) > unit:
        raise ValueError(f"too many digits for the unit: {text}")
    return int(m[1]) * unit + int(digits or 0) * (unit // 10 ** len(digits))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def digits(n: Column) -> Column:
    """How many digits a number has."""
    return F.length(F.abs(n).cast("string"))


def short_name(name: Column) -> Column:
    """A header up to its first blank."""
    return F.regexp_extract(name, r"^\S*", 0)


def numbered_names(names: DataFrame, column: str) -> DataFrame:
    """(name, id): names up to their first blank, numbered from 0 in their order; an error where one stands twice."""
    from strandlake.operators.ordered import numbered

    short = names.select(short_name(F.col(column)).alias("name"))
    twice = short.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy("name").limit(5).collect()
    if twice:
        raise ValueError("names stand twice: " + ", ".join(r["name"] for r in twice))
    return numbered(short, ["name"], "id")


def with_ids(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the id of the name in `column`; an error where names (name, id) has none."""
    other = names.select(F.col("name").alias("_name"), F.col("id").alias(out))
    keyed = rows.withColumn("_short", short_name(F.col(column)))
    lost = keyed.join(other, F.col("_short") == F.col("_name"), "left_anti").select("_short").limit(5).collect()
    if lost:
        raise ValueError("unknown names: " + ", ".join(str(r["_short"]) for r in lost))
    return keyed.join(other, F.col("_short") == F.col("_name")).drop("_short", "_name")
