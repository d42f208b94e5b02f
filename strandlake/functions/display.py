"""What people look at: lists of alignments and sequences, alignments letter by letter, dot plots. Rows are formatted where they are; only what is shown comes to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar
from strandlake.functions.records import thousands
from strandlake.operators.ordered import longest
from strandlake.operators.sequences import reverse_complement


def _edge(pos: Column, size: Column, inner: str, outer: str) -> Column:
    return F.when((pos == 0) | (pos == size), outer).otherwise(inner)


def alignment_line(rows: DataFrame) -> DataFrame:
    """rows with line: scaffold and contig of both sides with n or c for the strand, intervals in scaffold positions (< > at a scaffold's end), percent, differences, trace points.

    Columns: ascaf, actg (in the scaffold, from 0), abeg, aend, aslen, bscaf, bctg, bbeg, bend (from high to low for a complement), bslen, comp, reverse, diffs, tpoints.
    """
    turn = lambda x, y: F.when(F.col("reverse"), F.col(y)).otherwise(F.col(x))
    ab, ae, bb, be = turn("abeg", "aend"), turn("aend", "abeg"), turn("bbeg", "bend"), turn("bend", "bbeg")
    strand = lambda c: F.when(c, "c").otherwise("n")
    span = lambda b, e, size: F.concat(_edge(b, F.col(size), "[", "<"), thousands(b), F.lit(".."), thousands(e), _edge(e, F.col(size), "]", ">"))
    both = F.abs(F.col("aend") - F.col("abeg")) + F.abs(F.col("bend") - F.col("bbeg"))
    rate = F.format_string("%.2f%%", F.lit(200.0) * F.col("diffs") / both)
    line = F.concat(
        (F.col("ascaf") + 1).cast("string"), F.lit("."), (F.col("actg") + 1).cast("string"), strand(F.col("reverse")), F.lit("  "), (F.col("bscaf") + 1).cast("string"), F.lit("."), (F.col("bctg") + 1).cast("string"),
        strand(F.col("comp") != F.col("reverse")), F.lit("   "), span(ab, ae, "aslen"), F.lit(" x "), span(bb, be, "bslen"), F.lit("  "), rate, F.lit("  ("), thousands(F.col("diffs")), F.lit(" diffs, "), F.size("tpoints").cast("string"), F.lit(" trace pts)"),
    )
    return rows.withColumn("line", line)


def annotation_line(rows: DataFrame) -> DataFrame:
    """rows (from, to, open_left, open_right, orient, label, score, and off: the window's place) with line: [from - to], < or > where the interval goes on, from high to low if orient is 1."""
    down = F.col("orient") == 1
    low, high = F.col("from") + F.col("off"), F.col("to") + F.col("off")
    first, last = F.when(down, high).otherwise(low), F.when(down, low).otherwise(high)
    opens, ends = F.when(down, F.col("open_right")).otherwise(F.col("open_left")), F.when(down, F.col("open_left")).otherwise(F.col("open_right"))
    pad = lambda c: F.lpad(c.cast("string"), 10, " ")
    line = F.concat(F.when(opens, "<").otherwise("["), pad(first), F.lit(" - "), pad(last), F.when(ends, ">").otherwise("]"), F.when(F.col("label").isNotNull(), F.concat(F.lit(" "), F.col("label"))).otherwise(""), F.when(F.col("score") > 0, F.concat(F.lit(" score = "), F.col("score").cast("string"))).otherwise(""))
    return rows.withColumn("line", line)


def sequences_of(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ord, ctg, beg, end, orient, seq): the bases of selected parts (ord, ctg, beg, end, orient) of contigs (ctg, seq), complemented where orient is -1, in the order of the selection."""
    seq = F.substring(F.col("seq"), F.col("beg").cast("int") + 1, (F.col("end") - F.col("beg")).cast("int"))
    shown = parts.join(contigs.select("ctg", "seq"), "ctg").select("ord", "ctg", "beg", "end", "orient", F.when(F.col("orient") < 0, reverse_complement(seq)).otherwise(seq).alias("seq"))
    return shown.orderBy("ord", F.when(F.col("orient") < 0, -F.col("ctg")).otherwise(F.col("ctg")))


def columns_of(ops: cigar.Ops, a: str, b: str) -> Iterator[tuple[str, str, str]]:
    """(base of a, mark, base of b) of each column of an alignment: | for equal, * for changed, - opposite a base alone."""
    i = j = 0
    for n, op in ops:
        for _ in range(n):
            if op == "I":
                yield a[i], "-", "-"
            elif op == "D":
                yield "-", "-", b[j]
            else:
                yield a[i], "|" if a[i].lower() == b[j].lower() else "*", b[j]
            i, j = i + (op != "D"), j + (op != "I")


def alignment_text(ops: cigar.Ops, a: str, b: str, abeg: int, bbeg: int, width: int = 100, indent: int = 4, border: tuple[str, str] = ("", ""), down: bool = False, bases_of_a: bool = False) -> str:
    """An alignment of the pieces a and b row by row: three lines with positions and, at the end of each row, its percent of differences.

    width counts columns or, with bases_of_a, bases of a; border: up to its length bases before and behind, in lower case; down: b counts downwards, as a complement does.
    """
    rows, own, seen = [], [], 0
    for col in columns_of(ops, a, b):
        own.append(col)
        seen += 1 if not bases_of_a else col[0] != "-"
        if seen == width:
            rows.append(own)
            own, seen = [], 0
    if own:
        rows.append(own)
    out, i, j = [], abeg, bbeg
    digits = max(len(str(abeg + len(a))), len(str(bbeg + len(b))))
    pad = " " * indent
    for n, row in enumerate(rows):
        left = border[0].lower() if n == 0 else ""
        right = border[1].lower() if n == len(rows) - 1 else ""
        wrong = sum(m != "|" for _, m, _ in row)
        gap = " " * len(left)
        out.append(f"{pad}{i:>{digits}} {left}{''.join(x for x, _, _ in row)}{right}")
        out.append(f"{pad}{'':>{digits}} {gap}{''.join(m for _, m, _ in row)}  {100 * wrong / len(row):.1f}%")
        out.append(f"{pad}{j:>{digits}} {gap}{''.join(y for _, _, y in row)}")
        out.append("")
        i += sum(x != "-" for x, _, _ in row)
        j += (-1 if down else 1) * sum(y != "-" for _, _, y in row)
    return "\n".join(out)


def shown_alignments(rows: DataFrame, width: int = 100, most: int = 1000) -> list[str]:
    """Texts of at most `most` alignments (aseq, bseq: the aligned pieces; abpos, bbpos, cigar), a report for people."""
    picked = rows.select("aseq", "bseq", "abpos", "bbpos", "cigar").limit(most).toLocalIterator()
    return [alignment_text(cigar.parse(r["cigar"]), r["aseq"], r["bseq"], r["abpos"], r["bbpos"], width) for r in picked]


def _axis(sizes: Iterable[int], length: float) -> tuple[list[float], float]:
    starts, total = [], 0
    for n in sizes:
        starts.append(total)
        total += n
    scale = length / max(1, total)
    return [s * scale for s in starts], scale


def dot_plot(segments: DataFrame, asizes: list[tuple[str, int]], bsizes: list[tuple[str, int]], most: int = 100_000, width: int = 800, height: int = 800, least: int = 100, share: float = 0.7) -> str:
    """An SVG picture of segments (ascaf, abpos, aepos, bscaf, bbpos, bepos: from high to low against the strand; matches, block): both axes hold the scaffolds (name, length) one behind the other.

    Only segments that are long and alike enough are drawn, the `most` longest (or some more: their length is rounded down). Blue runs the same way on both sides, red the other.
    """
    size = F.col("aepos") - F.col("abpos")
    good = segments.where((F.abs(size) >= least) & (F.abs(F.col("bepos") - F.col("bbpos")) >= least) & (2 * F.col("matches") / F.col("block") >= share))
    xs, xscale = _axis((n for _, n in asizes), width)
    ys, yscale = _axis((n for _, n in bsizes), height)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', f'<rect width="{width}" height="{height}" fill="white" stroke="black"/>']
    out += [f'<line x1="{x:.1f}" y1="0" x2="{x:.1f}" y2="{height}" stroke="#cccccc"/><text x="{x + 2:.1f}" y="10" font-size="8">{_plain(name)}</text>' for x, (name, _) in zip(xs, asizes, strict=True)]
    out += [f'<line x1="0" y1="{height - y:.1f}" x2="{width}" y2="{height - y:.1f}" stroke="#cccccc"/><text x="2" y="{height - y - 2:.1f}" font-size="8">{_plain(name)}</text>' for y, (name, _) in zip(ys, bsizes, strict=True)]
    for r in longest(good, F.abs(size), most).select("ascaf", "abpos", "aepos", "bscaf", "bbpos", "bepos").toLocalIterator():
        x0, x1 = (xs[r["ascaf"]] + r[c] * xscale for c in ("abpos", "aepos"))
        y0, y1 = (height - ys[r["bscaf"]] - r[c] * yscale for c in ("bbpos", "bepos"))
        same = (r["aepos"] > r["abpos"]) == (r["bepos"] > r["bbpos"])
        out.append(f'<line x1="{x0:.2f}" y1="{y0:.2f}" x2="{x1:.2f}" y2="{y1:.2f}" stroke="{"#1f4fd8" if same else "#d8331f"}"/>')
    return "\n".join([*out, "</svg>"])


def _plain(name: str) -> str:
    return name.replace("&", "&amp;").replace("<", "&lt;")
