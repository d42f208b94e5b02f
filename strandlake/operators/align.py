"""Local alignments of sequences about chained seeds: greedy furthest-reaching waves, redundancy, exact alignments between trace points, better gaps.

Sequences are arrays of base codes. All of this works on one pair of contigs at a time; `align_chains` deals the pairs out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import cigar
from strandlake.operators.sequences import codes

#: Columns of the match history, of the tips that must be good, and antidiagonals by which a wave may fall behind the best before its ends are dropped or it ends.
HISTORY, TIP, TRIM, LAG = 60, 15, 70, 250
#: Antidiagonals from one start in a tube to the next, and bases by which a box may stick out of another.
STEP, FUZZ = 128, 10
_FULL = (1 << HISTORY) - 1


@dataclass(frozen=True)
class Rules:
    """Least length, greatest rate of differences, and what follows from it: matches wanted among the last 60 columns, and scores of a match and a difference."""

    least: int = 100
    identity: float = 0.7
    bias: float = 0.8

    @property
    def wanted(self) -> int:
        return int(HISTORY * (1 - self.bias * (1 - self.identity)))

    @property
    def match(self) -> int:
        return int(1000 * self.bias * (1 - self.identity))


@dataclass
class Alignment:
    abpos: int
    aepos: int
    bbpos: int
    bepos: int
    ops: cigar.Ops

    @property
    def diffs(self) -> int:
        return sum(n for n, op in self.ops if op != "=")


def _slide(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How many bases from a[x] and b[y] on are equal."""
    n = min(len(a) - x, len(b) - y)
    done = 0
    step = 16
    while done < n:
        size = min(step, n - done)
        off = np.flatnonzero(a[x + done : x + done + size] != b[y + done : y + done + size])
        if len(off):
            return done + int(off[0])
        done, step = done + size, step * 4
    return done


def _good_tip(history: int, rules: Rules) -> bool:
    """Whether all suffixes of the last columns score above zero, and then all suffixes of the columns before."""
    for part in (history, history >> TIP):
        score = 0
        for i in range(TIP):
            score += rules.match if part >> i & 1 else rules.match - 1000
            if score < 0:
                return False
    return True


def extend(a: np.ndarray, b: np.ndarray, starts: list[tuple[int, int]], rules: Rules, low: int | None = None, high: int | None = None) -> tuple[int, int, int, int, cigar.Ops]:
    """(x0, y0, x, y, ops) of the furthest good alignment that runs on from one of starts [(x, y)]; low and high bound its diagonals x - y.

    Each wave allows one difference more. A path remembers which of its last 60 columns match; a new furthest point whose history has enough of them and
    whose tips score well is where the alignment may end.
    """
    best = (0, -1, None)
    wave: dict[int, tuple[int, int, tuple]] = {}  # diagonal -> (antidiagonal, history, path)
    lasta = -1

    def reach(k: int, x: int, history: int, path: tuple) -> tuple[int, int, tuple]:
        n = _slide(a, b, x, x - k)
        if n:
            history = ((history << min(n, HISTORY)) | ((1 << min(n, HISTORY)) - 1)) & _FULL
            path = (path, "=", n)
        return 2 * (x + n) - k, history, path

    for x, y in starts:
        if 0 <= x <= len(a) and 0 <= y <= len(b):
            wave[x - y] = reach(x - y, x, _FULL, (None, x, y))
    while wave:
        for k, (anti, history, path) in wave.items():
            if anti > lasta and history.bit_count() >= rules.wanted:
                lasta = anti
                if anti > best[1] and _good_tip(history, rules):
                    best = (k, anti, path)
        top = max(v[0] for v in wave.values())
        if top < lasta - LAG or lasta < top - LAG or (best[1] >= 0 and any(((v[0] + k) // 2 == len(a) or (v[0] - k) // 2 == len(b)) and v[0] >= best[1] and v[2] is best[2] for k, v in wave.items())):
            break
        following = {}
        for k in range(min(wave) - 1, max(wave) + 2):
            if (low is not None and k < low) or (high is not None and k > high):
                continue
            ways = [(wave[j][0] + step, -order, j, op) for order, (j, step, op) in enumerate(((k, 2, "X"), (k - 1, 1, "I"), (k + 1, 1, "D"))) if j in wave]
            if not ways:
                continue
            for anti, _, j, op in sorted(ways, reverse=True):
                x = (anti + k) // 2
                if x <= len(a) and x - k <= len(b):
                    following[k] = reach(k, x, wave[j][1] << 1 & _FULL, (wave[j][2], op, 1))
                    break
        if following:
            top = max(v[0] for v in following.values())
            keys = sorted(following)
            while keys and following[keys[0]][0] < top - TRIM:
                del following[keys.pop(0)]
            while keys and following[keys[-1]][0] < top - TRIM:
                del following[keys.pop()]
        wave = following
    ops: cigar.Ops = []
    path = best[2]
    if path is None:
        x, y = starts[0]
        return x, y, x, y, []
    while path[0] is not None:
        ops.append((path[2], path[1]))
        path = path[0]
    ops = cigar.joined(reversed(ops))
    x0, y0 = path[1], path[2]
    la, lb = cigar.spans(ops)
    return x0, y0, x0 + la, y0 + lb, ops


def local_alignment(a: np.ndarray, b: np.ndarray, low: int, high: int, anti: int, rules: Rules | None = None, least: int | None = None, most: int | None = None) -> Alignment | None:
    """The alignment through a point of the antidiagonal between the diagonals low and high: forward from there, then backward from where that path begins; least and most bound its diagonals throughout."""
    rules = rules or Rules()
    starts = [((anti + k) >> 1, ((anti + k) >> 1) - k) for k in range(low, high + 1)]
    starts = [(x, y) for x, y in starts if 0 <= x <= len(a) and 0 <= y <= len(b)]
    if not starts:
        return None
    x0, y0, x1, y1, ahead = extend(a, b, starts, rules, least, most)
    ra, rb = a[:x0][::-1], b[:y0][::-1]
    turn = x0 - y0
    _, _, dx, dy, back = extend(ra, rb, [(0, 0)], rules, None if most is None else turn - most, None if least is None else turn - least)
    ops = cigar.joined([*reversed(back), *ahead])
    return Alignment(x0 - dx, x1, y0 - dy, y1, ops) if ops else None


def worth(found: Alignment, rules: Rules) -> bool:
    """The length and rate that an alignment must reach, with 50 bases and 5 % of slack."""
    size = found.aepos - found.abpos
    return size >= rules.least - 50 and found.diffs <= (1 - rules.identity + 0.05) * size


def tubes(a: np.ndarray, b: np.ndarray, boxes: list[tuple[int, int, int, int, int]], rules: Rules, own: bool = False) -> list[Alignment]:
    """The alignments found along boxes (band, alow, ahgh, dgmin, dgmax), in order: each tube is walked in steps, from the end of what was found on. own: both are one sequence, whose main diagonal no alignment crosses."""
    out, done, last = [], -1, None
    for band, alow, ahgh, dgmin, dgmax in sorted(boxes):
        done = done if band == last else -1
        last = band
        if ahgh <= done:
            continue
        at, stop = max(alow, done), ahgh - STEP
        least, most = (None, None) if not own else ((1, None) if dgmin > 0 else (None, -1))
        if own and dgmin <= 0 <= dgmax:
            dgmin, dgmax, least, most = 1, max(1, dgmax), 1, None
        while True:
            mid = min(at + STEP, max(stop, alow))
            found = local_alignment(a, b, dgmin, dgmax, mid, rules, least, most)
            if found and worth(found, rules):
                out.append(found)
            end = found.aepos + found.bepos if found else 0
            at = end if end > mid else max(mid, at + 1)
            if at >= stop:
                break
        done = max(done, at)
    return out


def _points(x: Alignment, spacing: int = cigar.SPACING) -> dict[int, int]:
    """A position -> B position at the trace points inside an alignment."""
    _, steps = cigar.trace(x.ops, x.abpos, spacing)
    at, y, out = (x.abpos // spacing + 1) * spacing, x.bbpos, {}
    for n in steps[:-1]:
        y += n
        out[at] = y
        at += spacing
    return out


def _cut(ops: cigar.Ops, bases: int, keep_tail: bool) -> cigar.Ops:
    """The operations before or behind the first `bases` of A; a gap in A at the cut goes before it, as trace points have it behind: callers cut where paths meet."""
    head, tail, left = [], list(ops), bases
    while tail and left:
        n, op = tail.pop(0)
        if op == "D":
            head.append((n, op))
        elif n <= left:
            head.append((n, op))
            left -= n
        else:
            head.append((left, op))
            tail.insert(0, (n - left, op))
            left = 0
    return tail if keep_tail else head


def without_redundancy(found: list[Alignment]) -> list[Alignment]:
    """Alignments of one pair and strand: of equal starts or ends the longer stays, paths that meet at a trace point become one, and what lies in another's box (10 bases of slack) without crossing it goes."""
    size = lambda x: x.aepos - x.abpos + x.bepos - x.bbpos
    for key in (lambda x: (x.abpos, x.bbpos), lambda x: (x.aepos, x.bepos)):
        best: dict[tuple[int, int], Alignment] = {}
        for x in found:
            if key(x) not in best or (size(x), -x.diffs) > (size(best[key(x)]), -best[key(x)].diffs):
                best[key(x)] = x
        found = list(best.values())
    found = sorted(found, key=lambda x: (x.abpos, x.bbpos, x.aepos))
    gone: set[int] = set()
    for i in reversed(range(len(found))):
        for j in range(i + 1, len(found)):
            x, y = found[i], found[j]
            if i in gone:
                break
            if j in gone:
                continue
            if y.abpos >= x.aepos:
                break
            if min(x.bepos, y.bepos) <= max(x.bbpos, y.bbpos):
                continue
            px, py = _points(x), _points(y)
            meet = sorted(p for p in px if py.get(p) == px[p])
            if meet:
                p = meet[0]
                ends = [(x, y), (y, x)]
                first, then = min(ends, key=lambda e: (e[0].abpos, -e[1].aepos))
                head, tail = _cut(first.ops, p - first.abpos, False), _cut(then.ops, p - then.abpos, True)
                la, lb = cigar.spans(head)
                rest = then.bbpos + cigar.spans(_cut(then.ops, p - then.abpos, False))[1]
                if first.bbpos + lb == rest and la == p - first.abpos and then.aepos >= first.aepos:
                    found[i] = Alignment(first.abpos, then.aepos, first.bbpos, then.bepos, cigar.joined([*head, *tail]))
                    gone.add(j)
                elif _inside(y, x):
                    gone.add(j)
                continue
            gaps = [px[p] - py[p] for p in px if p in py]
            if gaps and min(gaps) < 0 < max(gaps):
                continue
            if _inside(y, x):
                gone.add(j)
            elif _inside(x, y):
                gone.add(i)
    return [x for i, x in enumerate(found) if i not in gone]


def _inside(x: Alignment, y: Alignment) -> bool:
    return x.abpos >= y.abpos - FUZZ and x.aepos <= y.aepos + FUZZ and x.bbpos >= y.bbpos - FUZZ and x.bepos <= y.bepos + FUZZ


ALIGNMENT = "actg long, bctg long, comp boolean, abpos long, aepos long, bbpos long, bepos long, diffs long, cigar string, tdiffs array<long>, tpoints array<long>"


def align_chains(chains: DataFrame, a: DataFrame, b: DataFrame, amax: int, bmax: int, rules: Rules | None = None, own: bool = False) -> DataFrame:
    """Alignments (ALIGNMENT) of chains (actg, bctg, comp, band, alow, ahgh, dgmin, dgmax) of contigs a and b (ctg, seq).

    The chains of a pair of contigs and strand are one row with both sequences, so pairs are dealt out evenly whichever contig they share. Positions on B count along its complement where comp is set.
    """
    rules = rules or Rules()
    boxes = chains.groupBy("actg", "bctg", "comp").agg(F.collect_list(F.struct("band", "alow", "ahgh", "dgmin", "dgmax")).alias("boxes"))  # one pair's own
    rows = boxes.join(a.select(F.col("ctg").alias("actg"), F.col("seq").alias("aseq")), "actg").join(b.select(F.col("ctg").alias("bctg"), F.col("seq").alias("bseq")), "bctg")
    rows = rows.select("actg", "bctg", "comp", "boxes", "aseq", "bseq").repartition("actg", "bctg", "comp")
    names = [x.split()[0] for x in ALIGNMENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for actg, bctg, comp, held, aseq, bseq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = codes(aseq), codes(bseq)
                n, m = len(x), len(y)
                x = (3 - x)[::-1] if comp else x
                up, on = (n - (amax + bmax), n - amax) if comp else (-bmax, 0)
                tube = [(h["band"], h["alow"] + on, h["ahgh"] + on, h["dgmin"] + up, h["dgmax"] + up) for h in held]
                for f in without_redundancy(tubes(x, y, tube, rules, own and actg == bctg and not comp)):
                    ops = list(reversed(f.ops)) if comp else f.ops
                    ab, ae, bb, be = (n - f.aepos, n - f.abpos, m - f.bepos, m - f.bbpos) if comp else (f.abpos, f.aepos, f.bbpos, f.bepos)
                    diffs, points = cigar.trace(ops, ab)
                    out.append((actg, bctg, comp, ab, ae, bb, be, f.diffs, cigar.text(ops), diffs, points))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, ALIGNMENT)


def exact_operations(a: np.ndarray, b: np.ndarray) -> cigar.Ops:
    """Operations of an alignment of all of a and b with the fewest differences; of equally good ones changes go before gaps."""
    n, m = len(a), len(b)
    waves: list[dict[int, tuple[int, str]]] = [{0: (_slide(a, b, 0, 0), "=")}]
    while waves[-1].get(n - m, (-1,))[0] < n:
        last, now = waves[-1], {}
        for k in range(min(last) - 1, max(last) + 2):
            ways = [(last[j][0] + step, -order, op) for order, (j, step, op) in enumerate(((k, 1, "X"), (k - 1, 1, "I"), (k + 1, 0, "D"))) if j in last]
            ways = [(x, o, op) for x, o, op in ways if x <= n and 0 <= x - k <= m]
            if ways:
                x, _, op = max(ways)
                now[k] = (x + _slide(a, b, x, x - k), op)
        waves.append(now)
    ops, k, x = [], n - m, n
    for d in range(len(waves) - 1, 0, -1):
        op = waves[d][k][1]
        j = {"X": k, "I": k - 1, "D": k + 1}[op]
        x0 = waves[d - 1][j][0]
        start = x0 + (op != "D")
        ops += [(x - start, "="), (1, op)]
        k, x = j, x0
    return cigar.joined([*reversed([*ops, (x, "=")])])


def between_points(a: np.ndarray, b: np.ndarray, points: list[tuple[int, int]]) -> cigar.Ops:
    """Operations of the exact alignments from each point (on a, on b) to the next one, whatever their distances, joined; the whole has as many differences as its parts."""
    return cigar.joined([x for (i, j), (k, m) in zip(points, points[1:], strict=False) for x in exact_operations(a[i:k], b[j:m])])


def from_trace(a: np.ndarray, b: np.ndarray, abpos: int, aepos: int, bbpos: int, tpoints: list[int], spacing: int = cigar.SPACING) -> cigar.Ops:
    """Operations of an alignment that is stored as its steps on b between the multiples of spacing on a; an error if there are more or fewer of them than panels."""
    cuts = [abpos, *range((abpos // spacing + 1) * spacing, aepos, spacing), aepos]
    if len(tpoints) != len(cuts) - 1:
        raise ValueError("the trace has another number of points than the alignment has panels")
    places = [bbpos]
    for n in tpoints:
        places.append(places[-1] + n)
    return between_points(a, b, list(zip(cuts, places, strict=True)))


def better_gaps(ops: cigar.Ops, a: np.ndarray, b: np.ndarray, abpos: int, bbpos: int, apart: int = 50) -> cigar.Ops:
    """The operations with runs of gaps of one kind, fewer than `apart` columns from each other, merged where that costs less: a gap costs 1 whatever its length, and so does a changed base.

    The number of bases in gaps stays as it is, so the alignment spans what it did.
    """
    parts, i, j = [], abpos, bbpos
    for n, op in ops:
        parts.append((n, op, i, j))
        i, j = i + n * (op != "D"), j + n * (op != "I")
    out, at = [], 0
    while at < len(parts):
        op = parts[at][1]
        if op not in "ID":
            out.append(parts[at][:2])
            at += 1
            continue
        last, between, t = at, 0, at + 1
        while t < len(parts) and between < apart and parts[t][1] not in "ID" or t < len(parts) and parts[t][1] == op and between < apart:
            if parts[t][1] == op:
                last, between = t, 0
            else:
                between += parts[t][0]
            t += 1
        runs = [p for p in parts[at : last + 1] if p[1] == op]
        if len(runs) < 2:
            out.append(parts[at][:2])
            at += 1
            continue
        i0, j0 = parts[at][2], parts[at][3]
        i1, j1 = parts[last][2] + parts[last][0] * (op == "I"), parts[last][3] + parts[last][0] * (op == "D")
        old = [p[:2] for p in parts[at : last + 1]]
        new = _merged_gap(a[i0:i1], b[j0:j1], op)
        cost = lambda x: sum(1 if o in "ID" else n * (o == "X") for n, o in x)
        out += new if cost(new) < cost(old) else old
        at = last + 1
    return cigar.joined(out)


def _merged_gap(a: np.ndarray, b: np.ndarray, op: str) -> cigar.Ops:
    """The cheapest operations with one gap of kind op that align all of a and b, the leftmost of equally cheap ones."""
    long, short = (a, b) if op == "I" else (b, a)
    gap = len(long) - len(short)
    before = np.concatenate(([0], np.cumsum(long[: len(short)] != short)))
    behind = np.concatenate((np.cumsum((long[gap:] != short)[::-1])[::-1], [0]))
    cut = int(np.argmin(before + behind))
    side = lambda lo, hi, off: [(1, "=" if x == y else "X") for x, y in zip(long[lo + off : hi + off], short[lo:hi], strict=True)]
    return cigar.joined([*side(0, cut, 0), (gap, op), *side(cut, len(short), gap)])


def with_exact_cigar(alignments: DataFrame, a: DataFrame, b: DataFrame, improve: bool = True) -> DataFrame:
    """alignments (ALIGNMENT) with cigar and diffs made anew from their trace points and the sequences a and b (ctg, seq), gaps improved if so asked."""
    rows = alignments.drop("cigar", "diffs").join(a.select(F.col("ctg").alias("actg"), F.col("seq").alias("aseq")), "actg").join(b.select(F.col("ctg").alias("bctg"), F.col("seq").alias("bseq")), "bctg")

    def make(aseq: str, bseq: str, comp: bool, ab: int, ae: int, bb: int, tpoints: list[int]) -> dict:
        x, y = codes(aseq), codes(bseq)
        y = (3 - y)[::-1] if comp else y
        ops = from_trace(x, y, int(ab), int(ae), int(bb), [int(n) for n in tpoints])
        ops = better_gaps(ops, x, y, int(ab), int(bb)) if improve else ops
        return {"cigar": cigar.text(ops), "diffs": sum(n for n, op in ops if op != "=")}

    made = cigar.column(make, "cigar string, diffs long", *[F.col(c) for c in ("aseq", "bseq", "comp", "abpos", "aepos", "bbpos", "tpoints")])
    out = rows.withColumn("_x", made)
    return out.select(*[F.col(f"_x.{c}").alias(c) if c in ("cigar", "diffs") else F.col(c) for c in alignments.columns])
