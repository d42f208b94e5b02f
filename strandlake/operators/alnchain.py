"""Chains of alignments: the best predecessors by score, cut into chains, of which a greedy cover stays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Bases: gap and overlap at most between two alignments, drop at most in a chain, least score (counts on both sides), merge slack. Rates: penalties of gaps and overlaps."""

    gap: int = 10_000
    overlap: int = 10_000
    gap_rate: float = 0.1
    overlap_rate: float = 0.1
    drop: int = 1000
    score: int = 10_000
    fragments: int = 1
    covered: float = 0.5
    extra: float = 0.0
    fuzz: int = 1000

    def __post_init__(self):
        if min(self.gap, self.overlap, self.drop, self.score, self.fragments, self.fuzz) < 0 or not 0 <= self.covered <= 1 or not 0 <= self.extra <= 1:
            raise ValueError("parameters are not negative, and shares lie between 0 and 1")


def best_predecessors(ab: np.ndarray, ae: np.ndarray, bb: np.ndarray, be: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(score, previous or -1) of alignments sorted by where they begin on A.

    Only alignments that end no more than `gap` before this one begins can come before it, on either side. On B they are looked up in cells, each as wide as two searches
    (so one cell holds all that a search wants, and each alignment lies in two), on A by the greatest end so far in that cell; of equally good ones the first stays.
    """
    n = len(ab)
    size = (ae - ab + be - bb).astype(np.float64)
    prev = np.full(n, -1)
    if not n:
        return size, prev
    low, width = int(be.min()), p.gap + int((be - bb).max()) + 1
    cell = (be - low) // width
    owner, who = np.concatenate((cell, cell - 1)), np.tile(np.arange(n), 2)
    order = np.lexsort((who, owner))
    owner, who = owner[order], who[order]
    place = np.empty(2 * n, dtype=np.int64)
    place[order] = np.arange(2 * n)
    names, begin = np.unique(owner, return_index=True)
    ends = ae[who]
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), 2 * n], strict=True):
        np.maximum.accumulate(ends[lo:hi], out=ends[lo:hi])
    start = dict(zip(names.tolist(), begin.tolist(), strict=True))
    upto = dict(start)
    xe, ye, got = ae[who], be[who], np.zeros(2 * n)
    xb, yb, names_of, best = ab.tolist(), bb.tolist(), who.tolist(), size.tolist()
    rows = zip(xb, ae.tolist(), yb, be.tolist(), cell.tolist(), place[:n].tolist(), place[n:].tolist(), strict=True)
    for i, (a0, a1, b0, b1, mine, one, two) in enumerate(rows):
        c = (b0 - p.gap - low) // width
        if a1 > a0 and b1 > b0 and c in start and (hi := upto[c]) > (lo := start[c]):
            lo += int(ends[lo:hi].searchsorted(a0 - p.gap))
            da, db = xe[lo:hi] - (a0 - p.gap), ye[lo:hi] - (b0 - p.gap)  # 0 where the gap is as wide as it may be
            j = ((da.view(np.uint64) <= p.gap + min(p.overlap, a1 - a0 - 1)) & (db.view(np.uint64) <= p.gap + min(p.overlap, b1 - b0 - 1))).nonzero()[0]
            if len(j):
                oa, ob = da[j] - p.gap, db[j] - p.gap
                na, nb = np.maximum(oa, 0), np.maximum(ob, 0)
                cost = p.gap_rate * ((na - oa) + (nb - ob)) + p.overlap_rate * (na + nb)
                value = got[lo:hi][j] + ((a1 - a0) - na) + ((b1 - b0) - nb) - cost
                while (top := value[k := int(value.argmax())]) > best[i]:
                    x = names_of[lo + int(j[k])]
                    if xb[x] < a0 and yb[x] < b0:
                        best[i], prev[i] = float(top), x
                        break
                    value[k] = -np.inf
        got[one] = got[two] = best[i]
        upto[mine] += 1
        upto[mine - 1] += 1
    return np.array(best), prev


def cut(score: np.ndarray, prev: np.ndarray, size: np.ndarray, p: Params) -> list[tuple[float, list[int]]]:
    """(score, members in order) of the chains: from the highest score back, until a used alignment or one whose score lies more than `drop` above the least so far."""
    used = np.zeros(len(score), dtype=bool)
    out = []
    for head in np.lexsort((np.arange(len(score)), -score)).tolist():
        if used[head]:
            continue
        chain, low, i = [head], score[head], head
        while prev[i] >= 0 and not used[prev[i]] and score[prev[i]] <= low + p.drop:
            i = int(prev[i])
            low = min(low, score[i])
            chain.append(i)
        used[chain] = True
        total = score[head] - score[i] + size[i]
        if total >= 2 * p.score and len(chain) >= p.fragments:
            out.append((float(total), chain[::-1]))
    return out


def _merged(spans: list[tuple[int, int]], fuzz: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1] + fuzz:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _shared(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> int:
    i = j = total = 0
    while i < len(x) and j < len(y):
        total += max(0, min(x[i][1], y[j][1]) - max(x[i][0], y[j][0]))
        i, j = (i + 1, j) if x[i][1] < y[j][1] else (i, j + 1)
    return total


def cover(chains: list[tuple[float, list[tuple[int, int]], list[tuple[int, int]]]], p: Params) -> list[int]:
    """The chains (score, intervals on A, intervals on B) that stay: by falling score, unless what stays already covers more than `covered` of them on both sides or they add less than `extra`."""
    kept: list[int] = []
    have: tuple[list, list] = ([], [])
    for n in sorted(range(len(chains)), key=lambda i: (-chains[i][0], i)):
        sides = [_merged(s, p.fuzz) for s in chains[n][1:]]
        sizes = [sum(e - b for b, e in s) for s in sides]
        both = [_shared(s, h) for s, h in zip(sides, have, strict=True)]
        if kept and (all(c > p.covered * z for c, z in zip(both, sizes, strict=True)) or all(z - c < p.extra * z for c, z in zip(both, sizes, strict=True))):
            continue
        kept.append(n)
        have = tuple(_merged(h + s, p.fuzz) for h, s in zip(have, sides, strict=True))
    return sorted(kept)


def chain(alignments: DataFrame, params: Params | None = None) -> DataFrame:
    """(ascaf, bscaf, comp, chain_id, fragment, score, agap, bgap, aln) of alignments (aln, ascaf, bscaf, comp, abpos, aepos, bbpos, bepos, blen) in scaffold coordinates.

    Both strands of a pair of scaffolds are one group; the positions of a complement count along it, and blen is B's length. agap and bgap are the distances to the fragment before.
    """
    p = params or Params()
    kind = "ascaf long, bscaf long, comp boolean, chain_id int, fragment int, score double, agap long, bgap long, aln long"

    def run(rows: pa.Table) -> pa.Table:
        d = rows.to_pandas().sort_values(["abpos", "aepos", "bbpos", "bepos", "aln"], kind="stable")
        found = []
        for comp in (False, True):
            x = d[d["comp"] == comp]
            ab, ae, bb, be, ids = (x[c].to_numpy() for c in ("abpos", "aepos", "bbpos", "bepos", "aln"))
            score, prev = best_predecessors(ab, ae, bb, be, p)
            for total, members in cut(score, prev, ae - ab + be - bb, p):
                size = int(x["blen"].iloc[0])
                on_b = [(size - be[i], size - bb[i]) if comp else (bb[i], be[i]) for i in members]
                found.append((total, [(int(ab[i]), int(ae[i])) for i in members], [(int(b), int(e)) for b, e in on_b], comp, [(int(ab[i]), int(ae[i]), int(bb[i]), int(be[i]), int(ids[i])) for i in members]))
        found.sort(key=lambda c: (-c[0], c[3], c[4]))
        out = []
        for n in cover([c[:3] for c in found], p):
            total, _, _, comp, members = found[n]
            last = None
            for k, m in enumerate(members):
                out.append((int(d["ascaf"].iloc[0]), int(d["bscaf"].iloc[0]), bool(comp), n, k, total, 0 if last is None else m[0] - last[1], 0 if last is None else m[2] - last[3], m[4]))
                last = m
        names = [x.split()[0] for x in kind.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    cols = ["aln", "ascaf", "bscaf", "comp", "abpos", "aepos", "bbpos", "bepos", "blen"]
    return alignments.select(*[F.col(c).cast("boolean" if c == "comp" else "long").alias(c) for c in cols]).groupBy("ascaf", "bscaf").applyInArrow(run, kind)
