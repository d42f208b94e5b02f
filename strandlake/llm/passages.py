"""Substring dedup by compact windows: Cartesian trees over shingle min-hashes group passages that may share them, which are then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.graph import components
from strandlake.llm.runtime import discard, release, written
from strandlake.llm.words import SHINGLE, mix64, shingles, word_hashes, word_hashes_of

#: Words of a passage at least.
WORDS = 50
THRESHOLD = 0.8
#: Min-hash functions. A passage of similarity s is met with a probability of 1 - (1 - s)^HASHES at least: at the threshold, all but 6.4e-5.
HASHES = 6


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over all full windows of `width`, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), ends included: the ranges of the Cartesian tree's nodes over values that span `width` at least.

    centre is the leftmost minimum of its range, and every window of `width` or more lies in the range of exactly one centre that it holds.
    Only minima of some window of `width` can have such a range, and so can their ancestors in the tree; they are found by sliding minima and maxima, the tree is built over them alone.
    """
    n = len(values)
    if n < width:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    low = _sliding(values, width, np.minimum)
    top = np.iinfo(values.dtype).min if values.dtype.kind == "i" else 0
    edge = np.full(width - 1, top, dtype=values.dtype)
    opened = _sliding(np.concatenate((edge, low, edge)), width, np.maximum)
    at = np.flatnonzero(opened == values)
    v = values[at]
    before, behind = _last_smaller(v, np.greater), len(at) - 1 - _last_smaller(v[::-1], np.greater_equal)[::-1]
    left = np.where(before >= 0, at[before] + 1, 0)
    right = np.where(behind < len(at), at[np.minimum(behind, len(at) - 1)] - 1, n - 1)
    wide = right - left + 1 >= width
    return left[wide], at[wide], right[wide]


def _last_smaller(v: np.ndarray, passes) -> np.ndarray:
    """For each place the last one before it that does not pass(its value, this value), or -1: the parent on the left in the Cartesian tree. All places jump at once to where their last stop points."""
    to = np.arange(len(v)) - 1
    todo = np.flatnonzero(to >= 0)
    todo = todo[passes(v[to[todo]], v[todo])]
    while len(todo):
        to[todo] = to[to[todo]]
        todo = todo[to[todo] >= 0]
        todo = todo[passes(v[to[todo]], v[todo])]
    return to


#: Shingles of the near and the far context of a centre, on either side.
NEAR, FAR = 8, 24


def _contexts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the hash of the NEAR and of the FAR shingles from there on, as far as they fit."""
    one = mix64(s + np.uint64(1))
    chain = lambda x, y, step: mix64(x[: len(y) - step] * np.uint64(0x9E3779B97F4A7C15) + y[step:])
    two = chain(one, one, 1)
    four = chain(two, two, 2)
    eight = chain(four, four, 4)
    sixteen = chain(eight, eight, 8)
    return eight, chain(eight[: len(sixteen)], sixteen, 8)


def windows_of(texts: list[np.ndarray], width: int, hashes: int) -> list[np.ndarray]:
    """Columns (text, v, c, l, r, context) of the compact windows of several texts (word hashes): the text's place in the list, the signature (minimum and, in its last 3 bits, the function), centre, how far
    the window goes left and right of it (65,535 at most), and the context.

    context: 20 bits each of hashes of the FAR shingles right and left of the centre, each followed by a bit that is set if the text is as long as that, then 11 bits each of the NEAR ones. All texts are
    treated as one sequence with the least value between them, so no window of any text reaches beyond it.
    """
    pad = np.zeros(FAR, dtype=np.uint64)
    parts, starts, at = [pad], [], FAR
    for t in texts:
        starts.append(at)
        parts += [t, pad]
        at += len(t) + FAR
    first, sizes = np.array(starts, dtype=np.int64), np.array([len(t) - SHINGLE + 1 for t in texts], dtype=np.int64)
    s = shingles(np.concatenate([*parts, np.zeros(SHINGLE - 1, dtype=np.uint64)]))
    inside = np.zeros(len(s) + 1, dtype=np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + sizes, -1)
    between = np.cumsum(inside[:-1]) == 0
    s[between] = 0
    near, far = _contexts(s)
    found = []
    for i in range(hashes):
        values = mix64(s ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) | np.uint64(1)
        values[between] = 0
        left, centre, right = compact_windows(values, width)
        own = ~between[centre]
        left, centre, right = left[own], centre[own], right[own]
        n = np.searchsorted(first, centre, side="right") - 1
        c, size = centre - first[n], sizes[n]
        bits = lambda x, k: x >> np.uint64(64 - k)
        context = bits(far[centre + 1], 20) << np.uint64(1) | (c + FAR < size).astype(np.uint64)
        context = (context << np.uint64(20) | bits(far[centre - FAR], 20)) << np.uint64(1) | (c >= FAR).astype(np.uint64)
        context = (context << np.uint64(11) | bits(near[centre + 1], 11)) << np.uint64(11) | bits(near[centre - NEAR], 11)
        v = (mix64(values[centre] + np.uint64(i)) & ~np.uint64(7)) | np.uint64(i)
        one = (n, v.view(np.int64), c, np.minimum(centre - left, 65_535), np.minimum(right - centre, 65_535), context.view(np.int64))
        if len(c) > 3 * len(s) // width:  # a text that repeats itself in few words: of equal windows in half a width one is enough, as in links_of
            same = mix64(v ^ mix64(context ^ mix64((n.astype(np.uint64) << np.uint64(32)) + (c // max(1, width // 2)).astype(np.uint64))))
            first_of = np.sort(np.unique(same, return_index=True)[1])
            one = tuple(x[first_of] for x in one)
        found.append(one)
    return [np.concatenate([x[j] for x in found]) for j in range(6)]


def _ranks(x: np.ndarray) -> np.ndarray:
    """How often the value of each place stands before it."""
    order = np.argsort(x, kind="stable")
    at, v = np.arange(len(x)), x[order]
    out = np.empty(len(x), dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(np.concatenate(([True], v[1:] != v[:-1])), at, 0))
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places of a have a value that b has."""
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _room(shared: np.ndarray, width: int, share: float) -> float:
    """The most that shared places in a range of `width` or more exceed its share of places by."""
    p = np.zeros(len(shared) + 1)
    np.cumsum(shared - share, out=p[1:])
    return float((p[width:] - np.minimum.accumulate(p[: len(p) - width])).max())


def _in_order(a: np.ndarray, b: np.ndarray, kinds: int, width: int, share: float) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Ranges of a and b (numbers of shingles) that have enough in common, of those between two shingles that stand once in both, in the same order; or None, which says nothing about others."""
    at = np.full(kinds, -1)
    at[b] = np.arange(len(b))
    once = (np.bincount(a, minlength=kinds) == 1) & (np.bincount(b, minlength=kinds) == 1)
    x = np.flatnonzero(once[a])
    y = at[a[x]]
    fits = np.maximum.accumulate(y) == y
    x, y = x[fits], y[fits]
    start = np.minimum(np.searchsorted(x, x - width + 1, side="right"), np.searchsorted(y, y - width + 1, side="right")) - 1
    last = np.flatnonzero(start >= 0)
    if not len(last):
        return None
    worth = np.arange(len(x)) - share * (x + y)
    gain = worth[last] - np.minimum.accumulate(worth)[start[last]]
    k = last[int(gain.argmax())]
    first = int(worth[: start[k] + 1].argmin())
    own, other = (int(x[first]), int(x[k]) + 1), (int(y[first]), int(y[k]) + 1)
    both = np.minimum(np.bincount(a[own[0] : own[1]], minlength=kinds), np.bincount(b[other[0] : other[1]], minlength=kinds)).sum()
    return (own, other) if both >= share * (own[1] - own[0] + other[1] - other[0]) - SLIP else None


#: Ranges that are looked at in one step, and what a sum of shares may be off by.
STEP, SLIP = 16, 1e-9


class _Partners:
    """For ranges of a the range of b, of `width` or more, whose shingles in common exceed its share of places most; shingles count as often as they stand in both."""

    def __init__(self, a: np.ndarray, b: np.ndarray, kinds: int, width: int, share: float, shift: int | None):
        self.width, self.share, self.m = width, share, len(b)
        self.at = None
        if np.bincount(a, minlength=kinds)[b].max() > 1:
            same = a.astype(np.int32)[:, None] == b.astype(np.int32)
            if shift is not None:  # of one text, only what stands before a place can be shared with it
                same &= np.arange(len(a))[:, None] < np.arange(self.m) + shift
            self.before = np.concatenate((np.zeros((1, self.m), dtype=np.int32), np.cumsum(same, axis=0, dtype=np.int32)))
        else:  # where a has the shingle of each place
            at = np.full(kinds, -1)
            at[a] = np.arange(len(a))
            self.at = at[b]
            if shift is not None:
                self.at[self.at >= np.arange(self.m) + shift] = -1
        self.rank = _ranks(b)
        self.often = self.rank.max() > 0
        if self.often:
            self.order = np.argsort(b, kind="stable")
            self.place = np.empty(self.m, dtype=np.int64)
            self.place[self.order] = np.arange(self.m)
            self.starts, places = np.arange(self.m + 1 - width, dtype=np.int32), np.arange(self.m, dtype=np.int32)[:, None]
            self.behind = places >= self.starts
            self.cost = np.where(places - self.starts < width - 1, np.inf, share * (places + 1 - self.starts))

    def of(self, start: np.ndarray, end: np.ndarray, least: np.ndarray, need: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(excess, from, to) for the ranges start to end of a; the partner starts at least or later. The excess is a bound where it is below need; from and to are set only where it is fit or more."""
        if self.at is None:
            count = self.before[end] - self.before[start]
        else:
            count = ((self.at >= start[:, None]) & (self.at < end[:, None])).astype(np.int32)
        shared = count > 0
        p = np.zeros((len(start), self.m + 1))
        np.cumsum(shared - self.share, axis=1, out=p[:, 1:])
        starts = p[:, : self.m + 1 - self.width]
        if least.any():
            starts = np.where(np.arange(starts.shape[1]) < least[:, None], np.inf, starts)
        gain = p[:, self.width :] - np.minimum.accumulate(starts, axis=1)
        excess, first, to = gain.max(axis=1), np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        loose = (shared & (self.rank >= count)).any(axis=1) if self.often else np.zeros(len(start), dtype=bool)
        for k in np.flatnonzero((excess >= fit) & ~loose):
            last = int(gain[k].argmax())
            first[k], to[k] = starts[k, : last + 1].argmin(), last + self.width
        # Where b has a shingle more often than the range of a, each place counts only from behind as many places before it on. Only starts and ends whose bound reaches need are looked at.
        for k in np.flatnonzero((excess >= need) & loose):
            low = need[k] - SLIP
            ahead = np.maximum.accumulate(p[k, self.width :][::-1])[::-1] - starts[k]
            z, y = (int(x) for x in np.flatnonzero(ahead >= low)[[0, -1]])
            end = int(np.flatnonzero(gain[k] >= low)[-1]) + self.width
            rows, cols = slice(z, end), slice(z, y + 1)
            rank, have = self.rank[rows], count[k, rows]
            after = np.where(rank >= have, self.order[self.place[rows] - np.minimum(have, rank)], -1)
            after[have == 0] = self.m
            sums = np.cumsum((after.astype(np.int32)[:, None] < self.starts[cols]) & self.behind[rows, cols], axis=0, dtype=np.int32) - self.cost[rows, cols]
            last, first[k] = divmod(int(sums.argmax()), sums.shape[1])
            excess[k], first[k], to[k] = sums[last, first[k]], first[k] + z, last + z + 1
        return excess, first, to


def _search(a: np.ndarray, b: np.ndarray, width: int, threshold: float, shift: int | None) -> tuple[int, int, int, int] | None:
    """Passages (from and to of each, ends excluded) of a and b that reach the threshold and `width`, or None if there are none.

    Passages reach the threshold if their shingles in common are at least threshold / (1 + threshold) of the places in both. Sets of ranges of a, each with its first and last start and end, are halved: the
    largest range of a set, its best partner and the smallest range bound what the set can reach, and sets that cannot reach it are left. A set of one range is exact.
    shift: a and b are of one text, b[0] stands so far behind a[0], and the passage of b has to start behind that of a.
    """
    n, m, share = len(a), len(b), threshold / (1 + threshold)
    if min(n, m) < width:
        return None
    poor = lambda shared: _room(shared, width, share) < share * width - SLIP
    if shift is None and (poor(_shared(a, b)) or poor(_shared(b, a))):
        return None
    ids = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
    a, b, kinds = ids[:n], ids[n:], int(ids.max()) + 1
    if shift is not None:  # a place of a is shared with what stands behind it, one of b with what stands before it
        first, last = np.full(kinds, n + m + abs(shift)), np.full(kinds, -n - m - abs(shift))
        first[a[::-1]], last[b] = np.arange(n)[::-1], np.arange(m)
        if poor(last[a] + shift > np.arange(n)) or poor(first[b] < np.arange(m) + shift):
            return None
    if shift is None and (hit := _in_order(a, b, kinds, width, share)):
        return _widened(a, b, *hit, width, share, None)
    partners = _Partners(a, b, kinds, width, share, shift)
    sets, hope = np.array([[0, n - width, width, n]]), np.zeros(1)
    while len(sets):  # the sets that come next to the threshold first
        a0, a1, e0, e1 = sets[:STEP].T
        need, fit = share * np.maximum(width, e0 - a1) - SLIP, share * (e1 - a0) - SLIP
        excess, first, to = partners.of(a0, e1, np.zeros_like(e0) if shift is None else np.maximum(0, e0 - shift), need, fit)
        fits = excess >= fit
        if shift is not None:
            fits &= first >= e1 - shift
        if fits.any():
            k = int(np.argmax(np.where(fits, e1 - a0, 0)))
            return _widened(a, b, (int(a0[k]), int(e1[k])), (int(first[k]), int(to[k])), width, share, shift)
        left = (excess >= need) & ((a1 > a0) | (e1 > e0))
        a0, a1, e0, e1, close = *sets[:STEP][left].T, (excess - fit)[left]
        am, em = (a0 + a1) // 2, (e0 + e1) // 2
        halves = np.array([(*s, *e) for s in ((a0, am), (am + 1, a1)) for e in ((em + 1, e1), (e0, em))])
        more = halves.transpose(0, 2, 1).reshape(-1, 4)
        real = (more[:, 0] <= more[:, 1]) & (more[:, 2] <= more[:, 3]) & (more[:, 3] - more[:, 0] >= width)
        sets, hope = np.concatenate((more[real], sets[STEP:])), np.concatenate((np.concatenate((close,) * 4)[real], hope[STEP:]))
        if len(sets) > STEP:
            order = np.argsort(-hope, kind="stable")
            sets, hope = sets[order], hope[order]
    return None


def _widened(x: np.ndarray, y: np.ndarray, own: tuple[int, int], other: tuple[int, int], width: int, share: float, shift: int | None) -> tuple[int, int, int, int]:
    """The passages own of x and other of y (numbers of shingles) without what is not shared at their ends, as far as `width` allows, and then with all beyond their ends up to the last shared shingle that the threshold allows."""
    kinds = int(max(x.max(), y.max())) + 1
    once = max(np.bincount(x).max(), np.bincount(y).max()) == 1

    def trimmed(s: np.ndarray, at: tuple[int, int], counts: np.ndarray) -> tuple[int, int]:
        shared = np.flatnonzero(counts[s[at[0] : at[1]]])
        start = min(at[0] + int(shared[0]), at[1] - width)
        return start, max(at[0] + int(shared[-1]) + 1, start + width)

    def end(s: np.ndarray, start: int, to: int, counts: np.ndarray, size: int) -> int:
        one = s[start:]
        counted = counts[one] > (0 if once else _ranks(one))
        more = np.flatnonzero(counted & (np.cumsum(counted - share) >= share * size - SLIP))
        return max(to, start + int(more[-1]) + 1) if len(more) else to

    of = lambda s, at: np.bincount(s[at[0] : at[1]], minlength=kinds)
    own = trimmed(x, own, of(y, other))
    other = trimmed(y, other, of(x, own))
    counts, size = of(y, other), other[1] - other[0]
    own = own[0], end(x if shift is None else x[: other[0] + shift], own[0], own[1], counts, size)
    own = len(x) - end(x[::-1], len(x) - own[1], len(x) - own[0], counts, size), own[1]
    counts, size = of(x, own), own[1] - own[0]
    other = other[0], end(y, other[0], other[1], counts, size)
    back = y[::-1] if shift is None else y[max(0, own[1] - shift) :][::-1]
    other = len(y) - end(back, len(y) - other[1], len(y) - other[0], counts, size), other[1]
    return *own, *other


def _run(a: np.ndarray, ca: int, b: np.ndarray, cb: int) -> tuple[int, int]:
    """How many shingles before a[ca] = b[cb], and from there on, a and b have in common without a gap."""
    n = min(len(a) - ca, len(b) - cb)
    off = np.flatnonzero(a[ca : ca + n] != b[cb : cb + n])
    right = int(off[0]) if len(off) else n
    m = min(ca, cb)
    off = np.flatnonzero(a[ca - m : ca][::-1] != b[cb - m : cb][::-1])
    return int(off[0]) if len(off) else m, right


def agree(a: np.ndarray, ca: int, b: np.ndarray, cb: int, width: int, threshold: float, shift: int | None = None) -> tuple[int, int, int, int] | None:
    """The passages (a from, a to, b from, b to; ends included) of a and b that reach the threshold and `width`, or None if there are none.

    What a and b have in common on both sides of a[ca] = b[cb] is one if it is long enough, else all passages of a and b are looked for: their similarity is that of multisets, whatever
    the order of shingles is. shift: a and b are of one text, b[0] stands so far behind a[0], and the passages must not overlap.
    """
    left, right = _run(a, ca, b, cb)
    if left + right >= width and (shift is None or abs(cb + shift - ca) >= left + right):
        return ca - left, ca + right - 1, cb - left, cb + right - 1
    if shift is not None and cb + shift < ca:
        hit = _search(b, a, width, threshold, -shift)
        return hit and (hit[2], hit[3] - 1, hit[0], hit[1] - 1)
    hit = _search(a, b, width, threshold, shift)
    return hit and (hit[0], hit[1] - 1, hit[2], hit[3] - 1)


def agree_within(a: np.ndarray, ca: int, b: np.ndarray, cb: int, width: int, threshold: float, shift: int) -> list[tuple[int, int, int, int]]:
    """As agree, for a and b of one text. A run that a and b have in common may reach into its own copy: then its pieces are passages, each as long as the text goes on before the next copy that does not overlap it."""
    left, right = _run(a, ca, b, cb)
    far = abs(cb + shift - ca)
    copies = -(-width // far)
    size, far = left + right - (copies - 1) * far, copies * far
    if size < width:
        hit = agree(a, ca, b, cb, width, threshold, shift)
        return [hit] if hit else []
    pieces = [(min(k, size - width), min(k + far, size)) for k in range(0, size, far)]
    if cb + shift > ca:
        return [(ca - left + i, ca - left + j - 1, ca - left + i + far - shift, ca - left + j - 1 + far - shift) for i, j in pieces]
    return [(cb - left + i + far + shift, cb - left + j - 1 + far + shift, cb - left + i, cb - left + j - 1) for i, j in pieces]


#: Shingles that are scanned at once.
BATCH = 1 << 18
#: Windows of a signature beyond which it is not dealt with in one task, and signatures at most that are known as such.
HOT, MOST_HOT, SAMPLE = 200_000, 100_000, 64
_WINDOW = "t long, v long, place long, context long"
#: A centre and the reach of its window on both sides in one number, so that less is shuffled.
_PLACE = {"c": "shiftright(place, 32)", "l": "shiftright(place, 16) & 65535", "r": "place & 65535"}
#: Parts of the context: the far one on the right and left with its bit, the near ones.
_RIGHT, _LEFT, _NEAR_RIGHT, _NEAR_LEFT = "shiftrightunsigned(context, 43)", "shiftrightunsigned(context, 22) & 2097151", "shiftrightunsigned(context, 11) & 2047", "context & 2047"


def scan(texts: DataFrame, width: int, hashes: int) -> DataFrame:
    """The compact windows (t, v, place, context) of texts (t, text), as windows_of has them."""
    if not 1 <= hashes <= 8:
        raise ValueError("one to eight functions")

    def flush(ids: list, held: list) -> pa.RecordBatch:
        n, v, c, left, right, context = windows_of(held, width, hashes)
        place = c << 32 | left << 16 | right
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(ids, dtype=np.int64)[n], v, place, context)], names=["t", "v", "place", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            for some in range(0, len(batch), 256):
                part = batch.slice(some, 256)
                for t, words in zip(part.column(0).to_pylist(), word_hashes_of(part.column(1).to_pylist()), strict=True):
                    if len(words) < width + SHINGLE - 1:
                        continue
                    ids.append(t)
                    held.append(words)
                    size += len(words)
                    if size >= BATCH:
                        yield flush(ids, held)
                        ids, held, size = [], [], 0
        if held:
            yield flush(ids, held)

    return texts.select("t", "text").mapInArrow(run, _WINDOW)


def _tree(windows: DataFrame, width: int, hot: bool) -> DataFrame:
    """(t, c, f, exact, level, ht, hc, lo, hi): a link of each window of a shared signature to hubs, of which there is a tree on either side of the centre.

    The windows of a signature that agree in the FAR context of a side are a group, in the NEAR context a larger one, and all of them the largest; each has its least (t, c) as hub. A window is
    tied to its group's hub, that one to the larger group's, and so on. So a passage meets one that goes on as it does, whatever else its signature stands in, and links
    grow with windows, not with pairs. Both windows must have a range of `width` about the centre in common. lo and hi: shingles of that range before and behind the centre.
    exact: the FAR contexts are whole and agree on both sides. hot: groups are aggregated and joined, not gathered.
    """
    me = F.struct("t", "place", "context")

    def with_hub(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        if not hot:
            return rows.withColumn(name, F.min(me).over(Window.partitionBy(*keys)))
        return rows.join(rows.groupBy(*keys).agg(F.min(me).alias(name)), keys)

    rows = windows.withColumn("_r1", F.expr(_NEAR_RIGHT)).withColumn("_r2", F.expr(_RIGHT))
    rows = rows if hot else rows.repartition("v")
    # The finest groups first: the larger ones are in order then too.
    rows = with_hub(with_hub(with_hub(rows, ["v", "_r1", "_r2"], "h_r2"), ["v", "_r1"], "h_r1"), ["v"], "h0")
    if not hot:
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("v"))).where("_n > 1").drop("_n")
    rows = rows.withColumn("_l1", F.expr(_NEAR_LEFT)).withColumn("_l2", F.expr(_LEFT))
    rows = with_hub(with_hub(rows, ["v", "_l1", "_l2"], "h_l2"), ["v", "_l1"], "h_l1")
    other = lambda h: (F.col(h)["t"] != F.col("t")) | (F.col(h)["place"] != F.col("place"))
    step = lambda levels: F.coalesce(*[F.when(other(h), F.struct(F.lit(n).alias("level"), F.col(h).alias("h"))) for n, h in levels])
    right, left = step(((2, "h_r2"), (1, "h_r1"), (0, "h0"))), step(((2, "h_l2"), (1, "h_l1")))
    links = rows.select("t", "v", "place", "context", F.explode(F.array(right, left)).alias("x")).where("x is not null").select("t", "v", "place", "context", "x.level", F.col("x.h.t").alias("ht"), F.col("x.h.place").alias("hplace"), F.col("x.h.context").alias("hcontext"))
    of = lambda part, h: F.expr(part.replace("place", f"{h}place").replace("context", f"{h}context"))
    lo, hi = (F.least(of(_PLACE[k], ""), of(_PLACE[k], "h")).cast("int") for k in ("l", "r"))
    exact = (of(_RIGHT, "") == of(_RIGHT, "h")) & (of(_LEFT, "") == of(_LEFT, "h")) & (of(_RIGHT, "") % 2 == 1) & (of(_LEFT, "") % 2 == 1)
    c, hc = (of(_PLACE["c"], h).cast("int") for h in ("", "h"))
    links = links.select("t", c.alias("c"), F.expr("cast(v & 7 as int)").alias("f"), exact.alias("exact"), "level", "ht", hc.alias("hc"), lo.alias("lo"), hi.alias("hi"))
    return links.where(F.col("lo") + F.col("hi") + 1 >= width)


def links_of(texts: DataFrame, width: int, hashes: int, hot: int = HOT) -> DataFrame:
    """One link (t, c, ht, hc, exact, agreeing) for each half width of a text, partner and shift: the links of all functions whose ranges meet there are joined, agreeing is the number of
    functions, and an exact one, else the one with the longest context in common, stands for them.

    Signatures that a sample of the texts shows to be very frequent go another way to the same links; the sample decides nothing else.
    """
    windows = scan(texts, width, hashes)
    seen = scan(texts.where(F.pmod("t", F.lit(SAMPLE)) == 0), width, hashes).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hot / SAMPLE)
    often = [r["v"] for r in seen.orderBy(F.desc("n")).limit(MOST_HOT).collect()]
    if often:
        frequent = F.broadcast(texts.sparkSession.createDataFrame([(v,) for v in often], "v long"))  # MOST_HOT at most
        gathered = written(windows.join(frequent, "v", "left_semi"), "sd-hot")
        links = _tree(windows.join(frequent, "v", "left_anti"), width, False).unionByName(_tree(gathered, width, True))
    else:
        links = _tree(windows, width, False)
    best = F.max(F.struct("exact", "level", (F.col("lo") + F.col("hi")).alias("size"), (-F.col("c")).alias("c"), (-F.col("hc")).alias("hc"))).alias("b")
    place = [F.expr(f"c div {max(1, width // 2)}").alias("_p"), F.expr(f"(c - hc) div {max(1, width // 2)}").alias("_d")]
    joined = links.groupBy("t", "ht", *place).agg(best, F.expr("bit_count(bit_or(shiftleft(1L, f)))").alias("agreeing"))
    return joined.select("t", (-F.col("b.c")).alias("c"), "ht", (-F.col("b.hc")).alias("hc"), F.col("b.exact").alias("exact"), "agreeing")


#: Texts that are compared with one copy of their hub.
MEMBERS = 128


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _sent(texts: DataFrame, reach: int) -> DataFrame:
    """(ht, part, side, t, places, first, s, n) for texts (t, text, asked: (ht, part, c, hc)): for each hub and part the shingles (low halves) up to reach away from the places c, joined where they meet.

    c = -1 sends a hub's own shingles, c = -2 only the number of words n. Rows of the same text that follow each other count once.
    """
    names = ["ht", "part", "side", "t", "places", "first", "s", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, size = None, [], 0
        for batch in batches:
            for t, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if t == last:
                    continue
                last = t
                words = word_hashes(text.as_py())
                s = shingles(words).astype(np.uint32)
                links: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x in asked.as_py():
                    if x["c"] == -1:
                        rows.append((x["ht"], x["part"], 0, t, [], [0], [s.tobytes()], len(words)))
                        size += len(s)
                    elif x["c"] == -2:
                        rows.append((x["ht"], x["part"], 2, t, [], [], [], len(words)))
                    else:
                        links.setdefault((x["ht"], x["part"]), []).append((x["c"], x["hc"]))
                for (ht, part), places in links.items():
                    spans = _joined([(max(0, c - reach), min(len(s), c + reach + 1)) for c, _ in places])
                    rows.append((ht, part, 1, t, [v for x in sorted(places) for v in x], [a for a, _ in spans], [s[a:b].tobytes() for a, b in spans], len(words)))
                    size += sum(b - a for a, b in spans)
                if size > 1 << 20:
                    yield packed(rows)
                    rows, size = [], 0
        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return texts.select("t", "text", "asked").mapInArrow(run, "ht long, part int, side int, t long, places array<int>, first array<int>, s array<binary>, n int")


def _verified(sent: DataFrame, width: int, threshold: float, reach: int) -> DataFrame:
    """(t, a, b, ht, ha, hb): words from a to b (exclusive) of t are near words ha to hb of ht. sent: as _sent has it.

    A hub's texts come in parts, each with a copy of the hub's shingles, so neither a frequent hub nor its texts meet in one task. A place that lies in what is found already is not looked at again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, done = None, None, None
        for batch in batches:
            rows = []
            for ht, part, side, t, places, first, parts in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if side == 0:
                    at, hub = (ht, part), np.frombuffer(parts[0], np.uint32)
                    continue
                if side == 2 or at != (ht, part) or (ht, part, t) == done:
                    continue
                done = (ht, part, t)
                own, found = [np.frombuffer(x, np.uint32) for x in parts], []
                for c, hc in zip(places[::2], places[1::2], strict=True):
                    if any(a <= c < b and ha <= hc < hb for a, b, ha, hb in found):
                        continue
                    k = int(np.searchsorted(first, c, side="right")) - 1
                    lo, hlo = max(0, c - first[k] - reach), max(0, hc - reach)
                    x, y = own[k][lo : c - first[k] + reach + 1], hub[hlo : hc + reach + 1]
                    place = first[k] + lo
                    if t == ht:
                        hits = agree_within(x, c - place, y, hc - hlo, width, threshold, hlo - place)
                    else:
                        hits = [agree(x, c - place, y, hc - hlo, width, threshold)]
                    found += [(h[0] + place, h[1] + place + 1, h[2] + hlo, h[3] + hlo + 1) for h in hits if h]
                rows += [(t, a, b + SHINGLE - 1, ht, ha, hb + SHINGLE - 1) for a, b, ha, hb in found]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["t", "a", "b", "ht", "ha", "hb"])

    dealt = sent.where("side < 2").repartition("ht", "part").sortWithinPartitions("ht", "part", "side", "t")
    return dealt.mapInArrow(run, "t long, a int, b int, ht long, ha int, hb int")


def repeated_passages(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """(doc_id, start_word, end_word, class_id, first_doc): passages of whole texts that stand near-identically elsewhere.

    Words are runs of non-blanks without regard to case; passages have `words` words at least and, to their partner, a similarity of five-word
    shingles of threshold or more. Compact windows of equal signature are linked in trees of hubs (`_tree`), the links of all functions joined by their ranges (`links_of`), and those that are not
    exact already verified on the texts. Overlapping hits in a text are one passage; class_id names the component
    of linked passages, first_doc is the smallest doc_id in it. Equal texts are one: each copy gets the text's passages and, if long enough,
    is a passage itself. A null doc_id is reported as such; null, empty and shorter texts have no rows; repeated rows have the same passages once. Other columns are ignored.
    An empty table gives an empty result.
    """
    width, reach = max(1, words - SHINGLE + 1), 2 * words
    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    owners = written(rows.groupBy("t", "doc_id").agg(F.count("*").alias("n")), "sd-owners")
    owned = owners.groupBy("t").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep"))
    links = written(links_of(rows.select("t", "text"), width, hashes), "sd-links")
    spark = docs.sparkSession
    release(spark)
    # What is exact as far as the contexts go needs no text.
    far = min(FAR, width)
    proven = links.where(F.col("exact") & (F.lit(2 * FAR + 1) >= width) & ((F.col("t") != F.col("ht")) | (F.abs(F.col("c") - F.col("hc")) >= 2 * FAR + 1 + SHINGLE)))
    span = lambda c: [(F.col(c) - far).cast("int"), (F.col(c) + far + SHINGLE).cast("int")]
    proven_hits = proven.select("t", span("c")[0].alias("a"), span("c")[1].alias("b"), "ht", span("hc")[0].alias("ha"), span("hc")[1].alias("hb"))
    # The texts tell where a run of them ends.
    row = Window.partitionBy("t", "ht", F.col("c") - F.col("hc")).orderBy("c")
    inner = proven.withColumn("_in", (F.col("c") - F.lag("c").over(row) <= 2 * FAR) & (F.lead("c").over(row) - F.col("c") <= 2 * FAR)).where("_in").select("t", "c", "ht", "hc")
    rest = links.join(inner, ["t", "c", "ht", "hc"], "left_anti").select("t", "c", "ht", "hc")
    parts = rest.select("ht", "t").distinct().groupBy("ht").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = rest.join(parts, "ht").select("t", "ht", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int").alias("part"), "c", "hc")
    hubs = parts.select(F.col("ht").alias("t"), "ht", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("c"), F.lit(0).alias("hc"))
    copied = owned.where("n > 1").select("t", F.col("t").alias("ht"), F.lit(0).alias("part"), F.lit(-2).alias("c"), F.lit(0).alias("hc"))
    asked = members.unionByName(hubs).unionByName(copied).groupBy("t").agg(F.collect_list(F.struct("ht", "part", "c", "hc")).alias("asked"))  # one text's own places
    asked = asked.join(owned.select("t", "rep"), "t").select(F.col("t").alias("_t"), F.col("rep.doc_id").alias("_d"), "asked")
    sent = written(_sent(rows.join(asked, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))), reach), "sd-sent")
    whole = sent.where((F.col("side") == 2) & (F.col("n") >= words))
    copies = whole.select("t", F.lit(0).alias("a"), F.col("n").alias("b"), F.col("t").alias("ht"), F.lit(0).alias("ha"), F.col("n").alias("hb"))
    release(spark)
    hits = written(proven_hits.unionByName(_verified(sent, width, threshold, reach)).unionByName(copies).distinct(), "sd-hits")
    discard(links, sent)
    release(spark)

    # Overlapping hits in a text are one passage.
    sides = hits.select("t", "a", "b").unionByName(hits.select(F.col("ht").alias("t"), F.col("ha").alias("a"), F.col("hb").alias("b"))).distinct()
    order = Window.partitionBy("t").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    sides = sides.withColumn("new", F.when(F.col("a") < before, 0).otherwise(1))
    sides = sides.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sides = written(sides.withColumn("node", F.xxhash64("t", "g")).select("t", "a", "b", "node"), "sd-sides")
    nodes = sides.groupBy("t", "node").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    ends = hits.join(sides.withColumnRenamed("node", "x"), ["t", "a", "b"])
    ends = ends.join(sides.select(F.col("t").alias("ht"), F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("node").alias("y")), ["ht", "ha", "hb"])
    comps = written(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "sd-comps")
    found = nodes.join(comps, "node", "left").select("t", F.col("a").alias("start_word"), F.col("b").alias("end_word"), F.coalesce("comp", "node").alias("class_id"))
    found = written(found, "sd-passages")
    every = owners.select("doc_id", "t").join(found, "t")
    first = every.groupBy("class_id").agg(F.min("doc_id").alias("first_doc"))
    return every.join(first, "class_id").select("doc_id", "start_word", "end_word", "class_id", "first_doc")
