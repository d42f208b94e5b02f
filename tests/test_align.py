"""Local alignment, exact alignment, gaps, redundancy and alignment chains against brute force."""

import random

import numpy as np
import pytest

from strandlake.functions import cigar
from strandlake.operators import align, alnchain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def mutated(seq, rate, rng):
    out = []
    for x in seq:
        r = rng.random()
        if r < rate / 3:
            continue
        if r < 2 * rate / 3:
            out.append(int(rng.integers(0, 4)))
        out.append((int(x) + 1) % 4 if r > 1 - rate / 3 else int(x))
    return np.array(out, dtype=np.uint8)


def fits(ops, a, b):
    i = j = 0
    for n, op in ops:
        for _ in range(n):
            if op in "=X":
                assert (a[i] == b[j]) == (op == "=")
            i, j = i + (op != "D"), j + (op != "I")
    return (i, j) == (len(a), len(b))


def test_exact_operations_have_the_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = (rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 25))).astype(np.uint8) for _ in range(2))
        ops = align.exact_operations(a, b)
        assert fits(ops, a, b) and sum(n for n, op in ops if op != "=") == distance(a.tolist(), b.tolist())


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.15])
def test_planted_similarity_is_found(rate):
    rng = np.random.default_rng(int(rate * 100))
    found = 0
    for _ in range(10):
        core = rng.integers(0, 4, 600).astype(np.uint8)
        noise = lambda n: rng.integers(0, 4, n).astype(np.uint8)  # noqa: E731, B023
        other = mutated(core, rate, rng)
        a, b = np.concatenate((noise(200), core, noise(150))), np.concatenate((noise(90), other, noise(300)))
        x = align.local_alignment(a, b, 80, 140, 200 + 90 + 400)
        if x and x.aepos - x.abpos >= 450:
            found += 1
            assert fits(x.ops, a[x.abpos : x.aepos], b[x.bbpos : x.bepos])
            assert x.diffs <= 0.3 * (x.aepos - x.abpos)
            diffs, points = cigar.trace(x.ops, x.abpos)
            assert sum(diffs) == x.diffs and sum(points) == x.bepos - x.bbpos
            again = align.from_trace(a, b, x.abpos, x.aepos, x.bbpos, points)
            assert fits(again, a[x.abpos : x.aepos], b[x.bbpos : x.bepos]) and sum(n for n, op in again if op != "=") <= x.diffs
    assert found >= 9


def test_unlike_sequences_do_not_align():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 4, 800).astype(np.uint8) for _ in range(2))
    x = align.local_alignment(a, b, -5, 5, 800)
    assert x is None or not align.worth(x, align.Rules())


def test_gaps_of_one_kind_are_merged_where_that_is_cheaper():
    rng = np.random.default_rng(4)
    b = rng.integers(0, 4, 120).astype(np.uint8)
    a = np.concatenate((b[:60], rng.integers(0, 4, 7).astype(np.uint8), b[60:]))
    ops = [(60, "="), (3, "I"), *align.exact_operations(a[63:66], b[60:63]), (4, "I"), *align.exact_operations(a[70:], b[63:])]
    new = align.better_gaps(cigar.joined(ops), a, b, 0, 0)
    assert fits(new, a, b) and cigar.spans(new) == (len(a), len(b))
    assert sum(n for n, op in new if op in "ID") == 7 and len([1 for _, op in new if op in "ID"]) == 1


def test_redundant_alignments_go():
    def one(a, b, n):
        return align.Alignment(a, a + n, b, b + n, [(n, "=")])

    kept = align.without_redundancy([one(0, 0, 500), one(0, 0, 300), one(200, 200, 300), one(900, 100, 200), one(905, 105, 150)])
    assert sorted((x.abpos, x.aepos, x.bbpos) for x in kept) == [(0, 500, 0), (900, 1100, 100)]
    spliced = align.without_redundancy([one(0, 10, 400), one(250, 260, 500)])
    assert [(x.abpos, x.aepos, x.bbpos, x.bepos, x.ops) for x in spliced] == [(0, 750, 10, 760, [(750, "=")])]


def test_predecessors_equal_brute_force():
    rng = random.Random(5)
    p = alnchain.Params(gap=300, overlap=100, drop=200, score=1)
    for _ in range(60):
        rows = sorted((rng.randrange(3000), rng.randrange(50, 400), rng.randrange(3000), rng.randrange(50, 400)) for _ in range(25))
        ab, ae, bb, be = (np.array(x) for x in zip(*((a, a + n, b, b + m) for a, n, b, m in rows), strict=True))
        score, _ = alnchain.best_predecessors(ab, ae, bb, be, p)
        want = []
        for i in range(len(ab)):
            best = float(ae[i] - ab[i] + be[i] - bb[i])
            for j in range(i):
                ga, gb = ab[i] - ae[j], bb[i] - be[j]
                ea, eb = ae[i] - max(ab[i], ae[j]), be[i] - max(bb[i], be[j])
                if ga > 300 or gb > 300 or -ga > 100 or -gb > 100 or ea <= 0 or eb <= 0 or -ga >= ae[j] - ab[j] or -gb >= be[j] - bb[j]:
                    continue
                best = max(best, want[j] + ea + eb - 0.1 * (max(0, ga) + max(0, gb)) - 0.1 * (max(0, -ga) + max(0, -gb)))
            want.append(best)
        assert np.allclose(score, want)


def test_predecessors_are_looked_up_on_both_sides():
    import time

    def took(n):
        rng = np.random.default_rng(6)
        ab, bb = np.sort(rng.integers(0, 9000, n)), rng.integers(0, 200 * n * 100, n)
        began = time.process_time()
        alnchain.best_predecessors(ab, ab + 400, bb, bb + 400, alnchain.Params())
        return time.process_time() - began

    took(500)
    assert took(24_000) < 14 * took(4000)  # all lie near each other on A, few on B


def test_empty_alignments_have_no_predecessors():
    ab, ae, bb, be = (np.array(x) for x in ([0, 50, 50, 90], [100, 50, 120, 190], [0, 60, 60, 70], [100, 60, 60, 170]))
    score, prev = alnchain.best_predecessors(ab, ae, bb, be, alnchain.Params())
    assert prev.tolist() == [-1, -1, -1, 0] and score[1] == 0
    assert [len(x) for x in alnchain.best_predecessors(*(np.zeros(0, dtype=np.int64),) * 4, alnchain.Params())] == [0, 0]


def test_alignments_are_chained(spark):
    rows = [(i, 0, 0, False, 1000 * i, 1000 * i + 900, 1000 * i + 50, 1000 * i + 950, 20_000) for i in range(12)] + [(50, 0, 0, True, 15_000, 15_500, 100, 600, 20_000), (60, 0, 0, False, 2000, 2100, 9000, 9100, 20_000)]
    df = spark.createDataFrame(rows, "aln long, ascaf long, bscaf long, comp boolean, abpos long, aepos long, bbpos long, bepos long, blen long")
    got = alnchain.chain(df).orderBy("chain_id", "fragment").collect()
    assert [(r.aln, r.fragment, r.agap, r.bgap) for r in got] == [(i, i, 100 * (i > 0), 100 * (i > 0)) for i in range(12)]
    assert alnchain.chain(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alnchain.Params(covered=2)
