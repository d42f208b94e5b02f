"""Sequence and interval operators on small fixtures."""

import random

import pytest

from strandlake.operators import chains, intervals, kmers, ordered, seeds, sequences, stats
from strandlake.sources import intervals_text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_contigs_lie_between_runs_of_n(spark):
    df = spark.createDataFrame([(0, "NNACGNTT"), (1, "acgt"), (2, "NNN"), (3, ""), (4, None)], "scaf int, seq string")
    assert rows(sequences.contigs(df)) == [(0, 0, 2, 3, "ACG"), (0, 1, 6, 2, "TT"), (1, 0, 0, 4, "acgt")]


def test_letters_become_bases_outside_the_jvm(spark):
    df = spark.createDataFrame([(None,), ("",), ("Ab. z\n\u00e9",), ("\u212a\u0130\u017f",)], "t string").select(sequences.dna(sequences.F.col("t")).alias("d"), sequences.gapped_dna(sequences.F.col("t")).alias("g"))
    assert [tuple(r) for r in df.collect()] == [(None, None), ("", ""), ("acc", "AcNc"), ("ga", "")]
    assert "translate(" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [0, 3, 4, 259, 600])
def test_kmers_equal_brute_force(spark, n):
    seq = ("acgtt" * 200)[:n]
    df = spark.createDataFrame([(1, seq)], "id int, seq string")
    number = lambda w: sum("acgt".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    assert rows(kmers.words(df, "id", 4)) == sorted((1, i, number(seq[i : i + 4]), 0) for i in range(n - 3))
    assert rows(kmers.words(df, "id", 23)) == sorted((1, i, number(seq[i : i + 20]), number(seq[i + 20 : i + 23])) for i in range(n - 22))


def test_kmers_that_travel_in_runs_are_counted_as_others(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core = letters(300)
    seqs = ["a" * 700, core, letters(50) + core + "ac" * 200, core[::-1], "acgt" * 10, "acg", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string").repartition(2)
    for k in (1, 7, 16, 20, 21, 40):
        assert rows(kmers.histogram_of(df, k)) == rows(kmers.histogram(kmers.words(df, "id", k)))
        assert rows(kmers.histogram_of(df, k, 2, 20, distinct=False)) == rows(kmers.histogram(kmers.words(df, "id", k), 2, 20, distinct=False))
    assert rows(kmers.frequencies(df.limit(0), 40)) == [] and rows(kmers.frequencies(df, 40, at_once=7)) == rows(kmers.frequencies(df, 40))
    cut = kmers._cut([sequences.codes(letters(200_000))], 40)
    assert sum(len(x.as_py()) for c in ("sizes", "bases") for x in cut.column(c)) < 1.3 * 200_000  # a row a k-mer has 24 bytes and more
    size, bits = (kmers.np.frombuffer(b"".join(cut.column(c).to_pylist()), dtype=kmers.np.uint8) for c in ("sizes", "bases"))
    assert sum(len(k1) for k1, _ in kmers._kmers_of(size.astype(int), bits, 40)) == 200_000 - 39


def test_counts_of_common_prefixes_equal_those_of_the_rows(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core = letters(400)
    df = spark.createDataFrame(list(enumerate([core, core, letters(80) + core[:200], "at" * 90, core[100:160] + letters(40), "acg", None])), "ctg int, seq string").repartition(2)
    want = rows(kmers.with_lcp(kmers.index(df, "ctg")).groupBy("lcp").count())
    assert rows(kmers.lcp_counts(df)) == rows(kmers.lcp_counts(df, at_once=3)) == want and len(want) > 4
    assert kmers.lcp_counts(df.limit(0)).collect() == []


def test_touching_intervals_are_merged(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 2, 3), (2, 6, 8)], "g int, beg long, end long")
    assert rows(intervals.union(df, "g")) == [(1, 0, 7), (1, 9, 10), (2, 6, 8)]


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 50, 51), (1, 7, 7)], "g int, beg long, end long")
    b = spark.createDataFrame([(1, 99, 300), (1, 100, 120), (1, 0, 1000)], "g int, rbeg long, rend long")
    assert rows(intervals.overlaps(a, b, "g")) == [(1, 0, 100, 0, 1000), (1, 0, 100, 99, 300), (1, 50, 51, 0, 1000)]


def test_length_quantiles_of_few_and_none(spark):
    df = spark.createDataFrame([(10,), (10,), (80,)], "len long")
    assert rows(intervals.length_quantiles(df, [50, 80, 90])) == [(50, 80), (80, 80), (90, 10)]
    assert rows(intervals.length_quantiles(df.limit(0), [50])) == []


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(3), b, b + rng.choice([0, 1, 5, 63, 64, 65, 700, 90_000])) for b in (rng.randrange(100_000) for _ in range(n))]
    a, b = make(120), make(100)
    got = rows(intervals.overlaps(spark.createDataFrame(a, "g int, beg long, end long"), spark.createDataFrame(b, "g int, rbeg long, rend long"), "g"))
    assert got == sorted((g, x, y, s, t) for g, x, y in a for h, s, t in b if g == h and x < t and s < y and x < y and s < t)


def test_points_in_intervals_equal_brute_force_without_a_broadcast(spark):
    rng = random.Random(3)
    spans, points = [], []
    for g in range(3):
        cuts = sorted(rng.sample(range(400_000), 40)) + [500_000, 900_000]
        spans += [(g, b, e, f"{g}.{b}") for b, e in zip(cuts[::2], cuts[1::2], strict=True)] + [(g, cuts[1], cuts[1], "empty")]
        points += [(g, x) for x in [*cuts, *(c - 1 for c in cuts), *(rng.randrange(1_000_000) for _ in range(50))]]
    points += [(None, 5), (1, None), (7, 3)]
    got = intervals.holding(spark.createDataFrame(points, "g int, at long"), spark.createDataFrame(spans, "g int, rbeg long, rend long, name string"), "g", "at")
    assert rows(got) == sorted((g, x, b, e, n) for g, x in points for h, b, e, n in spans if g == h and x is not None and b <= x < e)
    own = spark.createDataFrame([(g, i, b, e - b) for i, (g, b, e, _) in enumerate(spans)], "scaf int, ctg int, sbeg long, clen long")
    back = intervals_text.on_scaffolds(intervals_text.on_contigs(own.selectExpr("scaf", "sbeg as beg", "sbeg + clen as end"), own), own)
    assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString() and back.count() == len(spans) - 3


def test_empty_intervals(spark):
    none = spark.createDataFrame([], "g int, beg long, end long")
    lengths = spark.createDataFrame([(1, 50)], "g int, clen long")
    assert rows(intervals.union(none, "g")) == [] and rows(intervals.uncovered(none, lengths, "g")) == [(1, 0, 50)]
    assert rows(intervals.total_size(none, "g")) == [] and rows(stats.log_histogram(none.selectExpr("end as len"))) == []
    totals = intervals.annotation_totals(none.selectExpr("*", "1 as orient", "'x' as label", "1 as score", "true as parsed"), lengths, "g").first()
    assert (totals.n, totals.span, totals.uncovered, totals.gaps) == (0, 0, 50, 1)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x")
    assert rows(ordered.numbered(df, ["x"])) == [(i, i) for i in range(1000)]
    assert rows(ordered.slice_rows(df, ["x"], 10, 13)) == [(10,), (11,), (12,)]
    sums = rows(ordered.running(df.selectExpr("x", "cast(1 as long) as w"), "x", "w", "upto", descending=True).select("x", "upto"))
    assert sums == [(i, 1000 - i) for i in range(1000)]


def revcomp(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def plain_index(seqs):
    """(ctg, pos, neg, kmer) by the rule, letter by letter."""
    number = lambda w: sum("acgt".index(c) * 4 ** (3 - i) for i, c in enumerate(w))
    rank = lambda w: kmers.RANKS[number(w[:4])] * 256 + kmers.RANKS[number(w[4:])]
    out = []
    for ctg, s in seqs:
        for j in range(len(s) - 11):
            r = [min(rank(s[j + i : j + i + 8]), rank(revcomp(s[j + i : j + i + 8]))) for i in range(5)]
            if min(r) in (r[0], r[4]):
                if j + 40 <= len(s):
                    out.append((ctg, j, False, s[j : j + 40]))
                if j >= 28:
                    out.append((ctg, j + 12, True, revcomp(s[j - 28 : j + 12])))
    return out


def common(x, y):
    return next((i for i, (c, d) in enumerate(zip(x, y, strict=True)) if c != d), len(x))


def test_adaptive_seeds_equal_brute_force(spark):
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core, low = letters(90), "at" * 40
    a = [(0, letters(60) + core + letters(30)), (1, low + letters(50)), (2, "acg"), (3, "a" * 41)]
    b = [(0, letters(40) + core[:50] + "a" + core[51:] + letters(40)), (1, revcomp(core) + letters(60)), (2, low * 3), (4, letters(20) + core[20:70])]
    b += [(10 + i, core[30:75]) for i in range(4)]
    frame = lambda x: kmers.index(spark.createDataFrame(x, "ctg long, seq string"), "ctg")
    ia, ib = plain_index(a), plain_index(b)
    assert len(ia) == frame(a).count()
    want = []
    for ctg, pos, neg, k in ia:
        if neg:
            continue
        size = max((common(k, x[3]) for x in ib), default=0)
        hits = [x for x in ib if common(k, x[3]) >= size]
        if size >= 12 and len(hits) < 5:
            want += [(size, ctg, pos, x[0], x[1], x[2]) for x in hits]
    assert rows(seeds.adaptive_seeds(frame(a), frame(b), freq=5)) == sorted(want) and want
    own = []
    for i, (ctg, pos, neg, k) in enumerate(ib):
        size = max((common(k, x[3]) for j, x in enumerate(ib) if j != i), default=0)
        hits = [(j, x) for j, x in enumerate(ib) if common(k, x[3]) >= size]
        if size >= 12 and len(hits) < 5:
            own += [(size, ctg, pos, x[0], x[1], neg != x[2]) for j, x in hits if j != i]
    assert rows(seeds.self_seeds(frame(b), freq=5)) == sorted(own) and own
    assert rows(seeds.adaptive_seeds(frame(a).limit(0), frame(b))) == [] == rows(seeds.adaptive_seeds(frame(a), frame(b).limit(0)))


def test_only_kmers_that_can_match_are_dealt_out(spark, monkeypatch):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core = letters(60)
    a, b = [(0, core)], [(i, letters(400) + core[:48] + letters(400)) for i in range(4)]
    frame = lambda x: kmers.index(spark.createDataFrame(x, "ctg long, seq string"), "ctg")
    known = {k[:12] for _, _, _, k in plain_index(a)}
    assert kmers.sharing(frame(b), frame(a)).count() == sum(k[:12] in known for _, _, _, k in plain_index(b)) > 0
    assert kmers.sharing(frame(b), frame(a).limit(0)).count() == 0
    dealt, plain = [], seeds.longest_prefix_matches
    monkeypatch.setattr(seeds, "longest_prefix_matches", lambda x, y, *rest: dealt.append((x.count(), y.count())) or plain(x, y, *rest))
    for run in (seeds.adaptive_seeds, seeds.symmetric_seeds, seeds.similarity):
        run(frame(a), frame(b))
    assert len(dealt) == 4 and all(max(n) < len(plain_index(b)) / 10 for n in dealt)


@pytest.mark.parametrize(("gap", "chained"), [(1999, 1), (2000, 2), (2001, 2)])
def test_chains_break_at_the_gap(spark, gap, chained):
    seed = lambda at: (40, 0, at, 0, at, False)
    left = [seed(x) for x in range(0, 100, 20)]
    start = (2 * 80 + 2 * 40 + gap) / 2
    right = [(40, 0, int(start + 0.5) + x, 0, int(start) + x, False) for x in range(0, 100, 20)]
    df = spark.createDataFrame(left + right, "len int, actg long, apos long, bctg long, bpos long, comp boolean")
    got = chains.chains(chains.diagonals(df, 5000, 5000)).collect()
    assert len(got) == chained
    assert rows(chains.chains(chains.diagonals(df.limit(0), 1, 1))) == []


def test_chains_need_coverage(spark):
    df = spark.createDataFrame([(40, 0, 0, 0, 0, False), (40, 0, 44, 0, 44, False)], "len int, actg long, apos long, bctg long, bpos long, comp boolean")
    assert rows(chains.chains(chains.diagonals(df, 99, 99), chain_min=80)) != [] and rows(chains.chains(chains.diagonals(df, 99, 99), chain_min=81)) == []
