"""CIGAR functions, selections, sources, displays and the object interface on small fixtures."""

import random

import pytest

from strandlake.api import Alignments, Genome
from strandlake.functions import cigar, display, records
from strandlake.operators import align, kmers, ordered, selection, sequences, stats
from strandlake.sources import alignment_text, fasta, intervals_text, paths, tables
from strandlake.storage import fresh_path


def test_positions_as_people_write_them():
    assert [records.position(x) for x in ("7", "10.1k", "2M", "1.25G", "0.001k")] == [7, 10_100, 2_000_000, 1_250_000_000, 1]
    for wrong in ("", "1.5", "1.0001k", "x", "-3"):
        with pytest.raises(ValueError):
            records.position(wrong)


def test_cigar_round_trips():
    rng = random.Random(1)
    for _ in range(200):
        ops = cigar.joined((rng.randrange(1, 9), rng.choice("=XID")) for _ in range(rng.randrange(1, 12)))
        assert cigar.parse(cigar.text(ops)) == ops and cigar.parse("X3=") == [(1, "X"), (3, "=")]
        la, lb = cigar.spans(ops)
        a0, b0 = rng.randrange(500), rng.randrange(500)
        assert cigar.from_indels(cigar.indels(ops, a0, b0), a0, a0 + la, b0, b0 + lb) == cigar.matches_as_m(ops)
        diffs, points = cigar.trace(ops, a0)
        assert sum(points) == lb and sum(diffs) == sum(n for n, op in ops if op != "=")
        assert sum(cigar.spans(p[2])[0] + p[3] for p in cigar.pieces(ops, a0, b0, 3)) <= la
    with pytest.raises(ValueError):
        cigar.parse("3Q")
    with pytest.raises(ValueError):
        cigar.psl([(3, "=")], 0, 4, 9, 0, 3, False, 3)


def test_compared_equals_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        ops = cigar.joined((rng.randrange(1, 9), rng.choice("MXID")) for _ in range(rng.randrange(0, 12)))
        la, lb = cigar.spans(ops)
        a, b = ("".join(rng.choice("aAcC") for _ in range(n)) for n in (la, lb))
        want, i, j = [], 0, 0
        for n, op in ops:
            for _ in range(n):
                want.append((1, op if op in "ID" else "=" if a[i].lower() == b[j].lower() else "X"))
                i, j = i + (op != "D"), j + (op != "I")
        assert cigar.compared(ops, a, b) == cigar.joined(want)
    with pytest.raises(ValueError):
        cigar.compared([(3, "M")], "acg", "ac")


def test_records_of_documents_equal_plain_python(spark, tmp_path):
    import re

    from strandlake.plans import trace_queries as tq

    texts = [None, "", "12 . 3", "Ab\u00e9cD ef-Gh\u0130i j k lm n\u212ao p", "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = tq._records(spark, str(tmp_path), True)
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()  # each word went through the JVM's functions
    found = {r.doc_id: r for r in got.collect()}
    assert sorted(found) == [3, 4]
    for i, r in found.items():
        words = [(w.lower().translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", ("acgt" * 7)[:26])), "=X=I=D"[n % 6]) for n, w in enumerate(re.findall("[A-Za-z]+", texts[i]))]
        size = lambda kinds: sum(len(w) for w, op in words if op in kinds)  # noqa: B023, E731
        assert (r.cigar, r.la, r.lb, r.diffs, r.dels, r.same) == ("".join(f"{len(w)}{op}" for w, op in words), size("=XI"), size("=XD"), size("XID"), size("D"), size("="))
        assert r.a == "".join(w for w, op in words if op != "D") and r.b == "".join(w.translate(str.maketrans("acgt", "cgta")) if op == "X" else w for w, op in words if op != "I")


def test_valid_cigars(spark):
    df = spark.createDataFrame([("3=2I1D", 5, 4), ("3=2I1D", 5, 5), ("3=7Q", 3, 3), ("", 0, 0), ("=X", 2, 2), ("\u0663=", 3, 3), (None, 0, 0)], "c string, a long, b long")
    assert [r.v for r in df.select(cigar.valid(cigar.F.col("c"), cigar.F.col("a"), cigar.F.col("b")).alias("v")).collect()] == [True, False, False, True, True, False, None]


def test_psl_trims_indels_at_the_ends():
    got = cigar.psl([(2, "I"), (5, "="), (1, "X"), (3, "D"), (4, "="), (2, "D")], 10, 22, 40, 100, 115, False, 9)
    assert (got["qstart"], got["qend"], got["tstart"], got["tend"]) == (12, 22, 100, 113)
    assert (got["blocks"], got["qstarts"], got["tstarts"], got["mismatches"], got["tnuminsert"]) == ([6, 4], [12, 18], [100, 109], 1, 1)


def genome():
    rows = [(0, "one", 0, 100, 260), (0, "one", 120, 140, 260), (1, "two", 5, 50, 60), (2, "2b", 0, 30, 30)]
    return selection.Genome([selection.Contig(i, s, n, b, c, w) for i, (s, n, b, c, w) in enumerate(rows)])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1", [(0, 0, 0, 100, 0), (0, 1, 0, 140, 0)]),
        ("one.2", [(0, 1, 0, 140, 0)]),
        ("1.#-", [(0, 1, 0, 140, -1)]),
        ("1:90-130", [(0, 0, 90, 100, 0), (0, 1, 0, 10, 0)]),
        ("1:90-2:10+", [(0, 0, 90, 100, 1), (0, 1, 0, 140, 1), (0, 2, 0, 5, 1)]),
        ("1.2:0.1k-2.1:7 #", [(0, 1, 100, 140, 0), (0, 2, 0, 7, 0), (1, 3, 0, 30, 0)]),
        ("@", [(0, 0, 0, 100, 0), (0, 1, 0, 140, 0), (0, 2, 0, 50, 0), (0, 3, 0, 30, 0)]),
        (".", [(0, 0, 0, 100, 0), (0, 1, 0, 140, 0), (0, 2, 0, 50, 0), (0, 3, 0, 30, 0)]),
        ("1:101-119", []),
    ],
)
def test_selections(text, want):
    g = genome()
    assert selection.on_contigs(g, selection.parse(g, text)) == want


@pytest.mark.parametrize("text", ["1:5", "9", "none", "2-1", "1-1.2", "1.3", "1:300-400", "two:x-3"])
def test_wrong_selections_are_errors(text):
    g = genome()
    with pytest.raises(ValueError):
        selection.parse(g, text)


def test_hulls_and_points():
    g = genome()
    parts = selection.on_contigs(g, selection.parse(g, "1:10-20 1:50-60+ 2"))
    assert selection.hulls(parts) == [(0, 0, 10, 60, 1), (2, 2, 0, 50, 0)]
    with pytest.raises(ValueError):
        selection.hulls(selection.on_contigs(g, selection.parse(g, "1:10-20+ 1:50-60-")))
    assert selection.point(g, "1:125") == (1, 5) and selection.point(g, "two.1:3") == (2, 3)
    with pytest.raises(ValueError):
        selection.point(g, "1:110")


def test_selection_files(spark, tmp_path):
    (tmp_path / "s").write_text("1:10-20 # remark\n# all of it a remark\n#-\n")
    assert selection.read_file(spark, str(tmp_path / "s")).split() == ["1:10-20", "#-"]


def test_fasta_with_gaps_cases_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_text("> one first\nacgtNN\nACG\n\n>two\n\n>three\nNNaNcc\n")
    df = fasta.read(spark, str(tmp_path / "x.fa"))
    assert sorted(map(tuple, df.collect())) == [("one first", "acgtNNACG"), ("three", "NNaNcc"), ("two", "")]
    numbered = fasta.with_numbers(df)
    assert [(r.scaf, r.name, r.slen) for r in numbered.orderBy("scaf").collect()] == [(0, "one first", 9), (1, "three", 6), (2, "two", 0)]
    got = sequences.contigs(numbered.select("scaf", "seq"), min_gap=2)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 4, "acgt"), (0, 1, 6, 3, "ACG"), (1, 0, 2, 4, "aacc")]
    assert sorted(map(tuple, sequences.masks(sequences.contigs(numbered.select("scaf", "seq")), ["scaf", "ctg"]).collect())) == []
    back = fasta.assembled(numbered.drop("seq"), sequences.contigs(numbered.select("scaf", "seq")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_bed_lines(spark, tmp_path):
    scaffolds = spark.createDataFrame([(0, "chr1 long name", 100), (1, "chr2", 50)], "scaf long, name string, slen long")
    (tmp_path / "a.bed").write_text("# remark\ntrack name=x\nchr1\t5\t10\nchr2\t0\t50\tgene\t7\t-\n\n")
    got = intervals_text.read_bed(spark, str(tmp_path / "a.bed"), scaffolds)
    assert sorted(map(tuple, got.collect())) == [(0, 5, 10, 0, 0, None), (1, 0, 50, 1, 7, "gene")]
    for n, line in enumerate(("chr9\t1\t2", "chr2\t1\t51", "chr2\t7\t6", "chr2\tx\t6", "chr2\t3")):
        (tmp_path / f"bad{n}").write_text(line + "\n")
        with pytest.raises(Exception, match="no interval of the genome"):
            intervals_text.read_bed(spark, str(tmp_path / f"bad{n}"), scaffolds).collect()


def test_paf_errors(spark, tmp_path):
    (tmp_path / "x").write_text("q\t9\t0\t4\t+\tt\t9\t1\t5\t4\t4\t255\tcg:Z:4M\n")
    assert alignment_text.read_paf(spark, str(tmp_path / "x")).first().cg == "4M"
    with pytest.raises(Exception, match="no exact alignment"):
        alignment_text.read_paf(spark, str(tmp_path / "x"), exact=True).collect()
    (tmp_path / "y").write_text("q\t9\t0\n")
    with pytest.raises(Exception, match="no PAF line"):
        alignment_text.read_paf(spark, str(tmp_path / "y")).collect()


def test_names(spark):
    df = spark.createDataFrame([("b x",), ("a",), ("c\ty",)], "n string")
    assert sorted(map(tuple, records.numbered_names(df, "n").collect())) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError, match="twice"):
        records.numbered_names(df.union(spark.createDataFrame([("a z",)], "n string")), "n")
    with pytest.raises(ValueError, match="unknown"):
        records.with_ids(df, records.numbered_names(df.limit(1), "n"), "n", "id")


def test_tables_of_a_genome(spark):
    base = fresh_path(spark, "set")
    rows = spark.createDataFrame([(0, "s", 9, "acgtNNacg")], "scaf long, name string, slen long, seq string")
    path = base + paths.TABLES["genome"]
    tables.write_genome(rows, path, source="here.fa")
    assert [x["sources"] for x in tables.about(spark, path)] == [["here.fa"]]
    tables.replace_source(spark, path, "here.fa", "there.fa")
    assert [x["sources"] for x in tables.about(spark, path)] == [["there.fa"]]
    assert paths.find(spark, base) == path and paths.root(path) == base
    spark.range(3).write.parquet(base + paths.TABLES["index"])
    with pytest.raises(FileExistsError):
        paths.copy(spark, base + "", base)
    assert len(paths.move(spark, base, base + "-moved")) == 2 and not paths.exists(spark, path)
    assert tables.read_genome(spark, base + "-moved" + paths.TABLES["genome"])[1].count() == 2
    assert len(paths.remove(spark, base + "-moved")) == 2 and paths.remove(spark, base, missing_ok=True) == []
    with pytest.raises(FileNotFoundError):
        paths.remove(spark, base)
    with pytest.raises(ValueError):
        tables.checked(rows, "scaf long, other string")
    assert paths.target("d/x.fa.gz", None, ".made") == "d/x.made" and paths.target("d/x.fa", "out/", ".made") == "out/x.made"
    calls = []
    for _ in range(2):
        assert paths.made(spark, base + "-made", lambda: calls.append(1) or spark.range(2), keep=False).count() == 2
    assert calls == [1]


def test_skeletons_differ(spark):
    a = (spark.createDataFrame([(0, "s", 9), (1, "t", 4)], "scaf long, name string, slen long"), spark.createDataFrame([(0, 0, 4), (1, 0, 4)], "scaf long, sbeg long, clen long"))
    b = (a[0], spark.createDataFrame([(0, 0, 4), (1, 0, 3)], "scaf long, sbeg long, clen long"))
    assert tables.same_genome(a, b) is None and sorted(map(tuple, tables.same_genome(a, a).collect())) == [(0, 0), (1, 1)]


def test_masked_and_short_kmers(spark):
    rng = random.Random(2)
    for n in (11, 12, 39, 40, 41, 300):
        seq = "".join(rng.choice("acgt") for _ in range(n))
        rows = kmers.index(spark.createDataFrame([(1, seq)], "ctg long, seq string"), "ctg").select("pos", "neg", kmers.spelled(kmers.F.col("k1"), kmers.F.col("k2")).alias("k")).collect()
        comp = seq[::-1].translate(str.maketrans("acgt", "tgca"))
        for r in rows:
            assert r.k == (comp[n - r.pos : n - r.pos + 40] if r.neg else seq[r.pos : r.pos + 40])
        assert bool(rows) <= (n >= 40)
    for wrong in (10, 42, 44):
        with pytest.raises(ValueError):
            kmers.check_k(wrong)


def test_nice_numbers():
    assert [stats.nice_step(x, 20) for x in (5, 20, 39, 40, 100, 1000, 12_345)] == [1, 1, 1, 2, 5, 50, 500]
    assert stats.log_steps(3, 60) == [2, 5, 10, 20, 50]
    assert [ordered.nice_cut(x) for x in (0, 7, 99, 123, 119, 1999)] == [0, 7, 90, 120, 110, 1900]


def test_alignment_objects(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("acgt") for _ in range(400))
    a = spark.createDataFrame([(0, "ac" * 20 + core)], "ctg long, seq string")
    b = spark.createDataFrame([(0, core[:200] + "t" + core[200:])], "ctg long, seq string")
    diffs, points = cigar.trace([(200, "="), (1, "D"), (200, "=")], 40)
    rows = spark.createDataFrame([(0, 0, False, 40, 440, 0, 401, 1, diffs, points)], "actg long, bctg long, comp boolean, abpos long, aepos long, bbpos long, bepos long, diffs long, tdiffs array<long>, tpoints array<long>")
    own = Alignments(rows, a, b)
    assert own.counters()["alignments"] == 1 and own.record(0)["aepos"] == 440
    with pytest.raises(IndexError):
        own.record(1)
    exact = own.exact().first()
    assert exact.diffs == 1 and cigar.spans(cigar.parse(exact.cigar)) == (400, 401)
    assert own.difference_strings().first().cs.count("-") == 1 and len(own.indels().first().marks) == 1
    assert "|" in own.show() and "%" in own.show(width=50)
    path = fresh_path(spark, "aln")
    own.write(path)
    assert Alignments.open(spark, path, a, b).counters() == own.counters()
    assert own.between(selection.selected(spark, [(0, 0, 0, 41, 0)])).rows.count() == 1 and own.between(selection.selected(spark, [(0, 0, 0, 40, 0)])).rows.count() == 0


def test_genome_objects(spark):
    scaffolds = spark.createDataFrame([(0, "s", 12)], "scaf long, name string, slen long")
    g = Genome(scaffolds, sequences.contigs(spark.createDataFrame([(0, "acgtNNacgtac")], "scaf long, seq string")))
    assert g.counters() == {"scaffolds": 1, "contigs": 2, "max_contigs": 2, "gaps": 1, "max_gaps": 1}
    assert g.sequence(0, 7, 10) == "cgt" and g.name(0) == "s" and g.gaps().count() == 1
    for beg, end in ((3, 7), (10, 13), (4, 3)):
        with pytest.raises(ValueError):
            g.sequence(0, beg, end)
    assert [(r.ctg, r.beg, r.end) for r in g.selection("s:2-8").orderBy("ctg").collect()] == [(0, 2, 4), (1, 0, 2)]


def test_displays(spark):
    text = display.alignment_text([(3, "="), (1, "X"), (1, "I"), (2, "=")], "acgtaac", "acgcac", 10, 20, width=5)
    assert text.split("\n")[:3] == ["    10 acgta", "       |||*-  40.0%", "    20 acgc-"]
    row = spark.createDataFrame([(0, 0, 0, 1500, 1500, 1, 2, 900, 100, 2000, True, False, 30, [1, 2])], "ascaf int, actg int, abeg long, aend long, aslen long, bscaf int, bctg int, bbeg long, bend long, bslen long, comp boolean, reverse boolean, diffs long, tpoints array<int>")
    assert display.alignment_line(row).first().line == "1.1n  2.3c   <0..1,500> x [900..100]  2.61%  (30 diffs, 2 trace pts)"
    note = spark.createDataFrame([(5, 9, True, False, 0, "x", 3, 100)], "`from` long, `to` long, open_left boolean, open_right boolean, orient int, label string, score int, off long")
    assert display.annotation_line(note).first().line == "<       105 -        109] x score = 3"
    segments = spark.createDataFrame([(0, 0, 500, 0, 500, 0, 480, 500), (0, 0, 50, 0, 0, 50, 50, 50)], "ascaf int, abpos long, aepos long, bscaf int, bbpos long, bepos long, matches long, block long")
    assert display.dot_plot(segments, [("a<b", 600)], [("b", 600)]).count("#d8331f") == 1
    contigs = spark.createDataFrame([(0, "aacc")], "ctg long, seq string")
    assert display.sequences_of(selection.selected(spark, [(0, 0, 1, 4, -1)]), contigs).first().seq == "ggt"


def test_alignments_of_planted_seeds(spark):
    from strandlake.operators import chains, seeds

    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    core = letters(900)
    edited = "".join(c if rng.random() > 0.04 else rng.choice("acgt") for c in core)
    turned = edited[::-1].translate(str.maketrans("acgt", "tgca"))
    a = spark.createDataFrame([(0, letters(300) + core + letters(200))], "ctg long, seq string")
    b = spark.createDataFrame([(0, letters(150) + edited + letters(100)), (1, letters(80) + turned + letters(70)), (2, letters(900))], "ctg long, seq string")
    found = chains.chains(chains.diagonals(seeds.adaptive_seeds(kmers.index(a, "ctg"), kmers.index(b, "ctg")), 1400, 1150))
    got = align.align_chains(found, a, b, 1400, 1150).collect()
    assert sorted((r.bctg, r.comp) for r in got) == [(0, False), (1, True)]
    seqs = {r.ctg: r.seq for r in b.collect()}
    for r in got:
        other = seqs[r.bctg][::-1].translate(str.maketrans("acgt", "tgca")) if r.comp else seqs[r.bctg]
        x, y = a.first().seq[r.abpos : r.aepos], other[r.bbpos : r.bepos]
        assert abs(r.abpos - 300) < 30 and abs(r.aepos - 1200) < 30
        assert cigar.text(cigar.compared(cigar.matches_as_m(cigar.parse(r.cigar)), x, y)) == r.cigar and sum(r.tpoints) == len(y)


def test_typed_line_files(spark, tmp_path):
    from strandlake.sources import typed_lines as one

    rows = spark.createDataFrame([("a b", "ACgtNNxACG"), ("c", ""), ("", "NNac")], "name string, seq string")
    path = fresh_path(spark, "one")
    one.write_sequences(rows, path)
    assert sorted(map(tuple, one.read_sequences(spark, path).collect())) == [("", "NNac"), ("a b", "ACgtNNxACG"), ("c", "")]
    (tmp_path / "plain").write_text("1 3 seq 2 1\n# S 2\nS 4 acgt\nI 3 one\nS 2 tt\nM 2 0 1\n")
    assert [tuple(r) for r in one.read_sequences(spark, str(tmp_path / "plain")).collect()] == [("one", "acgt"), ("2", "tT")]
    for n, text in enumerate(("1 3 gdb 2 1\n", "1 3 seq 2 1\nS 1 a\ns 3 1 x\n", "1 3 seq 2 1\nB 1\n")):
        (tmp_path / f"bad{n}").write_text(text)
        with pytest.raises(Exception, match="no seq file|one file|no lines"):
            one.read_sequences(spark, str(tmp_path / f"bad{n}")).collect()
    (tmp_path / "aln").write_text("1 3 aln 2 1\nA 0 0 5 0 0 5\n")
    with pytest.raises(Exception, match="no trace point spacing"):
        one.read_alignments(spark, str(tmp_path / "aln")).collect()


def test_typed_line_files_are_bounded(spark):
    from strandlake.sources import typed_lines as one

    rows = spark.range(0, 40, 1, 1).selectExpr("concat('s', id) as name", "concat(repeat('acgt', 250000), 'N', repeat('Ac', id)) as seq")
    path = fresh_path(spark, "one")
    one.write_sequences(rows, path)
    sizes = [r.n for r in spark.read.text(path, wholetext=True).selectExpr("length(value) as n").collect()]
    assert len(sizes) > 1 and max(sizes) < one.FILE + 2_000_000
    assert one.read_sequences(spark, path).exceptAll(rows).isEmpty() and one.read_sequences(spark, path).count() == 40


def test_masks_in_any_order(spark, tmp_path):
    from strandlake.sources import typed_lines as one

    (tmp_path / "x").write_text("1 3 seq 2 1\nS 8 acgtacgt\nM 4 5 6 1 3\nS 2 ac\nI 1 y\nM 0\nS 1 g")
    assert [tuple(r) for r in one.read_sequences(spark, str(tmp_path / "x")).collect()] == [("1", "AcgTAcGT"), ("y", "AC"), ("3", "g")]


def test_python_gets_a_few_megabytes_at_a_time(spark, tmp_path):
    from strandlake.plans.registry import BATCH_BYTES, table

    spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 20000) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    assert max(r.n for r in table(spark, str(tmp_path), "documents").mapInArrow(run, "n long").collect()) < 2 * BATCH_BYTES
