"""Queries that write text formats and tables to the shared folder and read them again; selections; alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from strandlake.operators import align, alnchain, kmers, selection, sequences
from strandlake.operators import chains as chaining
from strandlake.plans import sequence_queries as sq
from strandlake.plans import trace_queries as tq
from strandlake.plans.interval_queries import _ANNO, _annotations
from strandlake.plans.registry import DNA, GAPPED, query, table
from strandlake.sources import alignment_text, fasta, intervals_text, tables
from strandlake.sources import typed_lines as one
from strandlake.storage import fresh_path, written

_NAMED = f"SELECT 'doc' || doc_id AS name, {GAPPED} AS seq FROM documents"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq._scaffolds(spark, sf_dir).select("scaf", F.concat(F.lit("doc"), "scaf").alias("name"), F.length("seq").cast("long").alias("slen"), "seq")


@query(_NAMED)
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "fasta")
    fasta.write(_named(spark, sf_dir), path)
    return fasta.read(spark, path)


@query(_NAMED)
def fasta_gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "fasta-gz")
    fasta.write(_named(spark, sf_dir), path, 60, "gzip")
    return fasta.read(spark, path)


@query(_NAMED)
def fasta_of_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _named(spark, sf_dir)
    return fasta.assembled(own.select("scaf", "name", "slen"), sequences.contigs(own.select("scaf", "seq")))


@query(f"SELECT row_number() OVER (ORDER BY name) - 1 AS scaf, name, length(seq) AS slen FROM ({_NAMED})")
def scaffold_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.with_numbers(_named(spark, sf_dir).select("name", "seq")).select("scaf", "name", "slen")


@query(f"WITH {sq._PARTS} SELECT scaf, ctg, sbeg, clen, seq FROM c")
def genome_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "genome")
    tables.write_genome(_named(spark, sf_dir), path)
    return tables.read_genome(spark, path)[1]


@query("SELECT doc_id AS scaf, 1000000 - doc_id AS other FROM documents")
def same_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "genome")
    tables.write_genome(_named(spark, sf_dir), path)
    scaffolds, contigs = tables.read_genome(spark, path)
    turned = lambda df: df.withColumn("scaf", F.lit(1_000_000) - F.col("scaf"))
    return tables.same_genome((scaffolds, contigs), (turned(scaffolds), turned(contigs)))


@query(f"WITH {sq._DOCS} SELECT ctg, pos, neg, kmer FROM b WHERE substr(kmer, 1, 6) = 'gattac'")
def stored_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = kmers.stored(sq._index(spark, sf_dir, "documents", "doc_id"), fresh_path(spark, "index"))
    return kmers.prefix_range(own, "gattac").select("ctg", "pos", "neg", kmers.spelled(F.col("k1"), F.col("k2")).alias("kmer"))


@query(f"""{_ANNO} SELECT user_id AS scaf, beg, "end", orient::INT AS orient, score::INT AS score, label FROM e""")
def bed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _annotations(spark, sf_dir)
    rows = rows.withColumnRenamed("user_id", "scaf")
    scaffolds = rows.groupBy("scaf").agg(F.max("end").alias("slen")).select("scaf", F.concat(F.lit("user"), "scaf", F.lit(" of the table")).alias("name"), "slen")
    path = fresh_path(spark, "bed")
    intervals_text.write_bed(rows, scaffolds, path)
    return intervals_text.read_bed(spark, path, scaffolds).select("scaf", "beg", "end", "orient", "score", "label")


@query(f'WITH {sq._PARTS} SELECT scaf, ctg, clen // 4 AS beg, clen AS "end", sbeg + clen // 4 AS back FROM c')
def annotations_on_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, contigs = sq._contigs(spark, sf_dir)
    contigs = written(contigs.drop("seq"), "contigs")
    rows = contigs.select("scaf", (F.col("sbeg") + F.expr("clen div 4")).alias("beg"), (F.col("sbeg") + F.col("clen")).alias("end"))
    own = written(intervals_text.on_contigs(rows, contigs), "on-contigs")
    back = intervals_text.on_scaffolds(own.select("scaf", "ctg", "beg", "end", F.col("ctg").alias("of")), contigs)
    return own.join(back.select("scaf", F.col("of").alias("ctg"), F.col("beg").alias("back")).hint("merge"), ["scaf", "ctg"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments of documents as PAF has them: B forward, so that a complement's positions count from its end."""
    r = tq._records(spark, sf_dir).where("la > 0")
    name = lambda p: F.concat(F.lit(p), "doc_id")
    comp = F.col("comp")
    return r.select("doc_id", name("q").alias("qname"), F.col("alen").alias("qlen"), F.col("abpos").alias("qs"), F.col("aepos").alias("qe"), "comp", name("t").alias("tname"), F.col("blen").alias("tlen"), F.when(comp, F.col("blen") - F.col("bepos")).otherwise(F.col("bbpos")).alias("ts"), F.when(comp, F.col("blen") - F.col("bbpos")).otherwise(F.col("bepos")).alias("te"), "diffs", "dels", "cigar", "same")


_PAF_SQL = f"""WITH {tq._OPS}, v AS (SELECT doc_id, string_agg(n || op, '' ORDER BY CASE WHEN doc_id % 2 = 1 THEN -i ELSE i END) AS cg FROM o GROUP BY doc_id)
    SELECT 'q' || doc_id AS qname, alen AS qlen, abpos AS qs, aepos AS qe, CASE WHEN comp THEN '-' ELSE '+' END AS strand, 't' || doc_id AS tname, blen AS tlen, CASE WHEN comp THEN blen - bepos ELSE bbpos END AS ts, CASE WHEN comp THEN blen - bbpos ELSE bepos END AS te,
    {{matches}} AS matches, {{block}} AS block, 255::BIGINT AS mapq, '0.' || lpad((10000 * (la - {{matches}}) // la)::VARCHAR, 4, '0') AS dv, diffs::VARCHAR AS df, {{cg}} AS cg FROM r JOIN v USING (doc_id) WHERE la > 0"""


@query(_PAF_SQL.format(matches="(la + dels - diffs)", block="(la + dels)", cg="cg"))
def paf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "paf")
    alignment_text.write_paf(_lines(spark, sf_dir), path, True)
    return alignment_text.read_paf(spark, path, exact=True).drop("cs")


@query(_PAF_SQL.format(matches="((la + lb - diffs) // 2)", block="((la + lb) // 2)", cg="NULL::VARCHAR"))
def paf_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "paf-gz")
    alignment_text.write_paf(_lines(spark, sf_dir), path, False, "gzip")
    return alignment_text.read_paf(spark, path).drop("cs")


@query(f"""WITH {tq._PIECES} SELECT x.doc_id AS ascaf, x.doc_id AS bscaf, comp, abpos + a AS abpos, bbpos + b AS bbpos FROM x JOIN r USING (doc_id) WHERE la > 0""")
def paf_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "paf")
    lines = _lines(spark, sf_dir)
    alignment_text.write_paf(lines, path, True)
    names = lambda c: lines.select(F.col("doc_id").alias("scaf"), F.col(c).alias("name"))
    out = alignment_text.to_alignments(alignment_text.read_paf(spark, path, exact=True), names("qname"), names("tname"), 6)
    return out.select("ascaf", "bscaf", "comp", "abpos", "bbpos")


@query(f"""WITH {tq._PSL} SELECT 'q' || doc_id AS qname, same AS matches, aepos - qt - abpos - qbaseinsert - same AS mismatches, qnuminsert, qbaseinsert, tnuminsert, tbaseinsert, CASE WHEN comp THEN '-' ELSE '+' END AS strand, alen AS qsize, blen AS tsize, length(blocks) - length(replace(blocks, ',', '')) + 1 AS blockcount, blocks || ',' AS blocks
    FROM r JOIN x USING (doc_id) JOIN y USING (doc_id) JOIN z USING (doc_id) WHERE la > 0""")
def psl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "psl")
    alignment_text.write_psl(alignment_text.to_psl(_lines(spark, sf_dir).withColumnRenamed("same", "matches")), path)
    return alignment_text.read_psl(spark, path).select("qname", "matches", "mismatches", "qnuminsert", "qbaseinsert", "tnuminsert", "tbaseinsert", "strand", "qsize", "tsize", "blockcount", "blocks")


@query(f"""WITH {tq._PSL} SELECT 'q' || doc_id AS qname, qnuminsert, tnuminsert, blocks || ',' AS blocks FROM r JOIN x USING (doc_id) JOIN y USING (doc_id) WHERE la > 0""")
def paf_to_psl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "paf")
    alignment_text.write_paf(_lines(spark, sf_dir), path, True)
    return alignment_text.paf_to_psl(alignment_text.read_paf(spark, path)).select("qname", "qnuminsert", "tnuminsert", "blocks")


_ITEMS = f"SELECT item_id, row_number() OVER (ORDER BY item_id) AS k, length({DNA}) AS n FROM benchmark"
_PARTS_OF_ITEMS = f"""i AS ({_ITEMS}), p AS (SELECT 0 AS ord, k - 1 AS ctg, 0 AS beg, n AS "end", 0 AS orient FROM i WHERE k = 3 UNION ALL SELECT 1, k - 1, CASE WHEN k = 5 THEN 10 ELSE 0 END, CASE WHEN k = 7 THEN 20 ELSE n END, -1 FROM i WHERE k BETWEEN 5 AND 7 UNION ALL SELECT 2, k - 1, 0, n, 1 FROM i WHERE k = (SELECT max(k) FROM i)),
    parts AS (SELECT ord::INT AS ord, ctg::BIGINT AS ctg, beg::BIGINT AS beg, "end"::BIGINT AS "end", orient::INT AS orient FROM p)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("scaf"), F.concat(F.lit("item"), "item_id").alias("name"), F.length(sequences.dna(F.col("text"))).cast("long").alias("slen"))
    contigs = items.select("scaf", F.lit(0).alias("ctg"), F.lit(0).cast("long").alias("sbeg"), F.col("slen").alias("clen"))
    genome = selection.Genome.of_tables(items, contigs)
    return selection.selected(spark, selection.on_contigs(genome, selection.parse(genome, "3 5:10-7:20- #+")))


@query(f"WITH {_PARTS_OF_ITEMS} SELECT * FROM parts")
def selected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


_ALNS = "SELECT l_partkey % 40 AS actg, l_suppkey % 60 AS abpos, l_suppkey % 60 + l_linenumber * 9 AS aepos, l_partkey % 37 AS bctg, l_orderkey % 50 AS bbpos, l_orderkey % 50 + l_linenumber * 9 AS bepos, l_orderkey % 2 = 1 AS comp, l_orderkey, l_linenumber FROM lineitem"


def _alns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 40 as actg", "l_suppkey % 60 as abpos", "l_suppkey % 60 + l_linenumber * 9 as aepos", "l_partkey % 37 as bctg", "l_orderkey % 50 as bbpos", "l_orderkey % 50 + l_linenumber * 9 as bepos", "l_orderkey % 2 = 1 as comp", "l_orderkey", "l_linenumber")


@query(f"""WITH {_PARTS_OF_ITEMS}, x AS ({_ALNS}) SELECT l_orderkey, l_linenumber FROM x WHERE EXISTS (SELECT 1 FROM parts a, parts b WHERE a.ctg = actg AND abpos < a."end" AND a.beg < aepos AND b.ctg = bctg AND bbpos < b."end" AND b.beg < bepos AND (a.orient * b.orient = 0 OR (a.orient * b.orient < 0) = comp))""")
def selected_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return selection.alignments_in(_alns(spark, sf_dir), parts, parts).select("l_orderkey", "l_linenumber")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (sq.dna(spark, sf_dir, n, k, "ctg") for n, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    most = lambda df: df.agg(F.max(F.length("seq"))).first()[0] or 0
    amax, bmax = most(a), most(b)
    found = chaining.chains(written(chaining.diagonals(sq._seeds(spark, sf_dir), amax, bmax), "seeds"))
    return align.align_chains(found, a, b, amax, bmax)


@query()
def local_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of benchmark items with documents; tests hold them against planted similarities and the sequences."""
    return _aligned(spark, sf_dir).select("actg", "bctg", "comp", "abpos", "aepos", "bbpos", "bepos", "diffs", "cigar")


@query()
def exact_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (sq.dna(spark, sf_dir, n, k, "ctg") for n, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    return align.with_exact_cigar(_aligned(spark, sf_dir), a, b).select("actg", "bctg", "comp", "abpos", "aepos", "bbpos", "bepos", "diffs", "cigar")


@query()
def alignment_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over order lines as alignments of parts and suppliers; the search of predecessors has a brute-force test."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber as aln", "l_partkey % 20 as ascaf", "l_suppkey % 20 as bscaf", "l_linenumber % 2 = 0 as comp", "l_orderkey * 3 % 400000 as abpos", "l_orderkey * 3 % 400000 + 300 + l_partkey % 500 as aepos", "l_orderkey * 3 % 390000 as bbpos", "l_orderkey * 3 % 390000 + 300 + l_partkey % 480 as bepos", "500000 as blen")
    return alnchain.chain(rows, alnchain.Params(score=2000)).select("ascaf", "bscaf", "comp", "chain_id", "fragment", "agap", "bgap", "aln")


@query("SELECT 'object' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem")
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stats(tables.checked(table(spark, sf_dir, "lineitem"), "l_orderkey long, l_linenumber int"), ["l_partkey", "l_suppkey"])


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS line FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20""")
def table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.view(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 20, 50, ["c_custkey"])


@query(f"SELECT 'doc' || doc_id AS name, translate(lower({GAPPED}), 'n', 'N') AS seq FROM documents")
def line_sequences_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "one-seq")
    one.write_sequences(_named(spark, sf_dir).select("name", F.translate(F.lower("seq"), "n", "N").alias("seq")), path)
    return one.read_sequences(spark, path)


@query(f"WITH {sq._PARTS} SELECT 'doc' || scaf AS name, sbeg, clen, slen FROM c JOIN l USING (scaf)")
def line_skeleton_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "one-gdb")
    own = _named(spark, sf_dir)
    one.write_skeleton(own.select("scaf", "name", "slen"), sequences.contigs(own.select("scaf", "seq")).select("scaf", "sbeg", "clen"), path)
    return one.read_skeleton(spark, path).select("name", "slen", F.explode("contigs").alias("c")).select("name", "c.sbeg", "c.clen", "slen")


@query(f"""{_ANNO} SELECT user_id AS scaf, beg, "end", orient::INT AS orient, score::INT AS score, label FROM e""")
def line_annotations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "one-ano")
    rows, _ = _annotations(spark, sf_dir)
    one.write_annotations(rows.select(F.col("user_id").alias("scaf"), "beg", "end", "orient", "score", "label", F.array(F.col("beg") + 1).alias("parse")), path)
    return one.read_annotations(spark, path).where("parse[0] = beg + 1").drop("parse")


@query(f"WITH {tq._TRACE}, s AS (SELECT doc_id, string_agg(t::VARCHAR, ',' ORDER BY panel) AS points, string_agg(d::VARCHAR, ',' ORDER BY panel) AS each FROM h GROUP BY doc_id) SELECT doc_id AS actg, abpos, aepos, doc_id + 7 AS bctg, bbpos, bepos, comp, diffs, points, each, 100::BIGINT AS spacing FROM r JOIN s USING (doc_id)")
def line_alignments_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "one-aln")
    one.write_alignments(tq._traced(spark, sf_dir).select(F.col("doc_id").alias("actg"), "abpos", "aepos", (F.col("doc_id") + 7).alias("bctg"), "bbpos", "bepos", "comp", "diffs", "tpoints", "tdiffs"), path)
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return one.read_alignments(spark, path).withColumn("points", said("tpoints")).withColumn("each", said("tdiffs")).drop("tpoints", "tdiffs")
