"""PAF and PSL files as tables of alignments, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar, records

PAF = ("qname", "qlen", "qs", "qe", "strand", "tname", "tlen", "ts", "te", "matches", "block", "mapq")
_NUMBERS = ("qlen", "qs", "qe", "tlen", "ts", "te", "matches", "block", "mapq")
PSL = (
    "matches", "mismatches", "repmatches", "ncount", "qnuminsert", "qbaseinsert", "tnuminsert", "tbaseinsert", "strand", "qname", "qsize", "qstart", "qend",
    "tname", "tsize", "tstart", "tend", "blockcount", "blocks", "qstarts", "tstarts",
)


def read_paf(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """The twelve columns of PAF lines and the tags dv, df, cg and cs, as text (null: not there); gzip files too.

    exact: each line must hold a cg tag of = X I D that spans its intervals, else it is an error that names the line; so is a line of fewer than eleven fields.
    """
    f = F.split("value", r"\t")
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", f.alias("f"))
    rows = rows.withColumn("f", F.when(F.size("f") >= 11, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("no PAF line: "), F.col("value")))))
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    cols = [F.expr(f"get(f, {i})").cast("long" if c in _NUMBERS else "string").alias(c) for i, c in enumerate(PAF)]
    out = rows.select("value", *cols, *[tag(t).alias(t) for t in ("dv", "df", "cg", "cs")])
    if exact:
        good = F.coalesce(cigar.valid(F.col("cg"), F.col("qe") - F.col("qs"), F.col("te") - F.col("ts")) & ~F.contains("cg", F.lit("M")), F.lit(False))
        out = out.withColumn("cg", F.when(good, F.col("cg")).otherwise(F.raise_error(F.concat(F.lit("no exact alignment: "), F.col("value")))))
    return out.drop("value")


def paf_line(rows: DataFrame, tags: bool = True, with_cigar: bool = False) -> Column:
    """The line of a row (qname, qlen, qs, qe, comp, tname, tlen, ts, te, diffs, dels, cigar): with the CIGAR counts are exact, without they are estimates."""
    la, lb, diffs = F.col("qe") - F.col("qs"), F.col("te") - F.col("ts"), F.col("diffs")
    matches, block = records.identity_exact(diffs, la, F.col("dels")) if with_cigar else records.identity_estimate(diffs, la, lb)
    fields = ["qname", "qlen", "qs", "qe", F.when(F.col("comp"), "-").otherwise("+"), "tname", "tlen", "ts", "te", matches, block, F.lit(255)]
    extra = [records.divergence_tag(la, matches), F.concat(F.lit("df:i:"), diffs.cast("string"))] if tags else []
    own = F.when(F.col("comp"), cigar.turned(F.col("cigar"))).otherwise(F.col("cigar")) if with_cigar else None
    extra += [F.concat(F.lit("cg:Z:"), own)] if with_cigar else []
    return F.concat_ws("\t", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in fields], *extra)


def write_paf(rows: DataFrame, path: str, with_cigar: bool = False, compression: str | None = None) -> None:
    rows.select(paf_line(rows, True, with_cigar).alias("value")).write.option("compression", compression or "none").text(path)


def to_psl(rows: DataFrame) -> DataFrame:
    """The 21 columns of PSL of rows (qname, qlen, qs, qe, comp, tname, tlen, ts, te, matches, cigar); lists end in a comma, as the format wants."""
    one = cigar.column(lambda c, qs, qe, size, ts, te, comp, same: cigar.psl(cigar.parse(c), int(qs), int(qe), int(size), int(ts), int(te), bool(comp), int(same)), cigar.PSL_TYPE, *[F.col(c) for c in ("cigar", "qs", "qe", "qlen", "ts", "te", "comp", "matches")])
    said = lambda c: F.concat(F.array_join(F.transform(f"x.{c}", lambda v: v.cast("string")), ","), F.lit(",")).alias(c)
    x = rows.select("*", one.alias("x"))
    made = {"repmatches": F.lit(0).cast("long"), "ncount": F.aggregate("x.blocks", F.lit(0).cast("long"), lambda s, v: s + v) - F.col("x.matches") - F.col("x.mismatches"), "strand": F.when(F.col("comp"), "-").otherwise("+"), "qname": F.col("qname"), "qsize": F.col("qlen"), "tname": F.col("tname"), "tsize": F.col("tlen"), "blockcount": F.size("x.blocks").cast("long")}
    return x.select(*[said(c) if c in ("blocks", "qstarts", "tstarts") else (made[c] if c in made else F.col(f"x.{c}")).alias(c) for c in PSL])


def paf_to_psl(rows: DataFrame, tag: str = "cg") -> DataFrame:
    """PSL columns of PAF rows whose CIGAR is in the column `tag`; M counts as aligned, matches are the PAF line's."""
    turned = F.when(F.col("strand") == "-", cigar.turned(F.col(tag))).otherwise(F.col(tag))
    return to_psl(rows.select("qname", "qlen", "qs", "qe", (F.col("strand") == "-").alias("comp"), "tname", "tlen", "ts", "te", "matches", turned.alias("cigar")))


def write_psl(psl: DataFrame, path: str) -> None:
    psl.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in PSL]).alias("value")).write.text(path)


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """The 21 columns of PSL lines; a header, if there is one, is passed over."""
    text = ("strand", "qname", "tname", "blocks", "qstarts", "tstarts")
    f = F.split("value", r"\t")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d")).select(f.alias("f"))
    return rows.select(*[F.expr(f"get(f, {i})").cast("string" if c in text else "long").alias(c) for i, c in enumerate(PSL)])


def to_alignments(paf: DataFrame, queries: DataFrame, targets: DataFrame, most_gap: int = cigar.LONG_GAP) -> DataFrame:
    """(ascaf, bscaf, comp, group, piece, abpos, aepos, bbpos, bepos, diffs, tdiffs, tpoints, agap, bgap) of exact PAF rows over scaffolds (scaf, name).

    A line becomes as many alignments as insertions or deletions longer than most_gap cut it into; group numbers its line by its content, agap and bgap are the gaps behind a piece. B positions of a complement count along it.
    """
    named = records.with_ids(records.with_ids(paf, queries.select(records.short_name(F.col("name")).alias("name"), F.col("scaf").alias("id")), "qname", "ascaf"), targets.select(records.short_name(F.col("name")).alias("name"), F.col("scaf").alias("id")), "tname", "bscaf")
    comp = F.col("strand") == "-"
    rows = named.select("ascaf", "bscaf", comp.alias("comp"), F.xxhash64(*paf.columns).alias("group"), "qs", F.when(comp, F.col("tlen") - F.col("te")).otherwise(F.col("ts")).alias("b0"), F.when(comp, cigar.turned(F.col("cg"))).otherwise(F.col("cg")).alias("cigar"))

    def make(text: str, a: int, b: int) -> list[dict]:
        out = []
        for n, (x, y, ops, agap, bgap) in enumerate(cigar.pieces(cigar.parse(text), int(a), int(b), most_gap)):
            la, lb = cigar.spans(ops)
            diffs, points = cigar.trace(ops, x)
            out.append({"piece": n, "abpos": x, "aepos": x + la, "bbpos": y, "bepos": y + lb, "diffs": sum(diffs), "tdiffs": diffs, "tpoints": points, "agap": agap, "bgap": bgap})
        return out

    kind = "array<struct<piece: int, abpos: long, aepos: long, bbpos: long, bepos: long, diffs: long, tdiffs: array<long>, tpoints: array<long>, agap: long, bgap: long>>"
    return rows.select("ascaf", "bscaf", "comp", "group", F.explode(cigar.column(make, kind, F.col("cigar"), F.col("qs"), F.col("b0"))).alias("x")).select("ascaf", "bscaf", "comp", "group", "x.*")
