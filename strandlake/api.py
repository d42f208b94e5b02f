"""A genome and its alignments as one object: counts, sequences, records and their exact forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import cigar, display
from strandlake.operators import align, ordered, selection, sequences, stats
from strandlake.sources import tables


class Genome:
    """Scaffolds (scaf, name, slen) and contigs (scaf, ctg, sbeg, clen, seq) as tables."""

    def __init__(self, scaffolds: DataFrame, contigs: DataFrame):
        self.scaffolds, self.contigs = scaffolds, contigs

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Genome:
        return cls(*tables.read_genome(spark, path))

    def counters(self) -> dict[str, int]:
        """How many scaffolds, contigs and gaps there are, and the most of them in a scaffold."""
        return stats.genome_counters(self.scaffolds, self.contigs).first().asDict()

    def gaps(self) -> DataFrame:
        return stats.gaps(self.scaffolds, self.contigs)

    def name(self, scaf: int) -> str:
        row = self.scaffolds.where(F.col("scaf") == scaf).first()
        if row is None:
            raise IndexError(f"there is no scaffold {scaf}")
        return row["name"]

    def sequence(self, scaf: int, beg: int, end: int) -> str:
        """The bases from beg to end of a scaffold; an error if any of them lies in a gap or beyond an end."""
        if not 0 <= beg <= end:
            raise ValueError(f"{beg} to {end} is no interval")
        inside = (F.col("scaf") == scaf) & (F.col("sbeg") <= beg) & (F.col("sbeg") + F.col("clen") >= end)
        row = self.contigs.where(inside).select(sequences.piece(F.col("seq"), F.lit(beg) - F.col("sbeg"), F.lit(end) - F.col("sbeg")).alias("s")).first()
        if row is None:
            raise ValueError(f"{beg} to {end} of scaffold {scaf} meets a gap or an end")
        return row["s"]

    def selection(self, text: str) -> DataFrame:
        """(ord, ctg, beg, end, orient) of a selection; ctg counts over the whole genome."""
        genome = selection.Genome.of_tables(self.scaffolds, self.contigs)
        return selection.selected(self.scaffolds.sparkSession, selection.on_contigs(genome, selection.parse(genome, text)))


class Alignments:
    """Alignments (actg, bctg, comp, abpos, aepos, bbpos, bepos, diffs, tdiffs, tpoints) of contigs a and b (ctg, seq), in the order (actg, abpos, bctg, comp, bbpos)."""

    ORDER = ("actg", "abpos", "bctg", "comp", "bbpos", "aepos", "bepos")

    def __init__(self, rows: DataFrame, a: DataFrame, b: DataFrame | None = None):
        self.rows, self.a, self.b = rows, a, a if b is None else b

    @classmethod
    def open(cls, spark: SparkSession, path: str, a: DataFrame, b: DataFrame | None = None) -> Alignments:
        return cls(spark.read.parquet(path), a, b)

    def write(self, path: str) -> None:
        """Write the rows in their order, a range of it a file."""
        self.rows.repartitionByRange(*self.ORDER).sortWithinPartitions(*self.ORDER).write.parquet(path)

    def counters(self) -> dict[str, int]:
        return stats.alignment_totals(self.rows).first().asDict()

    def goto(self, row: int) -> DataFrame:
        """The rows from number `row` (from 0) on."""
        if row < 0:
            raise IndexError(row)
        return ordered.numbered(self.rows, list(self.ORDER), "row").where(F.col("row") >= row)

    def record(self, row: int) -> dict:
        found = self.goto(row).where(F.col("row") == row).first()
        if found is None:
            raise IndexError(f"there are no {row + 1} alignments")
        return found.asDict()

    def between(self, first: DataFrame, second: DataFrame | None = None) -> Alignments:
        """Those that meet selected parts of a and, if given, of b."""
        return Alignments(selection.alignments_in(self.rows, first, second), self.a, self.b)

    def exact(self, improve: bool = True) -> DataFrame:
        """The rows with their exact CIGAR and differences."""
        return align.with_exact_cigar(self._whole(), self.a, self.b, improve)

    def _whole(self) -> DataFrame:
        names = [x.split()[0] for x in align.ALIGNMENT.split(", ")]
        return self.rows.select(*[c if c in self.rows.columns else F.lit(None).cast("string").alias(c) for c in names])

    def with_pieces(self) -> DataFrame:
        """The exact rows with aseq and bseq, the aligned bases of both sides."""
        rows = self.exact().join(self.a.select(F.col("ctg").alias("actg"), F.col("seq").alias("_a")), "actg").join(self.b.select(F.col("ctg").alias("bctg"), F.col("seq").alias("_b")), "bctg")
        other = F.when(F.col("comp"), sequences.reverse_complement(F.col("_b"))).otherwise(F.col("_b"))
        return rows.select("*", sequences.piece(F.col("_a"), F.col("abpos"), F.col("aepos")).alias("aseq"), sequences.piece(other, F.col("bbpos"), F.col("bepos")).alias("bseq")).drop("_a", "_b")

    def difference_strings(self, long: bool = False) -> DataFrame:
        """The exact rows with cs."""
        rows = self.with_pieces()
        return rows.withColumn("cs", cigar.column(lambda c, a, b: cigar.difference_string(cigar.parse(c), a, b, long), "string", F.col("cigar"), F.col("aseq"), F.col("bseq")))

    def indels(self) -> DataFrame:
        """The exact rows with marks, the exact trace."""
        return self.exact().withColumn("marks", cigar.column(lambda c, a, b: cigar.indels(cigar.parse(c), int(a), int(b)), "array<long>", F.col("cigar"), F.col("abpos"), F.col("bbpos")))

    def show(self, most: int = 20, width: int = 100) -> str:
        return "\n".join(display.shown_alignments(self.with_pieces(), width, most))
