"""Text formats as tables: FASTA, BED, PAF, PSL and typed line files, read and written by Spark."""
