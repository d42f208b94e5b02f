"""Functions of columns: CIGAR strings, alignment records, positions as people write them."""
