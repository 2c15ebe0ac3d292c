"""Sequence expressions: k-mers, reverse complement, translation, base counts.

All of them are JVM-side column expressions.  K-mers are cut with a look-ahead
regular expression because ``substr`` walks a string from its start: one call
per position would be quadratic in the sequence length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Long sequences are cut into overlapping pieces of this many start positions, so that
# no row ever holds the k-mer array of a whole chromosome.
PIECE = 4096

# The standard genetic code, codons in TCAG order.
CODON_BASES = "TCAG"
CODON_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    """Codon to amino acid, '*' for stop."""
    codons = (a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES)
    return dict(zip(codons, CODON_AMINO_ACIDS))


def kmer_array(seq: Column, k: int) -> Column:
    """Every k-mer of one sequence in order, repeats included; empty when shorter than k."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def kmers(df: DataFrame, keys: list[str], k: int, seq: str = "seq", once: bool = False) -> DataFrame:
    """One row per k-mer occurrence: the key columns and ``kmer``.

    With ``once`` a k-mer that repeats within a piece of a sequence is one row: for callers
    that want sets, most repeats end before any join or shuffle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)), F.lit(PIECE))
    pieces = df.select(*keys, F.col(seq).alias("_seq"), F.explode(starts).alias("_at")).select(
        *keys, F.substring(F.col("_seq"), F.col("_at"), F.lit(PIECE + k - 1)).alias("_piece"))
    found = kmer_array(F.col("_piece"), k)
    return pieces.select(*keys, F.explode(F.array_distinct(found) if once else found).alias("kmer"))


def distinct_kmers(df: DataFrame, keys: list[str], k: int, seq: str = "seq") -> DataFrame:
    """The k-mer set of each key."""
    return kmers(df, keys, k, seq, once=True).distinct()


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def translate_codons(seq: Column) -> Column:
    """Amino acids of the reading frame that starts at the first base; X for unknown codons.

    Bases become digits, so a codon is a number that indexes an array: map lookups scan keys.
    """
    by_number = ["X"] * 334
    for codon, amino in codon_table().items():
        by_number[int("".join(str(CODON_BASES.index(base)) for base in codon))] = amino
    digits = F.translate(seq, CODON_BASES + "0123456789", "0123")
    codons = F.regexp_extract_all(digits, F.lit("(?s).{3}"), F.lit(0))
    table = F.array(*[F.lit(a) for a in by_number])
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.get(table, c.try_cast("int")), F.lit("X"))), "")


def count_chars(seq: Column, chars: str) -> Column:
    """How many characters of ``seq`` are one of ``chars``."""
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def portable_hash(x: Column) -> Column:
    """60 bits of the MD5 digest as a BIGINT: the same number in every SQL engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def wrap(text: Column, width: int = 60) -> Column:
    """Break a long line every ``width`` characters."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), "\n")
