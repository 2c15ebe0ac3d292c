"""Genome and gene tables: gene calls, genome statistics, gene headers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.sequence import CODON_BASES, codon_table, count_chars
from cladeflow.params import MIN_PROTEIN_AA


_AMINO = np.full(125, ord("X"), dtype=np.uint8)
_AMINO[[25 * CODON_BASES.index(a) + 5 * CODON_BASES.index(b) + CODON_BASES.index(c) for a, b, c in codon_table()]] = list("".join(codon_table().values()).encode())
_BASE = np.full(256, 4, dtype=np.uint8)
_BASE[list(CODON_BASES.encode())] = range(4)
_OTHER_STRAND = str.maketrans("ACGT", "TGCA")
_PART = 1 << 24           # letters of genes handed on at a time


def _open_frames(text: str, min_aa: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, str]]:
    """Of each frame: the places in its protein of the first methionines, of the stops that end them, and the protein."""
    bases = _BASE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)].astype(np.intp)
    for frame in range(3):
        n = max(0, (len(bases) - frame) // 3)
        first, second, third = (bases[frame + i:frame + 3 * n:3] for i in range(3))
        amino = _AMINO[25 * first + 5 * second + third]
        stops, starts = np.flatnonzero(amino == ord("*")), np.flatnonzero(amino == ord("M"))
        if not len(stops) or not len(starts):
            continue
        begins = np.concatenate(([0], stops[:-1] + 1))
        at = np.searchsorted(starts, begins)
        begins = np.where(at < len(starts), starts[np.minimum(at, len(starts) - 1)], len(amino))
        found = (begins < stops) & (stops - begins >= min_aa)
        yield frame, begins[found], stops[found], amino.tobytes().decode()


def _genes(min_aa: int, texts: bool):
    """Genes of the contigs of each batch, handed on in parts of a bounded number of letters."""
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for strain, contig, seq, size in zip(batch["strain"], batch["contig"], batch["seq"], batch["size"]):
                if not seq:
                    continue
                for strand, text in (("+", seq), ("-", seq[::-1].translate(_OTHER_STRAND))):
                    for frame, begins, stops, protein in _open_frames(text, min_aa):
                        for m, stop in zip(begins.tolist(), stops.tolist()):
                            first, last = frame + 3 * m + 1, frame + 3 * (stop + 1)
                            own = (protein[m:stop], text[first - 1:last]) if texts else ()
                            rows.append((strain, contig, *((first, last) if strand == "+" else (size - last + 1, size - first + 1)),
                                         strand, last - first + 1, stop - m, *own))
                            held += 4 * (stop - m) if texts else 64
                if held > _PART:
                    yield pd.DataFrame(rows, columns=_GENE_COLUMNS if texts else _GENE_COLUMNS[:-2])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_GENE_COLUMNS if texts else _GENE_COLUMNS[:-2])

    return call


_GENE_COLUMNS = ["strain", "contig", "begin", "end", "strand", "length_nt", "length_aa", "protein", "cds"]


def call_orfs(contigs: DataFrame, min_aa: int = MIN_PROTEIN_AA, texts: bool = True) -> DataFrame:
    """Open reading frames of ``contigs(strain, contig, seq)`` on both strands.

    A plain stand-in for a trained gene caller, to be replaced by a table of real calls where
    one exists: every stretch between two stop codons, from its first methionine to the stop,
    of at least ``min_aa`` amino acids.  Coordinates are 1-based on the forward strand and
    include the stop codon.  Without ``texts`` the sequences of the genes are left out, for callers that count them.
    """
    rows = contigs.select("strain", "contig", F.upper("seq").alias("seq"), F.length("seq").cast("bigint").alias("size"))
    kind = [rows.schema[c].dataType.simpleString() for c in ("strain", "contig")]
    schema = f"strain {kind[0]}, contig {kind[1]}, begin bigint, end bigint, strand string, length_nt bigint, length_aa int"
    return rows.mapInPandas(_genes(min_aa, texts), schema + (", protein string, cds string" if texts else ""))


def gene_header(gene_id: str = "gene_id"):
    """``strain|contig|begin-end|strand|gene`` as one column."""
    return F.concat_ws("|", "strain", "contig", F.concat_ws("-", F.col("begin").cast("string"), F.col("end").cast("string")),
                       "strand", gene_id)


def genome_stats(contigs: DataFrame, genes: DataFrame) -> DataFrame:
    """Size, GC share, gene count, coding density and mean protein length per strain.

    Overlapping genes count twice in the density.  Every aggregate combines before the shuffle.
    """
    size = contigs.groupBy("strain").agg(
        F.sum(F.length("seq")).alias("genome_size"), F.sum(count_chars(F.upper("seq"), "GC")).alias("gc"))
    called = genes.groupBy("strain").agg(
        F.count("*").alias("n_genes"), F.sum("length_nt").alias("coding_nt"), F.sum("length_aa").alias("aa"))
    n = F.col("genome_size")
    return size.join(called, "strain", "left").select(
        "strain", "genome_size",
        F.when(n > 0, F.round(100 * F.col("gc") / n, 2)).otherwise(0.0).alias("gc_percent"),
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        F.when(n > 0, F.round(F.coalesce("coding_nt", F.lit(0)) / n, 3)).otherwise(0.0).alias("coding_density"),
        F.coalesce(F.round(F.col("aa") / F.col("n_genes"), 1), F.lit(0.0)).alias("mean_gene_aa"))


def gene_summary(stats: DataFrame, genes: DataFrame) -> DataFrame:
    """The shorter per-genome table: genes, size in Mb, density in percent, mean gene length in bp."""
    mean_bp = genes.groupBy("strain").agg(F.round(F.avg("length_nt"), 0).cast("bigint").alias("mean_gene_bp"))
    return stats.join(mean_bp, "strain", "left").select(
        "strain", F.col("n_genes").alias("genes"), F.round(F.col("genome_size") / 1e6, 3).alias("genome_mb"),
        F.round(100 * F.col("coding_density"), 1).alias("coding_density_pct"), "mean_gene_bp")


def cohort_stats(stats: DataFrame) -> DataFrame:
    """Cohort means and totals."""
    return stats.agg(F.count("*").alias("n_genomes"), F.avg("n_genes").alias("mean_genes"),
                     F.avg("coding_density").alias("mean_coding_density"), F.sum("n_genes").alias("total_genes"))
