"""Thresholds and constants of the pipeline.  Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scoring:
    """Linear-gap local alignment scores."""

    match: int
    mismatch: int
    gap: int


# Scoring schemes of the protein and the nucleotide screen.
PROTEIN_SCORES = Scoring(match=2, mismatch=-1, gap=-3)
NUCLEOTIDE_SCORES = Scoring(match=2, mismatch=-2, gap=-4)


@dataclass(frozen=True)
class ScreenParams:
    """One homology screen: k-mer gate, then verified alignment."""

    k: int
    prefilter: float
    min_identity: float
    min_coverage: float
    scores: Scoring


# Published conventions of the three reference databases.
PROTEIN_SCREEN = ScreenParams(5, 0.20, 0.90, 0.60, PROTEIN_SCORES)
REPLICON_SCREEN = ScreenParams(12, 0.30, 0.95, 0.60, NUCLEOTIDE_SCORES)


MAX_CANDIDATES = 25          # candidate families listed and aligned per protein


@dataclass(frozen=True)
class FamilyParams:
    """Gene-family clustering."""

    k: int = 5
    min_identity: float = 0.70
    min_coverage: float = 0.70
    prefilter: float = 0.0
    scores: Scoring = PROTEIN_SCORES
    max_candidates: int = MAX_CANDIDATES
    wave: int = 5               # candidates aligned in the first wave; each next one is twice as long


MIN_PROTEIN_AA = 30          # shortest protein kept for screening
SOFT_CORE_FRACTION = 0.95
SKETCH_K = 31
SKETCH_SCALED = 1000
SPECIES_ANI = 95.0
PERMUTATIONS = 1000
SEED = 42
CLUMPED_ALPHA = 0.05
DOMAIN_MAX_EVALUE = 1e-5
SIGNIFICANT_Q = 0.05
ODDS_RATIO_CAP = 1e9
