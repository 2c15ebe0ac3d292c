"""Identifier parsers and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeflow.params import CLUMPED_ALPHA, SOFT_CORE_FRACTION

# A gene whose lower-cased name contains one of these is chromosomal.
INTRINSIC_MARKERS = (
    "aac(6')-iaa", "aac(6')-iay", "aac(6')-iz", "aac(6')-iic", "mdtk", "mdfa", "acra", "acrb",
    "acrd", "emra", "emrb", "emrd", "emry", "mdsa", "mdsb", "mdsc", "mdtb", "mdtc", "mdth", "msba",
    "yoji", "tolc", "mara", "rama", "soxs", "emrr", "h-ns", "gols", "cpxa", "cpxr", "crp", "hfq",
    "roba", "sdia", "gadx", "gadw", "kdpe", "phop", "phoq", "ampr", "amps", "lpxc", "pmrf", "pmre",
    "ugd", "arna", "arnb", "baca", "baea", "baer", "epta", "eptb", "mcr-9",
)

# Reporting vocabulary.
PATTERN_SINGLE = "single isolate (uninformative)"
PATTERN_NO_TEST = "invariant (no test)"
PATTERN_CLUMPED = "clumped (inherited)"
PATTERN_SCATTER = "scattered (repeated acquisition)"
CLASSES = ("core", "soft-core", "accessory", "unique")

# Header patterns of the reference databases.
REPLICON_PATTERN = r"^(.+?)_(\d+)_"
ARO_PATTERN = r"ARO:\d+"
VFDB_GENE_PATTERN = r"\((gb\|[A-Za-z0-9._]+)\)"
VFDB_CATEGORY_SUFFIX = r"\s*\(VFC\d+\)\s*$"
ACCESSION_PATTERN = r"^GC[AF]_\d+\.\d+$"


def strain_of(header: Column) -> Column:
    """Text before the first bar of a gene header."""
    return F.substring_index(header, "|", 1)


def canonical_key(name: Column) -> Column:
    """Tree readers may turn underscores into blanks; compare names in one spelling."""
    return F.translate(name, " ", "_")


def is_acquired(gene: Column, markers: tuple[str, ...] = INTRINSIC_MARKERS) -> Column:
    """True unless the gene name contains the name of a chromosomal gene."""
    low = F.lower(gene)
    return ~F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))


def classify_family(n_genomes: Column, presence: Column) -> Column:
    """core, soft-core, unique or accessory, tested in that order."""
    return (F.when(presence == n_genomes, "core")
            .when(presence >= F.lit(SOFT_CORE_FRACTION) * n_genomes, "soft-core")
            .when(presence == 1, "unique")
            .otherwise("accessory"))


def classify_pattern(n_isolates: Column, p_clumped: Column, alpha: float = CLUMPED_ALPHA) -> Column:
    """Verdict of the clumping test; a single carrier is never tested."""
    return (F.when(n_isolates == 1, PATTERN_SINGLE)
            .when(p_clumped.isNull(), PATTERN_NO_TEST)
            .when(p_clumped < alpha, PATTERN_CLUMPED)
            .otherwise(PATTERN_SCATTER))


def _match(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def replicon_name(header: Column) -> Column:
    """Replicon type: the part before ``_<number>_``, else the whole header."""
    return F.coalesce(_match(header, REPLICON_PATTERN, 1), header)


def card_gene(header: Column) -> Column:
    """First word of the fourth bar-separated field, else first word of the header."""
    parts = F.split(header, r"\|")
    return _first_word(F.when(F.size(parts) > 3, F.get(parts, 3)).otherwise(header))


def aro_accession(header: Column) -> Column:
    """The ARO accession named in the header, or NULL."""
    return _match(header, ARO_PATTERN, 0)


def vfdb_gene(header: Column) -> Column:
    return F.coalesce(_match(header, VFDB_GENE_PATTERN, 1), _first_word(header))


def _after_accession(header: Column) -> Column:
    return F.trim(F.coalesce(_match(header, r"(?s)^.*?" + VFDB_GENE_PATTERN + r"(.*)$", 2), F.lit("")))


def vfdb_product(header: Column) -> Column:
    """Text between the accession and the first bracket; empty without an accession."""
    return F.trim(F.substring_index(_after_accession(header), "[", 1))


def vfdb_category(header: Column) -> Column:
    """Last `` - `` part of the first bracket, without its category code."""
    inner = F.trim(F.regexp_extract(_after_accession(header), r"\[([^\]]+)\]", 1))
    return F.trim(F.regexp_replace(F.substring_index(inner, " - ", -1), VFDB_CATEGORY_SUFFIX, ""))
