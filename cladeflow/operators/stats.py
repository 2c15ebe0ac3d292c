"""Contingency tables, Fisher's exact test and the Benjamini-Hochberg correction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.common import checkpoint
from cladeflow.operators.ordering import reverse_running_min, running_total
from cladeflow.params import ODDS_RATIO_CAP, SIGNIFICANT_Q


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 from Stirling's series, shifted up by eight first."""
    y = x + F.lit(8.0)
    r = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * F.lit(1 / 1680)))) / y
    shift = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(shift)


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def fisher_greater(df: DataFrame, a: str, b: str, c: str, d: str, name: str = "p_value") -> DataFrame:
    """One-sided exact p-value of the table [[a, b], [c, d]].

    Above the mean the upper tail is summed from the observed count on; below it the lower tail
    is summed downwards from the count before and taken from one.  Either way the first
    term is the largest and the rest follow by ratios below one, so nothing underflows that
    matters: forty standard deviations (and fifty terms) further on a term is under 1e-300 of the first.
    """
    x, row, col, n = (F.col(v).cast("double") for v in ("_x", "_row", "_col", "_n"))
    work = (df.withColumn("_x", F.col(a)).withColumn("_row", F.col(a) + F.col(b))
            .withColumn("_col", F.col(a) + F.col(c)).withColumn("_n", F.col(a) + F.col(b) + F.col(c) + F.col(d)))
    mean = row * col / F.greatest(n, F.lit(1.0))
    spread = F.ceil(40 * F.sqrt(mean * (1 - row / F.greatest(n, F.lit(1.0)))) + 50)
    above = x > mean
    least = F.greatest(row + col - n, F.lit(0.0))
    work = (work.withColumn("_above", above).withColumn("_from", F.when(above, x).otherwise(x - 1))
            .withColumn("_steps", F.least(spread, F.when(above, F.least(row, col) - x).otherwise(x - 1 - least)).cast("bigint")))
    start = F.col("_from")
    work = work.withColumn("_first", F.exp(_log_choose(col, start) + _log_choose(n - col, row - start) - _log_choose(n, row)))

    def step(acc: Column, i: Column) -> Column:
        up = start + i
        down = start - i
        ratio = F.when(F.col("_above"), (col - up) * (row - up) / ((up + 1.0) * (n - row - col + up + 1.0))).otherwise(
            down * (n - row - col + down) / ((col - down + 1.0) * (row - down + 1.0)))
        term = acc["term"] * ratio
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    # a count at its smallest possible value has no lower tail
    tail = F.when(F.col("_steps") < 0, F.lit(0.0)).otherwise(F.aggregate(
        F.when(F.col("_steps") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_steps") - 1), lambda i: i.cast("double")))
        .otherwise(F.array().cast("array<double>")),
        F.struct(F.col("_first").alias("total"), F.col("_first").alias("term")), step, lambda acc: acc["total"]))
    p = F.when(F.col("_above"), tail).otherwise(1 - tail)
    return work.withColumn(name, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).drop("_x", "_row", "_col", "_n", "_above", "_from", "_steps", "_first")


def odds_ratio(a: Column, b: Column, c: Column, d: Column, cap: float = ODDS_RATIO_CAP) -> Column:
    """Sample odds ratio; infinity becomes ``cap`` and 0/0 becomes NULL."""
    return F.when(b * c > 0, (a * d).cast("double") / (b * c)).when(a * d > 0, F.lit(cap))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Step-up q-values over all rows.

    Equal p-values share one q, so the ranking runs over distinct p-values with their counts:
    ranks are a distributed running total and the step-up is a distributed reverse minimum.
    """
    tests = checkpoint(tests)            # read three times
    total = tests.count()
    levels = tests.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_c"))
    ranked = running_total(levels, p, "_c", "_rank").withColumn("_raw", F.col(p) * total / F.col("_rank"))
    stepped = reverse_running_min(ranked, p, "_raw", "_q").select(p, F.least("_q", F.lit(1.0)).alias(q))
    return tests.join(stepped, p, "left")


def domain_counts(domains: DataFrame, families: DataFrame) -> DataFrame:
    """2x2 counts per domain over families, accessory/unique against core/soft-core.

    ``domains(family, pfam, description)``, ``families(family, class)``.
    """
    variable = F.col("class").isin("accessory", "unique")
    sizes = families.agg(F.count_if(variable).alias("_v"), F.count_if(~variable).alias("_k"))
    carried = (domains.groupBy("pfam", "family").agg(F.min("description").alias("description"))
               .join(families.select("family", "class"), "family"))
    counted = carried.groupBy("pfam").agg(
        F.min("description").alias("description"),
        F.count_if(variable).alias("n_accessory"), F.count_if(~variable).alias("n_core"))
    return (counted
            .withColumn("b", sizes.select("_v").scalar() - F.col("n_accessory"))
            .withColumn("d", sizes.select("_k").scalar() - F.col("n_core"))
            .filter(F.col("n_accessory") + F.col("n_core") > 0))


def domain_enrichment(domains: DataFrame, families: DataFrame) -> DataFrame:
    """Fisher test per domain with odds ratio and q-value."""
    counts = domain_counts(domains, families)
    tested = fisher_greater(counts, "n_accessory", "b", "n_core", "d").withColumn(
        "odds_ratio", odds_ratio(F.col("n_accessory"), F.col("b"), F.col("n_core"), F.col("d")))
    return benjamini_hochberg(tested).select(
        "pfam", "description", "n_accessory", "n_core", "odds_ratio", "p_value", "q_value")


def significant(tests: DataFrame, alpha: float = SIGNIFICANT_Q) -> DataFrame:
    return tests.filter(F.col("q_value") < alpha)
