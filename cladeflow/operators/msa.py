"""Multiple alignment of gene families, one row at a time: to the longest member, then to profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.star import profile_rows, star_rows
from cladeflow.operators.common import checkpoint, task_count
from cladeflow.params import PROTEIN_SCORES, Scoring

ROUNDS = 12        # rounds of a profile alignment at most


def star_alignment(sequences: DataFrame, scores: Scoring = PROTEIN_SCORES) -> DataFrame:
    """``sequences(family, strain, seq)`` -> ``(family, strain, aligned)``, equal widths per family.

    Every member is aligned to the family's longest sequence on its own; the widest insertion
    before each centre position then tells every row where to open gaps.  No task sees a whole
    family.  A stand-in for a dedicated aligner: pass the rows of one to ``place_blocks``.
    """
    centre = sequences.groupBy("family").agg(
        F.min(F.struct((-F.length("seq")).alias("l"), "strain", F.col("seq").alias("centre")))["centre"].alias("centre"))
    pairs = sequences.join(centre, "family").select("family", "strain", "seq", "centre")
    kind = sequences.schema["family"].dataType.simpleString()
    strain = sequences.schema["strain"].dataType.simpleString()
    rows = checkpoint(pairs.repartition(task_count(sequences.sparkSession), "family", "strain").mapInPandas(
        star_rows(scores), f"family {kind}, strain {strain}, under string, before array<string>"))
    return opened(rows)


def opened(rows: DataFrame) -> DataFrame:
    """``(family, strain, aligned)`` from what each row has under every column and before it.

    ``rows(family, strain, under, before)``: the widest insertion before a column tells every row where to open gaps.
    """
    inserted = F.filter(F.transform("before", lambda text, slot: F.struct(slot.alias("slot"), F.length(text).alias("width"))), lambda x: x["width"] > 0)
    wide = rows.select("family", F.explode(inserted).alias("i")).groupBy("family", "i.slot").agg(F.max("i.width").alias("width"))
    gaps = wide.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("slot", "width"))).alias("gaps"))
    # a row is its stretches between the family's open slots, each followed by what the slot holds
    past = lambda i: F.coalesce(F.get("gaps", i - 1)["slot"], F.lit(0))
    stretches = F.transform("gaps", lambda gap, i: F.concat(
        F.substring(F.col("under"), past(i) + 1, gap["slot"] - past(i)), F.rpad(F.get("before", gap["slot"]), gap["width"], F.lit("-"))))
    rest = F.substring(F.col("under"), past(F.size("gaps")) + 1, F.length("under"))
    text = F.concat(F.array_join(stretches, ""), rest)
    known = rows.join(gaps, "family", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<struct<slot:int,width:int>>")))
    return known.select("family", "strain", text.alias("aligned"))


def column_counts(alignment: DataFrame) -> DataFrame:
    """Letters of every column: ``(family, place, letter, n)``; rows combine before they meet."""
    letters = alignment.select("family", F.posexplode(F.split("aligned", "")).alias("place", "letter")).filter("letter <> ''")
    return letters.groupBy("family", "place", "letter").agg(F.count("*").alias("n"))


def pair_score(counts: DataFrame, scores: Scoring) -> DataFrame:
    """Sum-of-pairs score of every family from its column counts: equal letters, other letters, a letter and a gap."""
    twice = lambda n: n * (n - 1) / 2
    residue = F.col("letter") != "-"
    columns = counts.groupBy("family", "place").agg(
        F.sum(F.when(residue, F.col("n")).otherwise(0)).alias("res"), F.sum(F.when(residue, 0).otherwise(F.col("n"))).alias("gap"),
        F.sum(F.when(residue, twice(F.col("n"))).otherwise(0)).alias("same"))
    score = scores.match * F.col("same") + scores.mismatch * (twice(F.col("res")) - F.col("same")) + scores.gap * F.col("res") * F.col("gap")
    return columns.groupBy("family").agg(F.sum(score).cast("bigint").alias("score"))


def without_empty_columns(alignment: DataFrame) -> DataFrame:
    """Rows without the columns in which their family has gaps only."""
    full = column_counts(alignment).filter("letter <> '-'").select("family", "place").distinct()
    kept = full.groupBy("family").agg(F.sort_array(F.collect_set("place")).alias("kept"))
    letters = F.split("aligned", "")
    return alignment.join(kept, "family", "left").select(
        "family", "strain", F.coalesce(F.array_join(F.transform("kept", lambda i: F.get(letters, i)), ""), F.lit("")).alias("aligned"))


def profile_alignment(sequences: DataFrame, scores: Scoring = PROTEIN_SCORES, rounds: int = ROUNDS) -> DataFrame:
    """``sequences(family, strain, seq)`` -> ``(family, strain, aligned, score, star_score)``, equal widths per family.

    Starts from the star alignment.  In each round the letters of every column are counted, and half of the rows (by a hash
    that changes with the round) are aligned anew to that profile less their own row, so that a row meets a table as long
    as the alignment is wide and never its family.  A family takes a round's alignment if its sum-of-pairs score is higher, and
    rounds end when no family's rises twice in a row, or after ``rounds``.  The score is never under the star's.
    """
    kind, strain = (sequences.schema[c].dataType.simpleString() for c in ("family", "strain"))
    current = checkpoint(without_empty_columns(star_alignment(sequences, scores)))
    best = checkpoint(pair_score(column_counts(current), scores))
    star, still = best, 0
    for turn in range(rounds):
        columns = column_counts(current).groupBy("family", "place").agg(F.array_join(F.sort_array(F.collect_list(F.concat("letter", F.col("n").cast("string"), F.lit(";")))), "").alias("letters"))
        profile = columns.groupBy("family").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "letters"))), lambda x: x["letters"]).alias("profile"))
        chosen = F.pmod(F.xxhash64("family", "strain", F.lit(turn)), F.lit(2)) == turn % 2
        pairs = current.join(profile, "family").withColumn("anew", chosen)
        rows = pairs.repartition(task_count(sequences.sparkSession), "family", "strain").mapInPandas(
            profile_rows(scores), f"family {kind}, strain {strain}, under string, before array<string>")
        after = checkpoint(without_empty_columns(opened(checkpoint(rows))))
        found = pair_score(column_counts(after), scores).withColumnRenamed("score", "next").join(best, "family")
        better = checkpoint(found.filter(F.col("next") > F.col("score")).select("family", F.col("next").alias("score")))
        if better.isEmpty():
            still += 1
            if still == 2:
                break
            continue
        still = 0
        names = better.select("family")
        current = checkpoint(after.join(names, "family", "left_semi").unionByName(current.join(names, "family", "left_anti")))
        best = checkpoint(best.join(names, "family", "left_anti").unionByName(better))
    return current.join(best, "family", "left").join(star.withColumnRenamed("score", "star_score"), "family", "left").select(
        "family", "strain", "aligned", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("star_score", F.lit(0)).alias("star_score"))
