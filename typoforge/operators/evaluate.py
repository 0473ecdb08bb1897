"""Evaluation: predicted fixes against true edits, per sample and over all samples.

fixes has sample_index, corrupted, fixed; truth has sample_index, corrupted, original; either may have a column
position.  Of rows that repeat a name the one of the greatest position wins, as in a map that is filled in order;
rows without positions have no order, so the greatest value stands.  Everything is one join on (sample_index,
corrupted) and partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import normalised_distance


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _last(frame: DataFrame, value: str) -> DataFrame:
    """One row for each name."""
    which = F.max_by(value, "position") if "position" in frame.columns else F.max(value)
    return frame.groupBy("sample_index", "corrupted").agg(which.alias(value))


def last_fixes(fixes: DataFrame) -> DataFrame:
    """One fix for each name: of several the last, and no fix that changes nothing."""
    return _last(fixes, "fixed").filter(F.col("corrupted") != F.col("fixed"))


def matched(fixes: DataFrame, truth: DataFrame) -> DataFrame:
    """Names of either side with both targets and a status: correct, wrong, missed, false fix."""
    one = _last(truth, "original")
    status = (
        F.when(F.col("original").isNull(), "false fix")
        .when(F.col("fixed").isNull(), "missed")
        .when(F.col("original") == F.col("fixed"), "correct")
        .otherwise("wrong")
    )
    return one.join(fixes.select("sample_index", "corrupted", "fixed"), ["sample_index", "corrupted"], "full_outer").withColumn("status", status)


def per_sample(fixes: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn of each sample: a wrong fix is a false positive and not a miss."""
    return matched(fixes, truth).groupBy("sample_index").agg(
        F.count_if(F.col("status") == "correct").alias("tp"),
        F.count_if(F.col("status").isin("wrong", "false fix")).alias("fp"),
        F.count_if(F.col("status") == "missed").alias("fn"),
    )


def clean_totals(clean: DataFrame) -> DataFrame:
    """clean_samples_total, clean_false_positive_count and rate, of clean samples' n_changed and n_names."""
    return clean.agg(
        F.count("*").alias("clean_samples_total"),
        F.coalesce(F.sum("n_changed"), F.lit(0)).alias("clean_false_positive_count"),
        ratio(F.sum("n_changed"), F.sum("n_names")).alias("clean_false_positive_rate"),
    )


#: Edits that are looked for first between a prediction and its target.
NEAR = (3, 8, 24)


def metrics(results: DataFrame, counts: DataFrame) -> DataFrame:
    """One row over all samples; zero-safe.

    results has sample_index, predicted_code, ground_truth_code; counts is per_sample().
    """
    # Texts are compared before the join, so that they don't go through its shuffle.
    near = normalised_distance(F.col("predicted_code"), F.col("ground_truth_code"), NEAR)
    rows = results.select("sample_index", (F.col("predicted_code") == F.col("ground_truth_code")).cast("double").alias("exact"), near.alias("distance"))
    joined = rows.join(counts, "sample_index", "left")
    tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    sums = joined.agg(
        F.count("*").alias("total_samples"),
        F.coalesce(F.avg("exact"), F.lit(0.0)).alias("exact_match_rate"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.coalesce(F.avg("distance"), F.lit(0.0)).alias("avg_normalized_edit_distance"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "total_samples", "exact_match_rate", p.alias("identifier_precision"), r.alias("identifier_recall"), ratio(2 * p * r, p + r).alias("identifier_f1"), "avg_normalized_edit_distance"
    )


def timing(results: DataFrame, wall_seconds: float) -> DataFrame:
    """Seconds for each error sample and for each kB of corrupted code; the wall clock is the caller's."""
    return results.agg(
        F.lit(wall_seconds).alias("total_time_seconds"),
        ratio(F.lit(wall_seconds), F.count("*")).alias("avg_time_per_sample_seconds"),
        ratio(F.lit(wall_seconds), F.sum(F.octet_length("corrupted_code")) / 1024).alias("avg_time_per_kb_seconds"),
    )


def detection_counts(tokens: DataFrame, ignored: int = -100) -> DataFrame:
    """tp, fp, fn and precision, recall, F1 of binary token labels, ignoring masked tokens."""
    seen = tokens.filter(F.col("label") != ignored)
    hit = lambda p, t: F.count_if((F.col("predicted") > 0) == F.lit(p)) if t is None else F.count_if(((F.col("predicted") > 0) == F.lit(p)) & ((F.col("label") > 0) == F.lit(t)))
    sums = seen.agg(hit(True, True).alias("tp"), hit(True, False).alias("fp"), hit(False, True).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))
