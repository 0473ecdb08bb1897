"""Schemas of the tables: explicit, nullable everywhere, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EDIT = T.StructType().add("original_name", "string").add("corrupted_name", "string").add("num_occurrences", "integer")
SAMPLE = (
    T.StructType().add("sample_index", "long").add("code", "string").add("has_errors", "boolean").add("fixed", "string").add("edits", T.ArrayType(EDIT)).add("language", "string")
)
SNIPPET = T.StructType().add("snippet_id", "long").add("source", "string").add("split", "string").add("code", "string")
RESULT = (
    T.StructType()
    .add("sample_index", "long")
    .add("corrupted_code", "string")
    .add("ground_truth_code", "string")
    .add("predicted_code", "string")
    .add("model_fixes", T.MapType(T.StringType(), T.StringType()))
    .add("gt_original_names", T.ArrayType(T.StringType()))
    .add("gt_corrupted_names", T.ArrayType(T.StringType()))
)
METRICS = (
    T.StructType()
    .add("total_samples", "long")
    .add("exact_match_rate", "double")
    .add("identifier_precision", "double")
    .add("identifier_recall", "double")
    .add("identifier_f1", "double")
    .add("avg_normalized_edit_distance", "double")
    .add("clean_samples_total", "long")
    .add("clean_false_positive_count", "long")
    .add("clean_false_positive_rate", "double")
    .add("total_time_seconds", "double")
    .add("avg_time_per_sample_seconds", "double")
    .add("avg_time_per_kb_seconds", "double")
)
BENCHMARK = (
    T.StructType()
    .add("model", "string")
    .add("model_key", "string")
    .add("dataset", "string")
    .add("timestamp", "string")
    .add("git_commit", "string")
    .add("elapsed_wall_seconds", "double")
    .add("metrics", METRICS)
    .add("error", "string")
)
TOKEN = T.StructType().add("text", "string").add("row", "integer").add("col", "integer").add("kind", "string").add("is_name", "boolean")
BINDING = T.StructType().add("name", "string").add("scope_id", "integer").add("kind", "string").add("line", "integer").add("col", "integer")
