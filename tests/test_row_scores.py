"""N-gram scores within a row and by a shuffle, exact length quantiles, spelling joins without broadcasts."""

import math

import pytest
from pyspark.sql import functions as F

from typoforge.operators import relational as R
from typoforge.operators import report


def test_row_and_shuffled_grams_agree(spark):
    rows = [("the cat sat on the mat", "the cat is on the mat mat"), ("", "a b"), (None, None), ("x", "x"), ("a b  c\td  ", "a b c d e"), ("ééé aaa", "éé aaaa"), ("\U0001f600\U0001f600b", "\U0001f600b")]
    pairs = spark.createDataFrame(rows, "predicted string, reference string")
    read = lambda df: sorted(tuple(r) for r in df.select("kind", "n", "matched", "predicted", "reference").collect())
    assert read(report.row_matches(pairs)) == read(report.gram_matches(pairs))
    want = tuple(report.text_scores(pairs).first())
    for most in (8, -1):
        assert tuple(report.text_scores(pairs, row_chars=most).first()) == pytest.approx(want, rel=1e-12)


def test_row_grams_are_not_shuffled(spark):
    plan = report.row_matches(spark.createDataFrame([("a b", "a")], "predicted string, reference string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_quantiles_are_exact_beyond_any_sketch(spark):
    lengths = [(i * 7919) % 20011 for i in range(20000)]
    rows = spark.createDataFrame([("a", "s%d" % (i % 3), n) for i, n in enumerate(lengths)] + [("b", "s", None), ("b", "s", 5)], "lang string, source string, n_chars long")
    got = report.count_quantiles(report.merged_counts(report.length_counts(rows, "n_chars", ["lang", "source"]), ["lang"]), {"p50": 50, "p95": 95}, ["lang"])
    got = {r.lang: (r.n, r.p50, r.p95) for r in got.collect()}
    order = sorted(lengths)
    assert got == {"a": (20000, order[math.ceil(10000) - 1], order[19000 - 1]), "b": (2, 5, None)}


def test_spelling_joins_never_broadcast(spark):
    words = spark.createDataFrame([("coutn", 0), ("count", 5), ("abcdefghijklmnopqrstu", 3), ("abcdefghijkmnopqrstu", 0)], "word string, n long")
    found = R.spell_candidates(words, words.filter("n > 0"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.word, r.candidate, r.distance) for r in found.collect()) == [("abcdefghijkmnopqrstu", "abcdefghijklmnopqrstu", 1), ("coutn", "count", 2)]
    assert found.filter(F.col("distance") > 2).isEmpty()
