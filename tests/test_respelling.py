"""Spelling fixes looked up where the names are, by words that are read once, and texts that are compared before a join."""

from pyspark.sql import functions as F

from typoforge.functions import edits as E
from typoforge.functions.names import split_identifier
from typoforge.operators import evaluate as V
from typoforge.plans import fixers

NAMES = ["coutn_total", "CoutnTotal", "COUTN_x2", "__coutn", "cOutn", "totla", "TOTLA9", "abc__totla_", "count", "to", "tot_la", "größe_totla", "123", "_", "HTTPTotla", "Kk", "totla_123456"]


def test_looked_up_fixes_are_those_of_the_join(spark):
    samples = spark.createDataFrame([(1, NAMES), (2, NAMES[:3]), (3, []), (4, None)], "sample_index long, names array<string>")
    words = spark.createDataFrame([("count", 9), ("total", 4), ("tötal", 9), ("x2", 1), ("123456", 3), ("t1o2t3", 2)], "word string, n long")
    read = lambda small: sorted(map(tuple, fixers.SpellFix(words, small=small).fix(samples).collect()))
    joined = fixers.SpellFix(words, small=-1).fix(samples)
    assert read(50_000) == sorted(map(tuple, joined.collect())) and len(read(50_000)) > 10
    looked_up = fixers.SpellFix(words).fix(samples)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in looked_up and "Join" not in looked_up  # all names were shuffled four times


def test_words_of_a_name_are_those_of_the_column(spark):
    rows = spark.createDataFrame([(n,) for n in [*NAMES, "", "a__", "___", "AbcDEFg1h", "é_É"]], "name string")
    for r in rows.select("name", split_identifier(F.col("name")).alias("words")).collect():
        assert fixers.identifier_words(r.name) == r.words


def test_near_distances_are_exact(spark):
    rows = [("abcdef" * 9, "abcdxf" * 9), ("kitten", "sitting"), ("", "abc"), ("a", "a"), (None, "a"), ("über", "uber"), ("x" * 40, "y" * 30)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(E.normalised_distance(F.col("a"), F.col("b")).alias("x"), E.normalised_distance(F.col("a"), F.col("b"), V.NEAR).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]


def test_texts_are_compared_before_the_join(spark):
    results = spark.createDataFrame([(1, "ab", "ab"), (2, "ab", "ac")], "sample_index long, predicted_code string, ground_truth_code string")
    counts = spark.createDataFrame([(1, 1, 0, 0)], "sample_index long, tp long, fp long, fn long")
    done = V.metrics(results, counts)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") > plan.index("Join")  # below it
    assert tuple(done.first())[:2] == (2, 0.5) and done.first().avg_normalized_edit_distance == 0.25
