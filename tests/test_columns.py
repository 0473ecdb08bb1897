"""Goldens of the Column functions."""

import pytest
from pyspark.sql import functions as F

from typoforge.functions import edits as E
from typoforge.functions import names as N
from typoforge.functions import text as X
from typoforge.operators import relational as R

SPLITS = {
    "my_variable": "my,variable", "myVariable": "my,Variable", "HttpResponse": "Http,Response", "camelCase_snakeCase": "camel,Case,snake,Case",
    "_private": "_,private", "__hidden": "_,_,hidden", "": "", "_": "_", "__": "_,_", "a__b": "a,_,b", "a___b": "a,_,_,b", "HTTP": "HTTP",
    "HTTPError": "HTTP,Error", "file2": "file", "HTTP2": "HTTP", "123": "123",
}
TAGS = [
    ("calcluate", "calculate", "$SWAP_4"), ("nubmer", "number", "$SWAP_2"), ("hte", "the", "$SWAP_0"), ("abxde", "axbde", "$SWAP_1"), ("varname", "varnome", "$SUB_4_o"),
    ("c0unt", "count", "$SUB_1_o"), ("ab$", "abc", "$SUB_2_c"), ("myVar", "myvar", "$CASE_2"), ("MYVAR", "myvar", None), ("numbber", "number", "$DEL_3"), ("ahhead", "ahead", "$DEL_1"),
    ("numberr", "number", "$DEL_5"), ("a", "", "$DEL_0"), ("numbr", "number", "$INS_4_e"), ("teh", "tech", "$INS_2_c"), ("", "a", "$INS_0_a"), ("abc", "abc", None), ("abc", "abcde", None),
    ("abc", "ab$", None), ("abXd", "ab-d", None), ("abd", "ab-d", None), ("abc", "xyz", None), ("x" * 31 + "ab", "x" * 31 + "ba", None), ("ab", "abcd", None),
]
APPLIED = [
    ("abcd", "$SWAP_1", "acbd"), ("abcd", "$SWAP_3", None), ("abcd", "$DEL_4", None), ("abcd", "$INS_4_x", "abcdx"), ("abcd", "$INS_5_x", None), ("abcd", "$INS_0_x", "xabcd"), ("abcd", "$SUB_9_x", None),
    ("abcd", "$SUB_0_x", "xbcd"), ("abcd", "$CASE_0", "Abcd"), ("abcd", "$FOO_1", None), ("abcd", "$DEL_", None), ("abcd", "$DEL_x", None), ("abcd", "$INS_1_xy", None), ("abcd", "$KEEP", None),
]


def test_split(spark):
    got = spark.createDataFrame(list(SPLITS.items()), "n string, e string").select("n", F.array_join(N.split_identifier(F.col("n")), ",").alias("g")).collect()
    assert {r.n: r.g for r in got} == SPLITS


def test_char_edit_tags(spark):
    got = spark.createDataFrame(TAGS, "c string, o string, e string").withColumn("g", E.char_edit_tag(F.col("c"), F.col("o"))).withColumn("back", E.apply_char_edit(F.col("c"), F.col("g"))).collect()
    assert [r.g for r in got] == [r.e for r in got]
    assert all(r.back == r.o for r in got if r.g)


def test_apply(spark):
    got = spark.createDataFrame(APPLIED, "c string, t string, e string").withColumn("g", E.apply_char_edit(F.col("c"), F.col("t"))).collect()
    assert [r.g for r in got] == [r.e for r in got]


def test_case_and_distance(spark):
    rows = [("HELLO", "world", "WORLD"), ("Hello", "world", "World"), ("hello", "World", "world"), ("heLLo", "world", "heLLo")]
    got = spark.createDataFrame(rows, "o string, c string, e string").withColumn("g", N.restore_case(F.col("o"), F.col("c"))).collect()
    assert [r.g for r in got] == [r.e for r in got]
    d = spark.createDataFrame([("", "", 0.0), ("abc", "abc", 0.0), ("abc", "abcd", 0.25), ("über", "uber", 0.25)], "a string, b string, e double").withColumn("g", E.normalised_distance(F.col("a"), F.col("b")))
    assert [r.g for r in d.collect()] == [0.0, 0.0, 0.25, 0.25]


def test_typos_are_seeded_and_valid(spark):
    n = spark.createDataFrame([("number",), ("ab",), ("a",), ("x_y",), ("class_name",)], "n string")
    make = lambda seed, parts: {r.n: r.t for r in N.make_typos(n.repartition(parts), seed, name="n", into="t").collect()}
    one = make(3, 1)
    assert one == make(3, 4) and one["a"] is None and one["ab"] == "aB"
    assert all(t is None or (t != k and t[0] == k[0]) for k, t in one.items())
    both = n.select("n", F.explode(N.typo_candidates(F.col("n"))).alias("c")).select("n", "c.pos", "c.op", "c.typo").collect()
    assert sorted(map(tuple, both)) == sorted((r.n, r.pos, r.op, r.typo) for r in N.typo_rows(n, "n").collect())


def test_typos_avoid_the_names_of_their_group(spark):
    rows = [(g, w, 1) for g in (1, 2) for w in ("ab", "xy", "same", "same")] + [(1, "aB", 1), (2, "xY", 1), (None, "ab", 1)]
    n = spark.createDataFrame(rows, "g int, n string, pos int").withColumnRenamed("pos", "other")
    got = {(r.g, r.n): r.typo for r in N.make_typos(n, 1, name="n", by=("g",)).collect()}
    assert (got[1, "ab"], got[2, "ab"], got[1, "xy"], got[2, "xy"]) == (None, "aB", "xY", None)
    assert N.make_typos(n, 1, name="n", by=("g",)).count() == len(rows) and N.make_typos(n, 1, name="n").columns == ["g", "n", "other", "typo"]
    assert {r.n: r.typo for r in N.make_typos(n, 1, name="n", by=()).collect()}["ab"] is None  # aB is a name of the table
    assert N.make_typos(n.limit(0), 1, name="n").count() == 0


def test_spelling_pairs_of_every_length(spark):
    """Deletion neighbourhoods, segments, and pairs between them, against every pair."""
    import random

    r = random.Random(8)
    stems = ["".join(r.choice("abc") for _ in range(k)) for k in (2, 3, 5, 9, 14, 15, 16, 17, 18, 19, 25, 60) for _ in range(4)] + ["é" * 20, "a" * 17]

    def edited(w):
        for _ in range(r.randint(0, 3)):
            i, c = r.randint(0, len(w)), r.choice("abcé")
            w = r.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        return w

    words, known = {edited(w) for w in stems for _ in range(8)}, {edited(w) for w in stems for _ in range(8)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b, d) for a in words - known for b in known if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    w = spark.createDataFrame([(x,) for x in words], "word string")
    d = spark.createDataFrame([(x, len(x)) for x in known], "word string, n int")
    for short in (2, 16, 40):
        got = [(x.word, x.candidate, x.distance) for x in R.spell_candidates(w, d, short=short).collect()]
        assert set(got) == want and len(got) == len(want) > 300
    one = {(x.word, x.candidate) for x in R.spell_candidates(w, d, 1).collect()}
    assert one == {(a, b) for a, b, d in want if d <= 1}


def test_unequal_tags_are_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([(["a"], ["$KEEP", "$KEEP"])], "t array<string>, g array<string>").select(E.apply_tags(F.col("t"), F.col("g"))).collect()


def test_texts(spark):
    r = spark.createDataFrame([("x = teh\n", ["b", "a"])], "c string, n array<string>").select(
        X.chat_prompt(F.col("c"), F.col("n"), "{code}|{names}").alias("chat"), X.clean_output(F.lit("a<|fim_middle|>b\n \n")).alias("clean"),
        X.python_blocks(F.lit("t\n```python\nx\n```\n```python\ny\n```")).alias("blocks"), X.python_blocks(F.lit("none")).alias("none"), X.padded(F.array(F.lit(1), F.lit(2)), F.lit(3), F.lit(0)).alias("pad"),
    ).first()
    assert (r.chat, r.clean, r.blocks, r.none, r.pad) == ('x = teh|["a","b"]', "ab", "x\n\n\ny\n", None, [1, 2, 0])
