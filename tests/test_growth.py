"""Work and shuffled bytes that follow the input: plans without the steps that grew faster or moved rows for nothing."""

import random

import duckdb
from pyspark.sql import functions as F

from typoforge import queries
from typoforge.functions import names as N
from typoforge.operators.correct import corrected
from typoforge.operators.relational import position_diff
from typoforge.plans import typos


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_corrections_of_a_text_take_one_pass(spark):
    texts = spark.createDataFrame([(1, "Teh é teh TEH, other tEh " * 300), (2, None), (None, "teh")], "sample_index int, code string")
    done = corrected(texts, spark.createDataFrame([("teh", "the")], "word string, correction string"))
    assert "lambdafunction" not in plan(done)  # words before an edit were summed anew for each edit
    got = {r.sample_index: (r.code, [tuple(e) for e in r.edits]) for r in done.collect()}
    assert got[1][0] == "The é the THE, other tEh " * 300 and len(got[1][1]) == 900 and got[1][1][-2] == (299 * 25 + 6, "teh", "the")
    assert got[2] == (None, []) and got[None] == ("the", [(0, "teh", "the")])


def test_first_names_nearby_without_pairs_as_rows(spark):
    at = lambda rows: spark.createDataFrame(rows, "sample_index int, line int, col long, ordinal long, name string")
    before = [(s, 1, c, (c * 37) % 1000, "n%d" % (c % 90)) for s in (0, 1) for c in range(0, 2000, 3)] + [(0, 1, 5, 0, None), (None, 1, 5, 0, "a"), (0, None, 5, 0, "b"), (0, 1, None, 0, "c"), (0, 2, 7, 0, "d")]
    after = [(0, 1, c, 0, "n%d" % (c * 7 % 90)) for c in range(-4, 2000, 2)] + [(0, 1, 319, 0, "a"), (0, 1, 321, 0, "b"), (0, 1, 321, 0, "b"), (0, 1, 6, 0, None), (None, 1, 5, 0, "x"), (0, 2, 13, 0, "far")]
    want = {}
    for s, k, c, o, name in before:
        near = [(o, b[2] - c, b[4]) for b in after if None not in (s, k, c, name, b[4]) and b[:2] == (s, k) and abs(b[2] - c) <= 5 and b[4] != name]
        if near:
            want[s, name] = min([min(near), *([want[s, name]] if (s, name) in want else [])])
    got = position_diff(at(before), at(after))
    assert "Join" not in plan(got)
    assert {(r.sample_index, r.corrupted): r.fixed for r in got.collect()} == {k: v[2] for k, v in want.items()} and len(want) > 20


def test_pairs_are_distinct_without_a_shuffle_of_them(spark, data, tmp_path):
    odd = ["xxab", "xab", "ab", "aaab", "xxx", "xxxx", "__aa_bb", "Éé_k", "x", "", "loool"]
    part = spark.read.parquet(f"{data}/part.parquet").limit(5)
    rows = part.select("p_partkey", "p_type", "p_size", "p_name").union(spark.createDataFrame([(-i, "t", 1, n) for i, n in enumerate(odd)], "p_partkey long, p_type string, p_size int, p_name string"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{data}/customer.parquet").limit(20).write.parquet(f"{tmp_path}/customer.parquet")
    got, n = queries._pairs(spark, str(tmp_path)), queries.names(spark, str(tmp_path))
    want = N.typo_rows(n).select("typo", "name").filter("typo <> name").union(n.select("name", F.concat(F.lit("x"), "name"))).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plan(got).count("keys=[c#") == 0  # no distinct() of pairs


def test_typos_that_are_names_are_asked_by_hashes(spark, data, tmp_path):
    odd = ["xxab", "xab", "ab", "aaab", "xxx", "xxxx", "__aa_bb", "Éé_k", "x", "", "loool", "a b", "prnit", "_a_x__", "naKe", "bİc", "abcd\n", "Customer_00000001", "\U0001f600xyz", "l" * 3000]
    part = spark.read.parquet(f"{data}/part.parquet").limit(5)
    rows = part.select("p_partkey", "p_type", "p_size", "p_name").union(spark.createDataFrame([(-i, "t", 1, n) for i, n in enumerate(odd)], "p_partkey long, p_type string, p_size int, p_name string"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{data}/customer.parquet").limit(120).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.typo_pick(spark, str(tmp_path))
    assert "LeftAnti" not in plan(got) and "Broadcast" not in plan(got)  # all typos met all names as strings
    assert {r.name: r.typo for r in got.collect()} == dict(con.execute(queries.ORACLES["typo_pick"]).fetchall())


def test_hashes_of_typos_are_those_of_their_strings(spark):
    draw = random.Random(3)
    words = ["", None, "a\0b", "\U0001f600xyz", "a" * 50, *("".join(draw.choice("aAzZ_09 éKſ") for _ in range(draw.randint(0, 9))) for _ in range(400))]
    made = {w: [(i, w[:i] + put + w[i + skip :]) for i, skip, put in typos.edits(w)] for w in words if w}
    rows = N.typo_rows(spark.createDataFrame([(w,) for w in made if w.isascii()], "name string")).orderBy("op", "pos", "typo").collect()
    assert {w: m for w, m in made.items() if m and w.isascii()} == {w: [(r.pos, r.typo) for r in rows if r.name == w] for w in {r.name for r in rows}}
    of = lambda xs: typos._hashed(xs)[0].tolist()
    pairs = {(w, t) for w, m in made.items() for _, t in m}
    assert set(zip(*(x.tolist() for x in typos.typo_hashes(words)), strict=True)) == set(zip(of([w for w, _ in pairs]), of([t for _, t in pairs]), strict=True))


def test_names_with_equal_hashes_are_told_apart(spark):
    names = ["abcd", "abdc", "other"]
    assert typos.chosen_typo("abcd", names, 0) == typos.chosen_typo("abcd", ["abdc"], 0)
    every = {typos.chosen_typo("abcd", names, k) for k in range(60)}
    assert "abdc" not in every and "acbd" in every and typos.chosen_typo("x", [], 5) is None
