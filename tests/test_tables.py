"""Operators over tables: evaluation goldens, fixers, sources, encoders, streaming, partition independence."""

import json

import pytest
from pyspark.sql import functions as F

from typoforge.operators import encode, evaluate, relational, report, vocab
from typoforge.operators.ranks import bucketed_rank
from typoforge.plans import fixers, inject
from typoforge.queries import snippets
from typoforge.schemas import SAMPLE
from typoforge.sources import readers, sinks
from typoforge.streaming import evaluate as stream


def counts(spark, truth, fixes):
    t = spark.createDataFrame([(1, *x) for x in truth], "sample_index long, corrupted string, original string")
    f = spark.createDataFrame([(1, *x) for x in fixes], "sample_index long, corrupted string, fixed string")
    r = evaluate.per_sample(evaluate.last_fixes(f), t).first()
    return (r.tp, r.fp, r.fn) if r else (0, 0, 0)


@pytest.mark.parametrize(
    ("truth", "fixes", "want"),
    [([("x", "y")], [("x", "y")], (1, 0, 0)), ([("x", "y")], [], (0, 0, 1)), ([("x", "y")], [("x", "z")], (0, 1, 0)), ([("a", "aa")], [("b", "bb")], (0, 1, 1)), ([("a", "b")], [("c", "c")], (0, 0, 1)), ([], [], (0, 0, 0))],
)
def test_counts(spark, truth, fixes, want):
    assert counts(spark, truth, fixes) == want


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "y", "y"), (2, "a", "b")], "sample_index long, predicted_code string, ground_truth_code string")
    c = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 1)], "sample_index long, tp long, fp long, fn long")
    m = evaluate.metrics(rows, c).first()
    assert (m.total_samples, m.exact_match_rate, m.identifier_precision, m.identifier_recall, round(m.identifier_f1, 6)) == (2, 0.5, 1.0, 0.5, 0.666667)
    assert evaluate.metrics(rows.limit(0), c.limit(0)).first().identifier_f1 == 0.0


@pytest.fixture(scope="module")
def built(spark):
    return inject.build(snippets(spark), inject.Plan(seed=4, variants=3, comments=False)).cache()


def test_build_is_independent_of_partitions(spark, built):
    want = sorted((r.sample_index, r.code) for r in built.collect())
    for parts in (1, 4, 17):
        again = inject.build(snippets(spark).repartition(parts), inject.Plan(seed=4, variants=3, comments=False))
        assert sorted((r.sample_index, r.code) for r in again.collect()) == want
    assert all(r.fixed is None and not r.edits for r in built.filter("not has_errors").collect())


def test_fixers(spark, built):
    perfect = fixers.evaluate(built, fixers.make_fixer("perfect"))[0].first()
    assert (perfect.exact_match_rate, perfect.identifier_f1, perfect.clean_false_positive_count) == (1.0, 1.0, 0)
    nothing = fixers.evaluate(built, fixers.make_fixer("none"))[0].first()
    assert (nothing.exact_match_rate, nothing.identifier_recall) == (0.0, 0.0)
    with pytest.raises(ValueError, match="known: chat"):
        fixers.make_fixer("unknown")
    s = spark.createDataFrame([(1, "teh = 1\nprint(teh)\n", ["teh"])], "sample_index long, code string, names array<string>")
    fixed = lambda f: [(r.corrupted, r.fixed) for r in f.fix(s).collect()]
    assert fixed(fixers.TextFix(lambda codes: [c.replace("teh", "the") for c in codes])) == [("teh", "the")]
    assert fixed(fixers.TagFix(lambda codes: [[(1, 0, "teh", "the")] if "teh =" in c else [] for c in codes])) == [("teh", "the")]
    assert fixed(fixers.ChatFix(lambda prompt: 'ok {"teh": "the", "x": "y"}', "{code} {names}", sleep=lambda _: None)) == [("teh", "the")]
    assert fixed(fixers.TableFix(spark.createDataFrame([("teh", "the")], "word string, correction string"))) == [("teh", "the")]
    assert fixed(fixers.SpellFix(spark.createDataFrame([("tech", 5)], "word string, n long"))) == [("teh", "tech")]


def test_the_last_of_a_name_counts(spark):
    t = spark.createDataFrame([(1, "x", "zeta", 0), (1, "x", "alpha", 1)], "sample_index long, corrupted string, original string, position int")
    f = spark.createDataFrame([(1, "x", "zz", 0), (1, "x", "alpha", 1)], "sample_index long, corrupted string, fixed string, position int")
    r = evaluate.per_sample(evaluate.last_fixes(f), t).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 0)


def test_a_model_runs_once(spark, built, tmp_path):
    calls = str(tmp_path / "calls")

    def rewrite(codes):
        with open(calls, "a") as f:
            f.write("x\n" * len(codes))
        return codes

    metrics, results = fixers.evaluate(built, fixers.TextFix(rewrite))
    m = metrics.first()
    assert results.count() == m.total_samples and m.total_time_seconds > 0 < m.avg_time_per_kb_seconds
    with open(calls) as f:
        assert len(f.readlines()) == built.count()


def test_samples_are_built_once(spark, built, tmp_path, monkeypatch):
    """However many parts of an evaluation read them; what no result reads is removed."""
    seen, rows = str(tmp_path / "seen"), built.collect()

    def build(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write("x\n" * len(b))
            yield b

    made = spark.createDataFrame(rows, built.schema).mapInPandas(build, built.schema)
    folder = tmp_path / "shared"
    monkeypatch.setattr("typoforge.session.shared_folder", lambda spark: str(folder))
    metrics, results = fixers.evaluate(made, fixers.PerfectFix())
    assert metrics.count() == 1 and results.count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} == {"metrics", "results"}
    with open(seen) as f:
        assert len(f.readlines()) == len(rows)


def test_chat_errors():
    class Answer(Exception):
        def __init__(self, status):
            self.status_code = status

    assert fixers.passing(OSError()) and fixers.passing(Answer(429)) and fixers.passing(Answer(503)) and not fixers.passing(Answer(400)) and not fixers.passing(ValueError())
    assert fixers.answer_text({"content": " a ", "reasoning": "b"}) == "a" and fixers.answer_text({"content": "", "reasoning": " b"}) == "b" and fixers.answer_text(None) == fixers.answer_text({}) == ""


def test_a_service_that_is_down_fails_the_job(spark):
    def ask(prompt):
        raise OSError("down")

    s = spark.createDataFrame([(1, "teh = 1\n", ["teh"])], "sample_index long, code string, names array<string>")
    with pytest.raises(Exception, match="down"):
        fixers.ChatFix(ask, "{code}", sleep=lambda _: None).fix(s).collect()


def test_models_with_prompt_and_clean_up(spark):
    from typoforge.functions.text import clean_output, lm_prompt

    s = spark.createDataFrame([(1, "teh = 1\nprint(teh)\n", ["teh"])], "sample_index long, code string, names array<string>")
    fix = fixers.TextFix(lambda codes: ["the = 1\nprint(the)\n\n \n"] * len(codes), prompt=lm_prompt, clean=clean_output)
    assert [(r.corrupted, r.fixed) for r in fix.fix(s).collect()] == [("teh", "the")]


def test_spelling_with_two_edits(spark, data):
    s = spark.createDataFrame([(1, "teh = 1\nprint(teh)\n", ["teh"])], "sample_index long, code string, names array<string>")
    fixed = fixers.SpellFix(spark.createDataFrame([("the", 5)], "word string, n long")).fix(s)
    assert [(r.corrupted, r.fixed) for r in fixed.collect()] == [("teh", "the")]
    import duckdb

    from typoforge.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"""create table w as select word, count(*) filter (lang = 'en') as n from
        (select lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) as word, lang from '{data}/documents.parquet') group by 1""")
    con.execute("create table u as select word from w where n = 0 order by hash(word) limit 60")
    want = con.execute("select u.word, w.word, w.n, levenshtein(u.word, w.word) from u, w where w.n > 0 and levenshtein(u.word, w.word) <= 2").fetchall()
    some = {r[0] for r in con.execute("select word from u").fetchall()}
    got = QUERIES["spell_candidates_whole"](spark, data).collect()
    assert sorted((r.word, r.candidate, r.n, r.distance) for r in got if r.word in some) == sorted(want)
    assert {r.distance for r in got} == {1, 2} and any(r.n < 100 for r in got)


def test_sample_files(spark, built, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_samples(built.select(*SAMPLE.names), path)
    back = readers.read_samples(spark, path)
    assert sorted(back.collect()) == sorted(built.select(*SAMPLE.names).collect())
    line = next(p for p in (tmp_path / "s").glob("*.json")).read_text().splitlines()[0]
    assert "fixed" in json.loads(line)
    (tmp_path / "b.json").write_text('\n{"code": "x", "has_errors": true}\n\n')
    assert readers.read_samples(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_samples(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError, match="codealpaca"):
        readers.iter_source("nowhere", spark)
    assert readers.iter_source("demo", spark, max_samples=3).count() == 3


def test_benchmarks_vocab_and_reports(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    metrics = {"total_samples": 1, "identifier_f1": 0.5}
    for name, record in {"a1": {"model": "m", "dataset": "d", "metrics": metrics}, "a2": {"model": "m", "dataset": "d", "metrics": metrics | {"identifier_f1": 0.7}}, "e": {"model": "x", "error": "no"}, "stem": {"metrics": metrics}}.items():
        (d / f"{name}.json").write_text(json.dumps(record))
    got = {(r.dataset, r.model): r.metrics.identifier_f1 for r in readers.read_benchmarks(spark, str(d)).collect()}
    assert got == {("d", "m"): 0.7, ("unknown", "stem"): 0.5}
    sinks.write_vocab(vocab.char_edit_vocab(spark, 2, "ab"), str(tmp_path / "v"))
    back = readers.read_vocab(spark, str(tmp_path / "v" / "*.txt"))
    assert [r.tag for r in back.orderBy("idx").collect()][:5] == ["$KEEP", "$DELETE", "$UNK", "$SWAP_0", "$SWAP_1"]
    assert vocab.is_char_edit_vocab(back)
    sinks.bar_chart(spark.createDataFrame([("a", 0.5)], "model string, f1 double"), "f1", str(tmp_path / "c.svg"))
    assert "<rect" in (tmp_path / "c.svg").read_text()
    s = report.text_scores(spark.createDataFrame([("a b c d e", "a b c d e"), ("x", "y")], "predicted string, reference string")).first()
    assert s.exact_match == 0.5 and 0 < s.bleu < 100 and 0 < s.chrf < 100
    assert readers.discover(spark, str(d)).count() == 4
    (tmp_path / "p.toml").write_text('[one]\nmodel = "m"\n')
    assert readers.read_presets(str(tmp_path / "p.toml")) == {"one": {"model": "m"}}


def test_encoders(spark):
    s = spark.createDataFrame([(1, "ab", True, "cd", [("cd", "ab", 1)], "python"), (2, "x", False, None, None, None)], SAMPLE)
    a = {r.sample_index: r for r in encode.seq2seq(s, length=4, target_length=4).collect()}
    assert a[1].input_ids == [100, 101, 1, 0] and a[1].labels == [102, 103, 1, -100] and a[2].labels == [123, 1, -100, -100]
    c = {r.sample_index: r for r in encode.causal_lm(s, length=80).collect()}
    assert c[1].labels.count(-100) == 80 - 3 and len(c[1].input_ids) == 80
    m = {r.sample_index: r for r in encode.masked_lm(s, length=10).collect()}
    assert bytes(i - 3 for i in m[1].input_ids if i > 2) == b"<mask>" and bytes(i - 3 for i in m[2].input_ids if i > 2) == b"x"


def test_ranks(spark):
    r = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1009)
    got = bucketed_rank(r, [F.floor(F.col("v") / 50)], [F.col("v")]).orderBy("v").collect()
    assert [x.ordinal for x in got] == list(range(1000))
    b = relational.batches(r.withColumnRenamed("id", "sample_index"), 10, seed=3)
    assert b.groupBy("batch").count().filter("count <> 10").count() == 0


def test_position_order_is_left_to_right(spark):
    before = spark.createDataFrame([(1, 1, 10, 1, "nmae")], "sample_index long, line int, col int, ordinal int, name string")
    after = spark.createDataFrame([(1, 1, 7, 1, "left"), (1, 1, 10, 2, "name"), (1, 1, 16, 3, "far")], "sample_index long, line int, col int, ordinal int, name string")
    assert relational.position_diff(before, after).first().fixed == "left"


def test_stream(spark, built, tmp_path):
    sinks.write_samples(built.select(*SAMPLE.names), str(tmp_path / "in"))
    s = stream.read_sample_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    q = stream.append_results(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = stream.running_totals(spark, str(tmp_path / "out")).agg(F.sum("n").alias("n"), F.sum("exact").alias("e")).first()
    assert (last.n, last.e) == (built.filter("has_errors").count(), 0)
    q = stream.counted(stream.read_sample_stream(spark, str(tmp_path / "in")), "counted")
    q.awaitTermination()
    assert spark.table("counted").count() == 2
