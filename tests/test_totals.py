"""Stateful totals: equal to a batch's whatever the batches and restarts."""

import json
import random

from pyspark.sql import functions as F

from typoforge.streaming import totals


def results(n, seed=1):
    r = random.Random(seed)
    return [{"run": r.choice(["a", "b", None]), "sample_index": i, "exact": r.choice([True, False, None]), "tp": r.randint(0, 3), "fp": r.choice([0, 1, None]), "fn": r.randint(0, 2), "extra": "x"} for i in range(n)]


def write(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def whole(rows):
    out = {}
    for r in rows:
        t = out.setdefault(r["run"] or "unknown", [0] * 5)
        for i, x in enumerate((1, r["exact"], r["tp"], r["fp"], r["fn"])):
            t[i] += int(x or 0)
    return {k: tuple(v) for k, v in out.items()}


def last(spark, out):
    rows = spark.read.parquet(out).collect()
    return {r.run: (r.n, r.exact, r.tp, r.fp, r.fn) for r in sorted(rows, key=lambda r: r.seq)}, rows


def test_totals_go_on_after_a_restart(spark, tmp_path):
    rows = results(90)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in range(3):
            write(folder, k, rows[k * 20 : k * 20 + 20])
        totals.keep_totals(totals.read_result_stream(spark, str(folder), files_per_batch=1), out, checkpoint).awaitTermination()
        now, written = last(spark, out)
        assert now == whole(rows[:60])
        assert all(sorted(r.seq for r in written if r.run == k) == list(range(1, 4)) for k in now)  # one row a batch
        totals.keep_totals(totals.read_result_stream(spark, str(folder)), out, checkpoint).awaitTermination()
        assert last(spark, out)[0] == now and len(last(spark, out)[1]) == len(written)  # nothing new, nothing again
        write(folder, 3, rows[60:])
        totals.keep_totals(totals.read_result_stream(spark, str(folder)), out, checkpoint).awaitTermination()
        assert last(spark, out)[0] == whole(rows)
        polled = totals.poll(spark, out, {"a": 3, "b": 2}).collect()
        assert sorted((r.run, r.seq) for r in polled) == [("a", 4), ("b", 3), ("b", 4), *[("unknown", k) for k in range(1, 5)]]
        assert totals.poll(spark, out).count() == 12
        a = next(r for r in polled if r.run == "a")
        assert abs(a.f1 - 2 * a.tp / (2 * a.tp + a.fp + a.fn)) < 1e-12 and abs(a.exact_rate - 100 * a.exact / a.n) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rates_of_nothing(spark):
    r = totals.rates(spark.createDataFrame([("a", 1, 0, 0, 0, 0, 0)], totals.TOTALS)).first()
    assert (r.exact_rate, r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0, 0.0)
    assert totals.summed_by_batch(spark.createDataFrame([(None, 1, None, 1, 1, 1)], totals.RESULT)).filter(F.col("run") == "unknown").count() == 1
