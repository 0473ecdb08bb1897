"""Sinks: sample files, reports, benchmark records with a cache, vocabularies, charts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str, *, mode: str = "error") -> None:
    """JSON lines, nulls and non-ASCII kept, in order of sample_index over all files."""
    samples.repartitionByRange("sample_index").sortWithinPartitions("sample_index").write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(samples: DataFrame, path: str, *, mode: str = "error") -> None:
    """One folder of JSON lines for each split."""
    samples.write.mode(mode).partitionBy("split").option("ignoreNullFields", "false").json(path)


def single_split(samples: DataFrame) -> DataFrame:
    """The rows of the first split that has any, of test, validation, train."""
    for split in ("test", "validation", "train"):
        part = samples.filter(F.col("split") == split)
        if not part.isEmpty():
            return part
    return samples.limit(0)


def write_report(metrics: DataFrame, per_sample: DataFrame, path: str, *, mode: str = "error") -> None:
    """The metrics as one record, and the samples' results beside them as JSON lines."""
    metrics.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/metrics")
    per_sample.repartitionByRange("sample_index").sortWithinPartitions("sample_index").write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/per_sample")


def missing_runs(models: DataFrame, datasets: DataFrame, done: DataFrame, *, force: bool = False) -> DataFrame:
    """Pairs of a model and a dataset without a record (all pairs with force).  Both lists are short by nature."""
    pairs = models.select("model").distinct().crossJoin(F.broadcast(datasets.select("dataset").distinct()))
    return pairs if force else pairs.join(done.select("model", "dataset"), ["model", "dataset"], "left_anti")


def write_benchmarks(records: DataFrame, path: str) -> None:
    """One file for each dataset and model, with the last record by its time; a record that is there is replaced."""
    last = records.groupBy("dataset", "model").agg(F.max_by(F.struct(*records.columns), F.struct(F.coalesce("timestamp", F.lit("")), F.to_json(F.struct(*records.columns)))).alias("r")).select("r.*")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "model").option("ignoreNullFields", "false").json(path)


def write_vocab(vocab: DataFrame, path: str, *, mode: str = "error") -> None:
    """Tags by index, one a line."""
    vocab.coalesce(1).sortWithinPartitions("idx").select("tag").write.mode(mode).text(path)


def write_history(history: DataFrame, path: str) -> None:
    """Training history, one row for each epoch, rewritten as a whole."""
    history.coalesce(1).sortWithinPartitions("epoch").write.mode("overwrite").json(path)


def bar_chart(table: DataFrame, metric: str, path: str) -> None:
    """A bar chart (SVG) of a metric by model, a short list by nature."""
    rows = table.select("model", F.col(metric).cast("double").alias("v")).orderBy("model").collect()
    most = max([abs(r.v or 0.0) for r in rows] or [1.0]) or 1.0
    bars = "".join(
        f'<text x="0" y="{20 * i + 15}" font-size="12">{r.model}</text><rect x="160" y="{20 * i + 4}" height="14" width="{300 * abs(r.v or 0.0) / most:.1f}"/>' for i, r in enumerate(rows)
    )
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="480" height="{20 * len(rows) + 10}">{bars}</svg>')


def heat_map(table: DataFrame, path: str) -> None:
    """A heat map (SVG) of report.matrix(): models down, datasets across, darker for more, empty where there is no record."""
    rows = table.select("model", "dataset", F.col("value").cast("double").alias("v")).collect()
    models, datasets = sorted({r.model for r in rows}), sorted({r.dataset for r in rows})
    known = [r.v for r in rows if r.v is not None]
    low, high = min(known, default=0.0), max(known, default=0.0)
    out = [f'<text x="{170 + 60 * j}" y="14" font-size="11">{d}</text>' for j, d in enumerate(datasets)]
    out += [f'<text x="0" y="{40 + 24 * i}" font-size="11">{m}</text>' for i, m in enumerate(models)]
    for r in rows:
        x, y = 170 + 60 * datasets.index(r.dataset), 24 + 24 * models.index(r.model)
        if r.v is None:
            out.append(f'<rect x="{x}" y="{y}" width="56" height="22" fill="none" stroke="#999"/>')
        else:
            shade = (r.v - low) / (high - low) if high > low else 1.0
            out.append(f'<rect x="{x}" y="{y}" width="56" height="22" fill="#3366cc" fill-opacity="{0.1 + 0.9 * shade:.2f}"/><text x="{x + 4}" y="{y + 15}" font-size="10">{r.v:.3g}</text>')
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{180 + 60 * len(datasets)}" height="{34 + 24 * len(models)}">{"".join(out)}</svg>')
