"""Running totals of fixer runs as results arrive: state for each run, exactly-once output, polled from a cursor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A sample's result: which run it is of, whether its code is right, and its names' counts.
RESULT = "run string, sample_index long, exact boolean, tp long, fp long, fn long"
#: Totals after each batch that had results of a run; seq counts these from 1, so a reader asks for what is behind its last.
TOTALS = "run string, seq long, n long, exact long, tp long, fp long, fn long"
_SUMS = ("n", "exact", "tp", "fp", "fn")


class RunTotals(StatefulProcessor):
    """One value state a run: a counter and five sums, whatever the number of its samples."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "seq long, " + ", ".join(f"{c} long" for c in _SUMS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, *sums = self.totals.get() if self.totals.exists() else (0,) * (1 + len(_SUMS))
        for part in rows:
            sums[0] += len(part)
            for i, c in enumerate(_SUMS[1:], 1):
                sums[i] += int(part[c].fillna(0).sum())
        self.totals.update((seq + 1, *sums))
        yield pd.DataFrame([(key[0], seq + 1, *sums)], columns=["run", "seq", *_SUMS])

    def close(self) -> None:
        pass


def summed_by_batch(results: DataFrame) -> DataFrame:
    """results (RESULT), a null run as the run "unknown"; other columns are left out."""
    return results.select(F.coalesce("run", F.lit("unknown")).alias("run"), "exact", "tp", "fp", "fn")


def run_totals(results: DataFrame) -> DataFrame:
    """A stream of TOTALS from a stream of RESULT."""
    conf = results.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return summed_by_batch(results).groupBy("run").transformWithStateInPandas(RunTotals(), outputStructType=TOTALS, outputMode="append", timeMode="none")


def read_result_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of results in a folder."""
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def keep_totals(results: DataFrame, folder: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append run_totals() as Parquet: the file sink and the state are committed by batch, so a restart repeats nothing."""
    writer = run_totals(results).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def rates(totals: DataFrame) -> DataFrame:
    """totals with exact_rate (percent), precision, recall and f1; a ratio over nothing is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return totals.withColumns({"exact_rate": ratio(100.0 * F.col("exact"), F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2 * tp + fp + fn)})


def poll(spark: SparkSession, folder: str, after: dict[str, int] | None = None) -> DataFrame:
    """rates() of the totals behind a reader's cursor: for each run the last seq it has seen (all of runs it doesn't know)."""
    rows = spark.read.schema(TOTALS).parquet(folder)
    seen = F.create_map(*(F.lit(x) for kv in (after or {}).items() for x in kv)) if after else None
    return rates(rows if seen is None else rows.filter(F.col("seq") > F.coalesce(F.try_element_at(seen, F.col("run")), F.lit(0))))
