"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir; a temporary one only where there are no other machines."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.gettempdir()
    return f"{path.rstrip('/')}/typoforge"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, so that every use reads the same rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for f in frames:
        where = f.sparkSession._jvm.org.apache.hadoop.fs.Path(f.written_at)
        where.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt over all cores by a key, or in turn: rows that cost much for their size may all lie in one small file, so in one task.

    The number of partitions is given, so that no coalescing by bytes takes it back.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by)


def make_session(name: str = "typoforge", master: str | None = None, **settings: str) -> SparkSession:
    """A session; further settings as keywords with dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
