"""Global ranks and running sums without putting all rows into one task.

Rows are dealt into ordered buckets; one small row a bucket is summed up in order, and ranks inside a bucket
start at its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(rows: DataFrame, buckets: list[Column], inside: list[Column], name: str = "ordinal") -> DataFrame:
    """rows with their rank from 0, in order of the bucket expressions and then of `inside`.

    The order of the bucket expressions must agree with the order that is wanted over all rows.
    """
    keys = [f"_b{i}" for i in range(len(buckets))]
    dealt = rows.withColumns(dict(zip(keys, buckets, strict=True)))
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(k).alias(f"_o{k}") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys]
    ranked = dealt.join(offsets, on).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*inside)) - 1)
    return ranked.drop(*keys, *(f"_o{k}" for k in keys), "_before")


def rank_by_id(rows: DataFrame, by: str, name: str = "ordinal", width: int = 10_000) -> DataFrame:
    """rows with their rank by a whole-number id."""
    return bucketed_rank(rows, [F.floor(F.col(by) / width)], [F.col(by)], name)
