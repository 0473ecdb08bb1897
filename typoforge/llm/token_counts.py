"""Operator 3, token counts of whole texts without materialising ids.

1. Every text is cut into exact pre-tokens (runs of spaces with what follows; line feeds alone).  Tasks
   count their distinct pre-tokens, a shuffle brings equal ones together, and the library counts the
   pieces of each distinct pre-token once.
2. Per-document pre-token frequencies are joined with these counts.  The most frequent pre-tokens, at most
   HOT_MOST by a threshold read off a histogram of counts, so at most HOT_MOST * HOT_BYTES bytes, are
   broadcast and joined inside the scan; what remains (the long tail, spread evenly) is written once and
   joined by a shuffle.  The sums never see an id.

Skew: frequent pre-tokens never reach the shuffle, so no key of the join is hot; the first shuffle carries
one row a task and distinct pre-token.  Defined cases: a null or empty text has 0 bytes and tokens; rows that
repeat give a row each; special strings in a text are ordinary text, as in the library; other columns are
ignored, whatever their names; an empty table gives an empty result; a very long text is a step of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_arrow, owner, steps, store
from .vocab import PIECES, fragments, piece_ids, pieces

HOT_MOST = 1 << 17
HOT_BYTES = 64
STEP = 6_000_000


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task with counts; partial results go out whenever they grow large."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held).group_by("frag").aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([t["frag"].combine_chunks(), t["n_sum"].combine_chunks()], names=["frag", "n"])

    for rows, _, _ in steps(batches, most=STEP):
        made, _ = fragments(pc.replace_substring(column(rows, "text"), "▁", " "))
        vc = made.value_counts()
        held.append(pa.RecordBatch.from_arrays([vc.field("values"), vc.field("counts")], names=["frag", "n"]))
        size += len(vc)
        if size > 2_000_000:
            held = [out()]
            size = held[0].num_rows
            if size > 1_000_000:
                yield from (held[0].slice(i, 50_000) for i in range(0, size, 50_000))
                held, size = [], 0
    if held:
        last = out()
        yield from (last.slice(i, 50_000) for i in range(0, last.num_rows, 50_000))


def pre_tokens(texts: DataFrame, *, model: str = PIECES) -> DataFrame:
    """frag, n (occurrences in all texts), pieces (of one occurrence): each distinct pre-token encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        for b in batches:
            ids = piece_ids(sp, column(b, "frag").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.fromiter(map(len, ids), np.int32, len(ids)))], names=["frag", "n", "pieces"])

    whole = map_arrow(texts.select("text"), _distinct, "frag string, n long").groupBy("frag").agg(F.sum("n").alias("n"))
    return store(whole.mapInArrow(count, "frag string, n long, pieces int"), "pre-tokens")


def _hot(table: DataFrame, most: int, longest: int) -> pa.Table:
    """The most frequent short pre-tokens, at most `most`: those over the least power of two that leaves so few."""
    short = table.filter(F.octet_length("frag") <= longest)
    by = {r.b: r.n for r in short.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for b in sorted(by, reverse=True):
        if total + by[b] > most:
            break
        least, total = b, total + by[b]
    return short.filter(F.col("n") >= F.lit(2.0) ** least).select("frag", "pieces").toArrow()


def count_tokens(docs: DataFrame, *, model: str = PIECES, id_col: str = "doc_id", text_col: str = "text", hot_most: int = HOT_MOST) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    table = pre_tokens(rows, model=model)
    hot = spark.sparkContext.broadcast(_hot(table, hot_most, HOT_BYTES))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, known long, rest array<struct<frag:string,n:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value["frag"].combine_chunks() if hot.value.num_rows else pa.array([], pa.string())
        size = np.append(hot.value["pieces"].to_numpy().astype(np.int64), 0)
        for rows, _, off in steps(batches, most=STEP):
            made, frag_off = fragments(pc.replace_substring(column(rows, "text"), "▁", " "))
            enc = made.dictionary_encode()
            at = pc.fill_null(pc.index_in(enc.dictionary, value_set=known), len(size) - 1).to_numpy(zero_copy_only=False)
            idx = enc.indices.to_numpy()
            word_hot = at[idx]
            total = np.concatenate([[0], np.cumsum(size[word_hot])])
            miss = np.flatnonzero(word_hot == len(size) - 1)
            doc = owner(frag_off)[miss]
            pair, n = np.unique(doc * len(enc.dictionary) + idx[miss], return_counts=True) if len(miss) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            d, w = np.divmod(pair, max(len(enc.dictionary), 1))
            entries = pa.StructArray.from_arrays([enc.dictionary.take(pa.array(w)), pa.array(n.astype(np.int64))], ["frag", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(rows.num_rows + 1)).astype(np.int32)), entries)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(np.diff(off)), pa.array(total[frag_off[1:]] - total[frag_off[:-1]]), lists], names=["doc_id", "n_bytes", "known", "rest"])

    scanned = store(map_arrow(rows, scan, schema).withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rest = (
        scanned.select("row", F.explode("rest").alias("r"))
        .select("row", "r.frag", "r.n")
        .join(table.select("frag", "pieces"), "frag")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    return scanned.join(rest, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def count_digest(docs: DataFrame, *, limit: int = 4096, **options) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(docs, **options).withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["count_digest", "count_tokens", "pre_tokens"]
