"""Subwords of a given vocabulary: every distinct word cut once by longest match, and sequences aligned with their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the longest piece that is looked up, without its prefix.
LONGEST = 16


def longest_pieces(words: DataFrame, vocab: DataFrame, *, word: str = "word", prefix: str = "##", unknown: int = 2, longest: int = LONGEST) -> DataFrame:
    """word, pieces: array<struct<start,size,idx>> of every distinct word, starts from 0.

    From the left, the longest piece of the vocabulary (piece, idx) is taken; within a word pieces carry the prefix.  A
    word that can't be cut to its end is one unknown piece.  All parts of `longest` characters or less meet the
    vocabulary by equality, so work follows the words' lengths; the walk is one pass over what was found, by start.
    """
    each = words.select(F.col(word).alias("word")).filter("word is not null and word <> ''").distinct()
    n = F.length("word")
    parts = each.withColumn("start", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start")))))
    part = F.substr("word", F.col("start") + 1, F.col("size"))
    keyed = parts.withColumn("piece", F.when(F.col("start") > 0, F.concat(F.lit(prefix), part)).otherwise(part))
    best = keyed.join(vocab.select("piece", "idx"), "piece").groupBy("word", "start").agg(F.max(F.struct("size", "idx")).alias("b"))
    found = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "b.size", "b.idx"))).alias("found"))
    none = F.array().cast("array<struct<start:int,size:int,idx:int>>")
    piece = lambda x: F.struct(x["start"].cast("int").alias("start"), x["size"].cast("int").alias("size"), x["idx"].cast("int").alias("idx"))
    walk = F.aggregate("found", F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.when(x["start"] == a["at"], F.struct((a["at"] + x["size"]).cast("int").alias("at"), F.array_append(a["out"], piece(x)).alias("out"))).otherwise(a))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("size"), F.lit(unknown).alias("idx")))
    return each.join(found, "word", "left").withColumn("w", walk).select("word", F.when(F.col("w.at") == n, F.col("w.out")).otherwise(whole).alias("pieces"))


def aligned(tokens: DataFrame, pieces: DataFrame, *, start: int = 0, end: int = 1, most: int = 512) -> DataFrame:
    """sample_index, pos, input_id, word_id, begin, stop: subwords of tokens (sample_index, pos, text) between a start and an end id.

    begin and stop are characters of the word.  The start and the end belong to no word; at most `most` ids are kept, the
    end among them.  A sample's subwords are numbered within it; empty tokens have none.
    """
    cut = tokens.select("sample_index", F.col("pos").alias("word_id"), "text").join(pieces, F.col("text") == F.col("word"))
    each = cut.select("sample_index", "word_id", F.posexplode("pieces").alias("k", "p"))
    order = Window.partitionBy("sample_index").orderBy("word_id", "k")
    inner = each.withColumn("pos", F.row_number().over(order).cast("int")).filter(F.col("pos") <= most - 2)
    inner = inner.select("sample_index", "pos", F.col("p.idx").alias("input_id"), "word_id", F.col("p.start").alias("begin"), (F.col("p.start") + F.col("p.size")).alias("stop"))
    last = tokens.select("sample_index").distinct().join(inner.groupBy("sample_index").agg(F.max("pos").alias("last")), "sample_index", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    bare = lambda pos, i: last.select("sample_index", pos.cast("int").alias("pos"), F.lit(i).alias("input_id"), *(F.lit(None).cast("int").alias(c) for c in ("word_id", "begin", "stop")))
    return bare(F.lit(0), start).unionByName(inner).unionByName(bare(F.col("last") + 1, end))
