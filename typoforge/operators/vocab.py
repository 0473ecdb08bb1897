"""Tag vocabularies: tables of (idx, tag), their builders, and lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import bucketed_rank
from ..functions.edits import char_edit_tag, replace_tag
from ..fixed import CASE, DEL, EDIT_ALPHABET, INS, MAX_POSITION, REPLACE, SPECIAL_TAGS, SUB, SWAP


def specials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPECIAL_TAGS)), "idx int, tag string")


def correction_counts(samples: DataFrame) -> DataFrame:
    """name, n: how often each non-empty name is the target of an edit of an error sample."""
    edits = samples.filter(F.coalesce("has_errors", F.lit(False))).select(F.explode("edits").alias("e"))
    return edits.select(F.col("e.original_name").alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def replace_vocab(counts: DataFrame, *, min_freq: int = 1, top_k: int | None = None) -> DataFrame:
    """Specials, then replacement tags by descending count and name.

    Ranks come from buckets of equal counts and first characters, so no task holds all names.
    """
    often = counts.filter(F.col("n") >= min_freq)
    if top_k is not None:
        often = often.orderBy(F.desc("n"), "name").limit(top_k)
    ranked = bucketed_rank(often, [-F.col("n"), F.substring("name", 1, 2)], [F.col("name")], "rank").withColumn("idx", (F.col("rank") + len(SPECIAL_TAGS)).cast("int"))
    return specials(counts.sparkSession).unionByName(ranked.select("idx", F.concat(F.lit(REPLACE), "name").alias("tag")))


def char_edit_vocab(spark: SparkSession, positions: int = MAX_POSITION, alphabet: str = EDIT_ALPHABET) -> DataFrame:
    """Specials, then SWAP, DEL, INS (one position more), SUB, CASE over all positions and characters."""
    k = len(alphabet)
    char = lambda i: F.substr(F.lit(alphabet), (i + 1).cast("int"), F.lit(1))
    out, at = specials(spark), len(SPECIAL_TAGS)
    for prefix, n, lettered in ((SWAP, positions, False), (DEL, positions, False), (INS, positions + 1, True), (SUB, positions, True), (CASE, positions, False)):
        size = n * k if lettered else n
        i = F.col("id")
        tag = F.concat(F.lit(prefix), F.floor(i / k).cast("string"), F.lit("_"), char(i % k)) if lettered else F.concat(F.lit(prefix), i.cast("string"))
        out = out.unionByName(spark.range(size).select((i + at).cast("int").alias("idx"), tag.alias("tag")))
        at += size
    return out


def is_char_edit_vocab(vocab: DataFrame) -> bool:
    """Whether one of the first 50 tags is a swap."""
    return not vocab.filter((F.col("idx") < 50) & F.col("tag").startswith(SWAP)).isEmpty()


def edit_tag(corrupted: Column, original: Column, char_edit: bool) -> Column:
    """The tag of an edit in a vocabulary of that mode: a character edit (null if there is none), or the replacement."""
    return char_edit_tag(corrupted, original) if char_edit else replace_tag(original)


def to_index(tags: DataFrame, vocab: DataFrame, tag: str = "tag", unknown: int = 2) -> DataFrame:
    """tags with idx: that of its tag, or the unknown one's.  Vocabularies are small dimensions; the join decides how."""
    return tags.join(vocab.select(F.col("tag").alias(tag), F.col("idx")), tag, "left").withColumn("idx", F.coalesce("idx", F.lit(unknown)))


def to_tag(indexes: DataFrame, vocab: DataFrame, idx: str = "idx", unknown: str = SPECIAL_TAGS[2]) -> DataFrame:
    return indexes.join(vocab.select(F.col("idx").alias(idx), "tag"), idx, "left").withColumn("tag", F.coalesce("tag", F.lit(unknown)))
