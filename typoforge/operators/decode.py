"""Decoding an edit tagger's logits: subwords to words, words to tags, tags to edits of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import text as X
from .relational import first_subword
from .vocab import to_tag


def word_scores(scored: DataFrame) -> DataFrame:
    """sample_index, pos (of the word), idx, p_detect: the best tag and the chance of an error at each word's first subword.

    scored has sample_index, pos, word_id (null: none), tag_logits, detect_logits (right, wrong); of equal logits the
    first tag counts.
    """
    first = first_subword(scored.filter("word_id is not null")).filter("is_first")
    return first.select("sample_index", F.col("word_id").alias("pos"), X.argmax(F.col("tag_logits")).alias("idx"), F.get(X.softmax(F.col("detect_logits")), F.lit(1)).alias("p_detect"))


def decoded_tags(tokens: DataFrame, scored: DataFrame, vocab: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """tokens (sample_index, pos, text, ...) with tag and p_detect.

    Words behind the cut of a long source have no subword: they keep, with chance 0.  Replacements that are less likely
    an error than the threshold keep too; character edits aren't gated.
    """
    seen = tokens.join(word_scores(scored), ["sample_index", "pos"], "left").withColumns({"idx": F.coalesce("idx", F.lit(0)), "p_detect": F.coalesce("p_detect", F.lit(0.0))})
    return to_tag(seen, vocab).withColumn("tag", E.gated_tag(F.col("tag"), F.col("p_detect"), threshold)).drop("idx")


def edited(text: Column, tag: Column) -> Column:
    """A name after its tag: a replacement or a character edit; any other tag, and one that doesn't fit, leaves it."""
    new = F.when(E.is_replace_tag(tag), E.replacement(tag)).when(E.is_char_edit(tag), E.apply_char_edit(text, tag))
    return F.coalesce(new, text)


def decoded_edits(tokens: DataFrame, scored: DataFrame, vocab: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """sample_index, pos, text, new and the other columns of tokens, of the name tokens that a tag changes."""
    names = decoded_tags(tokens.filter("is_name"), scored, vocab, threshold=threshold)
    return names.withColumn("new", edited(F.col("text"), F.col("tag"))).filter("new <> text and new <> ''").drop("tag", "p_detect")


__all__ = ["decoded_edits", "decoded_tags", "edited", "word_scores"]
