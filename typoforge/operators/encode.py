"""Encoders: samples to token ids and labels as array columns.

The relational ones (tagger labels, padding) are Column expressions and joins.  The byte-level encoders stand in
for subword models: any function from text to ids can be given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import IGNORED_LABEL, LM_PREFIX, LM_SUFFIX
from ..functions.text import mask_names, target

PAD, END = 0, 1


def byte_ids(text: str) -> list[int]:
    """UTF-8 bytes, moved up by 3 (0 pads, 1 ends, 2 is unknown)."""
    return [b + 3 for b in text.encode()]


def _pad(ids: list[int], length: int, pad: int) -> list[int]:
    return ids[:length] + [pad] * (length - len(ids))


ENCODED = "sample_index long, input_ids array<int>, attention_mask array<int>, labels array<int>"


def _encoder(row: Callable[[str, str], tuple[list[int], list[int]]], length: int, target_length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [row(c, t) for c, t in zip(b["code"], b["target"], strict=True)]
            yield pd.DataFrame(
                {
                    "sample_index": b["sample_index"],
                    "input_ids": [_pad(x, length, PAD) for x, _ in made],
                    "attention_mask": [_pad([1] * min(len(x), length), length, 0) for x, _ in made],
                    "labels": [_pad(y, target_length, IGNORED_LABEL) for _, y in made],
                }
            )

    return run


def seq2seq(samples: DataFrame, *, length: int = 512, target_length: int = 512, ids: Callable[[str], list[int]] = byte_ids, prefix: str = "") -> DataFrame:
    """Source and target ids of fixed lengths; label padding is ignored in the loss."""
    row = lambda c, t: ([*ids(prefix + c)[: length - 1], END], [*ids(t)[: target_length - 1], END])
    return samples.select("sample_index", "code", target(F.col("fixed"), F.col("code")).alias("target")).mapInPandas(_encoder(row, length, target_length), ENCODED)


def causal_lm(samples: DataFrame, *, length: int = 1024, ids: Callable[[str], list[int]] = byte_ids, begin: int | None = None) -> DataFrame:
    """Prompt and target in one sequence, after a begin id if the model has one; the prompt and the padding are masked in the labels."""

    def row(code: str, goal: str) -> tuple[list[int], list[int]]:
        prompt = [*([] if begin is None else [begin]), *ids(LM_PREFIX + code + LM_SUFFIX)]
        whole = [*prompt, *ids(goal), END][:length]
        hidden = min(len(prompt), length)
        return whole, [IGNORED_LABEL] * hidden + whole[hidden:]

    return samples.select("sample_index", "code", target(F.col("fixed"), F.col("code")).alias("target")).mapInPandas(_encoder(row, length, length), ENCODED)


def masked_lm(samples: DataFrame, *, mask: str = "<mask>", length: int = 512, ids: Callable[[str], list[int]] = byte_ids) -> DataFrame:
    """Code with its corrupted names masked, against the target."""
    names = F.transform(F.coalesce("edits", F.array().cast(samples.schema["edits"].dataType)), lambda e: e["corrupted_name"])
    masked = samples.select("sample_index", mask_names(F.col("code"), names, mask).alias("code"), target(F.col("fixed"), F.col("code")).alias("target"))
    row = lambda c, t: ([*ids(c)[: length - 1], END], [*ids(t)[: length - 1], END])
    return masked.mapInPandas(_encoder(row, length, length), ENCODED)


def token_labels(tokens: DataFrame, edits: DataFrame, vocab: DataFrame, tag: Column, keep: int = 0, unknown: int = 2) -> DataFrame:
    """tokens (sample_index, pos, text, is_name) with the index of their tag.

    Name tokens that an edit lists get its tag's index (unknown if the vocabulary has none), all others keep.
    edits has sample_index, corrupted and the columns of `tag`; of several the last by a column position counts, or
    without one the greatest tag.
    """
    last = F.max_by(tag, "position") if "position" in edits.columns else F.max(tag)
    tagged = edits.groupBy("sample_index", F.col("corrupted").alias("text")).agg(last.alias("tag"))
    indexed = tagged.join(vocab, "tag", "left").select("sample_index", "text", F.coalesce("idx", F.lit(unknown)).alias("edit_idx"))
    return tokens.join(indexed, ["sample_index", "text"], "left").withColumn("label", F.when(F.col("is_name"), F.coalesce("edit_idx", F.lit(keep))).otherwise(F.lit(keep))).drop("edit_idx")


def subword_labels(subwords: DataFrame, labels: DataFrame, ignored: int = IGNORED_LABEL) -> DataFrame:
    """subwords (sample_index, pos, word_id, is_first) with their word's label on the first and ignored elsewhere."""
    words = labels.select("sample_index", F.col("pos").alias("word_id"), "label")
    return subwords.join(words, ["sample_index", "word_id"], "left").withColumn("label", F.when(F.col("is_first"), F.coalesce("label", F.lit(ignored))).otherwise(F.lit(ignored)))


def tagger(samples: DataFrame, vocab: DataFrame, *, char_edit: bool, ids: Callable[[str], list[int]] = byte_ids, start: int = 0, end: int = 1, length: int = 512, ignored: int = IGNORED_LABEL, keep: int = 0, unknown: int = 2) -> DataFrame:
    """sample_index, input_ids, attention_mask, tag_labels, detect_labels, raw_code, raw_fixed of samples.

    Name tokens that an edit lists get its tag's index (unknown if the vocabulary lacks it) and detection 1, other
    tokens keep and 0, both on their first subword; other subwords, start and end are ignored.  A source without tokens
    is start and end only, with empty raw texts.  The last edit of a name counts.
    """
    from ..plans.analyze import marked_subwords
    from .vocab import edit_tag

    e = samples.select("sample_index", F.posexplode(F.coalesce("edits", F.array().cast(samples.schema["edits"].dataType))).alias("position", "e"))
    edits = e.select("sample_index", "position", F.col("e.corrupted_name").alias("corrupted"), F.col("e.original_name").alias("original")).filter("corrupted <> '' and original <> ''")
    tag = F.coalesce(edit_tag(F.col("corrupted"), F.col("original"), char_edit), F.lit(""))
    tagged = edits.groupBy("sample_index", "corrupted").agg(F.max_by(tag, "position").alias("tag"))
    indexed = tagged.join(vocab, "tag", "left").select("sample_index", F.struct("corrupted", F.coalesce("idx", F.lit(unknown)).alias("idx")).alias("x"))
    # A source's few edits come to it as a map; its tokens and subwords never leave it.
    known = indexed.groupBy("sample_index").agg(F.map_from_entries(F.collect_list("x")).alias("tags"))
    rows = samples.select("sample_index", "code", "fixed").join(known, "sample_index", "left").withColumn("r", marked_subwords("code", ids=ids, start=start, end=end, most=length))
    index = lambda x: F.try_element_at("tags", x["name"])
    first = lambda make: F.transform("r", lambda x: F.when(x["name"].isNull(), F.lit(ignored)).otherwise(make(x)))
    text = lambda c: F.when(F.exists("r", lambda x: x["name"].isNotNull()), c).otherwise(F.lit(""))
    return rows.select(
        "sample_index", F.transform("r", lambda x: x["input_id"]).alias("input_ids"), F.transform("r", lambda x: F.lit(1)).alias("attention_mask"),
        first(lambda x: F.coalesce(index(x), F.lit(keep))).alias("tag_labels"), first(lambda x: index(x).isNotNull().cast("int")).alias("detect_labels"),
        text(F.col("code")).alias("raw_code"), text(target(F.col("fixed"), F.col("code"))).alias("raw_fixed"),
    )


def collated(items: DataFrame, size: int, *, pad: int = PAD, ignored: int = IGNORED_LABEL) -> DataFrame:
    """items of tagger() in batches of `size` by sample_index, each array filled up to its batch's longest; raw texts stay."""
    from ..functions.text import padded
    from .ranks import rank_by_id

    ranked = rank_by_id(items, "sample_index").withColumn("batch", F.floor(F.col("ordinal") / size)).drop("ordinal")
    longest = ranked.groupBy("batch").agg(F.max(F.size("input_ids")).alias("longest"))
    fill = {"input_ids": pad, "attention_mask": 0, "tag_labels": ignored, "detect_labels": ignored}
    return ranked.join(longest, "batch").withColumns({c: padded(F.col(c), F.col("longest"), F.lit(k)) for c, k in fill.items()}).drop("longest")
