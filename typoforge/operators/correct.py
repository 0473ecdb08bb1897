"""Known misspellings in whole texts: words of a text, comments and strings included, replaced in place."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import WORD_PIECE, restore_case
from ..session import written

#: Entries of a misspelling table that is broadcast; a larger one is joined by a shuffle of the texts' distinct words.
BROADCAST_MOST = 200_000
DONE = pa.struct([("text", pa.string()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("old", pa.string()), ("new", pa.string())])))])


def corrections(table: DataFrame, word: str = "word", correction: str = "correction") -> DataFrame:
    """word (lower case), fix: one correction of each known misspelling, the least of several; none that changes nothing."""
    known = table.select(F.lower(word).alias("word"), F.col(correction).alias("fix")).filter("word is not null and fix is not null and word <> lower(fix)")
    return known.groupBy("word").agg(F.min("fix").alias("fix"))


def corrected(texts: DataFrame, table: DataFrame, *, by: str = "sample_index", text: str = "code", pattern: str = WORD_PIECE, most: int = BROADCAST_MOST) -> DataFrame:
    """texts with `text` corrected and a column edits: array<struct<start,old,new>>, in order, starts in the old text (from 0).

    A text's distinct words meet the table by equality and take the case of what they replace there, once each, so that
    only words which change come back to it, as a short list; then one pass over the text replaces them, and its work
    follows the text's length.  Replacements don't overlap, as words don't.  A null text stays null.
    """
    known = written(corrections(table), "corrections")  # counted and joined: worked out once
    if known.limit(most + 1).count() <= most:
        known = F.broadcast(known)
    each = texts.select(by, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("_old")).withColumn("word", F.lower("_old"))
    met = each.join(known, "word").select(by, "_old", restore_case(F.col("_old"), F.col("fix")).alias("_new")).filter("_old <> _new")
    found = met.groupBy(F.col(by).alias("_by")).agg(F.collect_set(F.struct("_old", "_new")).alias("_fixes"))
    rows = texts.join(found, texts[by].eqNullSafe(F.col("_by")), "left")
    hit = F.col("_fixes").isNotNull()
    # Texts that nothing changes aren't sent to Python.
    rows = rows.withColumn("_done", _replacer(pattern)(F.when(hit, F.col(text)), F.col("_fixes._old"), F.col("_fixes._new")))
    none = F.array().cast("array<struct<start:int,old:string,new:string>>")
    done = rows.withColumn("edits", F.when(hit, F.col("_done.edits")).otherwise(none)).withColumn(text, F.when(hit, F.col("_done.text")).otherwise(F.col(text)))
    return done.select(*texts.columns, "edits")


def replaced(text: str, pattern: re.Pattern, fixes: dict[str, str]) -> tuple[str, list[dict]]:
    """text with the words (pattern) that fixes has replaced, and these edits."""
    edits = [{"start": m.start(), "old": m[0], "new": fixes[m[0]]} for m in pattern.finditer(text) if m[0] in fixes]
    ends = [0, *(e["start"] + len(e["old"]) for e in edits)]
    parts = [text[end : e["start"]] + e["new"] for end, e in zip(ends, edits)]
    return "".join(parts) + text[ends[-1] :], edits


def _replacer(pattern: str):
    """replaced() of columns: texts, and the old and new words of each."""
    compiled = re.compile(pattern)

    def apply(texts: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
        made = (None if t is None else replaced(t, compiled, dict(zip(o, n))) for t, o, n in zip(*(c.to_pylist() for c in (texts, old, new))))
        return pa.array([m and {"text": m[0], "edits": m[1]} for m in made], type=DONE)

    return F.arrow_udf(apply, "text string, edits array<struct<start:int,old:string,new:string>>")
