"""Relational operators: filters, interval joins, similarity joins, windows, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import seeded
from .ranks import bucketed_rank, rank_by_id


def errors(samples: DataFrame) -> DataFrame:
    return samples.filter(F.coalesce("has_errors", F.lit(False)))


def clean(samples: DataFrame) -> DataFrame:
    return samples.filter(~F.coalesce("has_errors", F.lit(False)))


def trainable(samples: DataFrame, *, most_chars: int | None = None, prefix: str = "", include_clean: bool = False) -> DataFrame:
    """Samples with a target; a limit on the code's length and a task prefix if given."""
    out = samples if include_clean else errors(samples).filter(F.col("fixed") != "")
    if most_chars is not None:
        out = out.filter(F.length("code") <= most_chars)
    return out.withColumn("code", F.concat(F.lit(prefix), "code")) if prefix else out


def real_fixes(fixes: Column, names: Column | None = None) -> Column:
    """A map of fixes without those that change nothing and, if names are given, only for these."""
    out = F.map_filter(fixes, lambda k, v: k != v)
    return out if names is None else F.map_filter(out, lambda k, _: F.array_contains(names, k))


def search(samples: DataFrame, text: str) -> DataFrame:
    """Samples that contain a text, in any case, in their target, code or edit names."""
    names = F.array_join(F.transform("edits", lambda e: F.concat_ws(" ", e["original_name"], e["corrupted_name"])), " ")
    return samples.filter(F.lower(F.concat_ws(" ", "fixed", "code", names)).contains(text.lower()))


#: Reaches in a band of position_diff(): one row of `after` in BAND / 2 lies near a band's end and is in two.
BAND = 64


def position_diff(before: DataFrame, after: DataFrame, reach: int = 5) -> DataFrame:
    """For each name of `before` (sample, line, col, ordinal, name): the first different name of `after` on the same
    line within `reach` columns, tried from the left; of a name's positions the first with one wins.

    Both sides are dealt by bands of columns and sorted once; a row of `before` finds its own answer among its
    neighbours there, so that pairs are never rows: of every row one at most goes on to its name.
    """
    on, width = ["sample_index", "line"], BAND * reach + 1
    band = lambda x: F.floor(x / width)
    whole = F.col("sample_index").isNotNull() & F.col("line").isNotNull() & F.col("col").isNotNull() & F.col("name").isNotNull()
    a = before.filter(whole).select(*on, band(F.col("col")).alias("_band"), "col", F.col("name").alias("_a"), "ordinal", F.lit(None).cast("string").alias("_b"))
    bands = F.array_distinct(F.array(band(F.col("col") - reach), band(F.col("col") + reach)))
    b = after.filter(whole).select(*on, F.explode(bands).alias("_band"), "col", F.lit(None).cast("string").alias("_a"), F.lit(None).alias("ordinal"), F.col("name").alias("_b"))
    near = Window.partitionBy(*on, "_band").orderBy("col").rangeBetween(-reach, reach)
    seen = F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("col", "_b"))).over(near)
    found = a.unionByName(b).withColumn("_seen", seen).filter("_a is not null")
    best = F.array_min(F.filter("_seen", lambda x: x["_b"] != F.col("_a")))
    best = found.select("sample_index", F.col("_a").alias("corrupted"), "ordinal", "col", best.alias("_best")).filter("_best is not null")
    first = F.min_by("_best._b", F.struct("ordinal", F.col("_best.col") - F.col("col"), "_best._b"))
    return best.groupBy("sample_index", "corrupted").agg(first.alias("fixed"))


def deletion_keys(words: DataFrame, word: str = "word", most: int = 1) -> DataFrame:
    """words with key: a hash of each word, and of what is left of it after deleting up to `most` characters.

    Deletions are taken from left to right, and of equal letters in a row the first goes, so a string is made once: what
    is left stands as far right in the word as it can.
    """
    out = words.withColumn("_rest", F.col(word)).withColumn("_at", F.lit(0))
    for _ in range(most):
        places = F.when(F.col("_at") <= F.length("_rest"), F.sequence("_at", F.length("_rest")))  # 0: none
        out = out.withColumn("_at", F.explode(places))
        here, before = F.substr("_rest", F.col("_at"), F.lit(1)), F.substr("_rest", F.col("_at") - 1, F.lit(1))
        out = out.filter((F.col("_at") <= 1) | (here != before))
        shorter = F.concat(F.substr("_rest", F.lit(1), F.col("_at") - 1), F.substr("_rest", F.col("_at") + 1, F.length("_rest")))
        out = out.withColumn("_rest", F.when(F.col("_at") == 0, F.col("_rest")).otherwise(shorter))
    return out.withColumn("key", F.xxhash64("_rest")).drop("_rest", "_at")


#: Characters up to which a word has deletion neighbourhoods; pairs with a longer one meet by segments.
SHORT_WORD = 16


def _segment(length: Column, i: Column, most: int) -> tuple[Column, Column]:
    """(start from 0, size) of the i-th of most + 1 segments, the later ones longer by one where they don't divide evenly."""
    small, extra = F.floor(length / (most + 1)).cast("int"), length % (most + 1)
    wider = F.greatest(i - (most + 1 - extra), F.lit(0))
    return i * small + wider, small + F.when(i >= most + 1 - extra, 1).otherwise(0)


def segment_keys(words: DataFrame, word: str = "word", most: int = 2) -> DataFrame:
    """words with key: a hash of each of most + 1 segments, with its number and the word's length."""
    each = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    start, size = _segment(F.length(word), F.col("_i"), most)
    return each.withColumn("key", F.xxhash64(F.length(word), "_i", F.substr(word, start + 1, size))).drop("_i")


def window_keys(words: DataFrame, word: str = "word", most: int = 2, least: int = 1) -> DataFrame:
    """words with key: hashes of the parts that may be a segment of a word of `least` characters or more within `most` edits.

    most edits can't touch all of most + 1 segments, and the i-th segment that is untouched, with no more than i edits
    before it and most - i behind it, stands at one of few places.  Keys are as many for a word of any length.
    """
    n = F.length(word)
    sized = words.withColumn("_n", F.explode(F.filter(F.sequence(n - most, n + most), lambda x: x >= least)))
    each = sized.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    start, size = _segment(F.col("_n"), F.col("_i"), most)
    shift, before, behind = n - F.col("_n"), F.col("_i"), most - F.col("_i")
    low = F.greatest(F.lit(0), start - before, start + shift - behind)
    high = F.least(n - size, start + before, start + shift + behind)
    placed = each.withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high))))
    return placed.withColumn("key", F.xxhash64("_n", "_i", F.substr(word, F.col("_at") + 1, size))).drop("_n", "_i", "_at")


def spell_candidates(words: DataFrame, dictionary: DataFrame, most: int = 2, *, short: int = SHORT_WORD) -> DataFrame:
    """Pairs (word, candidate, distance, n) within `most` edits, for words that are not in the dictionary.

    Words meet by equality of keys, never by a product: two words of `short` characters or less by what is left of
    them after deleting up to `most` characters, which few others share; pairs with a longer word by segments, so
    that keys don't grow with its length.  The rows that meet are a key and 32 bits of the word each; pairs of these
    are made distinct, joined with their words, and verified.  Words with the same 32 bits are all tried, so none is
    lost or wrong.
    """
    # Both sides grow with the words, so no join may collect one in the driver for a broadcast.
    unknown = words.select("word").distinct().join(dictionary.select("word").hint("merge"), "word", "left_anti").withColumn("a", F.hash("word"))
    known = dictionary.select(F.col("word").alias("candidate"), "n", F.hash("word").alias("b"))
    of = lambda rows, name, least, up: rows.filter(F.length(name).between(least, up))
    met = None
    for make, make_other, least, up in (
        (deletion_keys, deletion_keys, 0, short),
        (lambda r, w, m: window_keys(r, w, m, short - most + 1), segment_keys, short - most + 1, 2**31 - 1),
    ):
        left = make(of(unknown, "word", least, up), "word", most).select("key", "a")
        right = make_other(of(known, "candidate", least, up), "candidate", most).select("key", "b")
        pairs = left.join(right.hint("merge"), "key").select("a", "b")
        met = pairs if met is None else met.unionByName(pairs)
    pairs = met.distinct().join(unknown.hint("merge"), "a").join(known.hint("merge"), "b").select("word", "candidate", "n", F.levenshtein("word", "candidate", most).alias("distance"))
    return pairs.filter("distance >= 0")


def best_candidate(pairs: DataFrame) -> DataFrame:
    """The nearest candidate of each word; of equals the most frequent, then the first by name."""
    return pairs.groupBy("word").agg(F.min_by("candidate", F.struct("distance", -F.col("n"), "candidate")).alias("candidate"))


def first_subword(subwords: DataFrame) -> DataFrame:
    """Marks the first subword of each word of a sample; a null word is never first."""
    w = Window.partitionBy("sample_index", "word_id").orderBy("pos")
    return subwords.withColumn("is_first", F.col("word_id").isNotNull() & (F.row_number().over(w) == 1))


def merged_fixes(fixes: DataFrame) -> DataFrame:
    """The fix of the last iteration for each name."""
    return fixes.groupBy("sample_index", "corrupted").agg(F.max_by("fixed", "iteration").alias("fixed"))


def since(results: DataFrame, seq: int, by: str = "seq") -> DataFrame:
    return results.filter(F.col(by) >= seq)


def running_mean(results: DataFrame, value: str, by: str, partition: str) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return results.withColumn("running", F.avg(value).over(w))


def first_errors(samples: DataFrame, n: int) -> DataFrame:
    """All clean samples and the first n with errors."""
    return clean(samples).unionByName(errors(samples).orderBy("sample_index").limit(n))


def random_rows(rows: DataFrame, n: int, *, seed: int = 42, by: str = "sample_index") -> DataFrame:
    """n rows by seeded order."""
    return rows.orderBy(seeded(seed, F.col(by)), by).limit(n)


def best_epoch(history: DataFrame, loss: str = "val_loss") -> DataFrame:
    """The epoch of least loss; of equals the earliest."""
    return history.agg(F.min(F.struct(loss, "epoch")).alias("best")).select("best.*")


def model_order(models: DataFrame, baselines: tuple[str, ...]) -> DataFrame:
    at = F.coalesce(*(F.when(F.col("model") == b, F.lit(i)) for i, b in enumerate(baselines)), F.lit(len(baselines)))
    return models.withColumn("rank", F.row_number().over(Window.orderBy(at, "model")))


def batches(rows: DataFrame, size: int, *, seed: int | None = None, by: str = "sample_index") -> DataFrame:
    """rows with a batch number: by id, or in seeded order."""
    if seed is None:
        ranked = rank_by_id(rows, by, "_rank")
    else:
        key = seeded(seed, F.col(by))
        ranked = bucketed_rank(rows, [F.shiftright(key, 20)], [key, F.col(by)], "_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")


def pad_batches(rows: DataFrame, ids: str, pad: int) -> DataFrame:
    """ids padded on the right to the longest of each batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    return rows.withColumn("length", longest).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("length") - F.size(ids)))).drop("length")
