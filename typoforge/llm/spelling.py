"""Operator 12, spelling variants: words one edit apart, grouped under their most frequent form.

1. Words.  Maximal runs of Latin letters (A-Z and U+00C0 to U+00FF) are counted in every task and summed by a shuffle
   of one row for each task and distinct word.
2. Keys.  A word and each of its forms without one character get an integer key: prefix and suffix sums of a
   polynomial over its characters give all of a batch's keys as array operations, without making the strings.
3. Meeting.  Rows (key, place of the deletion, word, n) are dealt by the keys' high bits and sorted, so equal keys stand
   side by side and are taken as segments of arrays.  Equal keys are verified on the shortened strings themselves.
   Words with the same key and place differ by a replacement; a word that is another one's shortened form differs by an
   insertion.  No pair is made within the first kind: a row learns the size of its segment and the best of the others,
   which is the segment's first or second row; pairs of the second kind are at most as many as keys.
4. Each word's partial results are aggregated, and forms are followed to their ends by doubling: a form has `ratio`
   times the occurrences, so paths are short.

Skew: frequent words are counted before the shuffle; keys are of distinct words, and a segment has no more rows than
the letters allow for one place of one string.

Defined cases: a null or empty text has no words; rows that repeat count each; a null doc_id is written null in the
draw of op12_spelling_variants; other columns are ignored, whatever their names; an empty table gives an empty result;
a very long text is a step of its own, and a very long
word's keys meet without the word, so that its cost follows its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, U64, column, forget, map_arrow, mix, owner, powers, ragged, steps, store, text_bytes, words

#: The least number of characters and occurrences of a word; how many times as frequent a form is.
LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
#: One in so many runs loses a character, as the contract's draw says.
DRAW = 199
STEP = 6_000_000
#: Distinct words that a task sums up before it lets them go.
HELD = 1_000_000

#: Characters up to which a word stands beside each of its keys.
LONG = 100

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_TRUE = np.zeros(256, bool)
_TRUE[1] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start:start + len], carried on from `before`; long ones one by one, others byte by byte together."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lens > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lens[i]], int(before[i]))
    order = np.flatnonzero(lens <= 64)
    order = order[np.argsort(-lens[order].astype(np.int16), kind="stable")]
    c, at, n = ~before[order], starts[order], lens[order]
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))  # those longer than k come first
        c[:m] = _CRC[(c[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (c[:m] >> np.uint32(8))
    out[order] = ~c
    return out


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs of all texts, and run offsets by text."""
    wide = data == 0xC3  # the lead byte of U+00C0 to U+00FF
    inside = _LETTER[data] | wide
    inside[1:] |= wide[:-1]
    return words(inside.view(np.uint8), off, _TRUE)


def _counted(least: int, draw: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([t["word"].combine_chunks(), t["n_sum"].combine_chunks()], names=["word", "n"])

        for rows, data, off in steps(batches, most=STEP):
            if not len(data):
                continue
            low = LOWER[data]
            starts, ends, per = letter_runs(data, off)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            doc, n = owner(per), chars[ends] - chars[starts]
            keep = n >= least
            starts, ends, doc, n = starts[keep], ends[keep], doc[keep], n[keep]
            changed: list[str] = []
            if draw:
                begin = np.array([zlib.crc32(f"{d}:".encode()) for d in column(rows, "doc_id").to_pylist()], np.uint32)
                h = crc32s(low, starts, ends - starts, begin[doc])
                hit = np.flatnonzero(h % np.uint32(draw) == 0)
                for i, k in zip(hit.tolist(), (h[hit] % n[hit]).tolist(), strict=True):
                    word = low[starts[i] : ends[i]].tobytes().decode()
                    if len(word) > least:
                        changed.append(word[:k] + word[k + 1 :])
                starts, ends = np.delete(starts, hit), np.delete(ends, hit)
            bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            made = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[ragged(starts, ends - starts)]))
            vc = pa.concat_arrays([made, pa.array(changed, pa.string())]).value_counts()
            held.append(pa.RecordBatch.from_arrays([vc.field("values"), vc.field("counts")], names=["word", "n"]))
            size += len(vc)
            if size > 2 * HELD:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD:
                    yield from (held[0].slice(i, 50_000) for i in range(0, size, 50_000))
                    held, size = [], 0
        if held:
            last = summed()
            yield from (last.slice(i, 50_000) for i in range(0, last.num_rows, 50_000))

    return run


def word_counts(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, draw: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the lower-cased letter runs of all texts.

    With `draw`, a run whose crc32 (of "<doc_id>:<run>") is a multiple of it loses the character at that value modulo
    its length, which plants misspellings at known places.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    every = map_arrow(rows, _counted(least_chars, draw), "word string, n long")
    return every.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --------------------------------------------------------------------------- keys


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes of the characters of all words, with the end behind; offsets in characters; the characters as numbers)."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.append(at, len(data))
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    size = np.diff(bounds)
    code = padded[at]
    for k in range(1, 4):
        code = np.where(size > k, code << 8 | padded[at + k], code)
    return bounds, np.searchsorted(at, off), code


def deletion_keys(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of whole words, and keys of the words without each one of their characters.

    With powers of an odd base modulo 2^64, the sum over a word's characters before the deleted one and that over
    those behind it, each moved to the word's start, are the polynomial of the shortened word.
    """
    up, down = powers(len(code) + 2)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(code.astype(U64) + U64(1)) * up[: len(code)], dtype=U64)])
    start, end = off[:-1], off[1:]
    whole = mix((sums[end] - sums[start]) * down[start])
    row, at = owner(off), np.arange(len(code))
    s = start[row]
    return whole, mix((sums[at] - sums[s]) * down[s] + (sums[end[row]] - sums[at + 1]) * down[s + 1])


def _keyed(batches: Iterator[pa.RecordBatch], carried: tuple[str, ...] = ("word", "n")) -> Iterator[pa.RecordBatch]:
    """Rows (key, place, first, carried columns): place -1 is the whole word; first: no earlier deletion gives the same string."""
    for rows, data, off in steps(batches, "word", 200_000):
        _, coff, code = _characters(data, off)
        whole, less = deletion_keys(code, coff)
        row = owner(coff)
        place = np.arange(len(code)) - coff[:-1][row]
        first = np.append(True, code[1:] != code[:-1]) | (place == 0)
        take = pa.array(np.concatenate([np.arange(len(whole)), row]))
        out = [
            pa.array(np.concatenate([whole, less]).view(np.int64)),
            pa.array(np.concatenate([np.full(len(whole), -1), place]).astype(np.int32)),
            pa.array(np.concatenate([np.ones(len(whole), bool), first])),
            *(column(rows, c).take(take) for c in carried),
        ]
        made = pa.RecordBatch.from_arrays(out, names=["key", "place", "first", *carried])
        yield from (made.slice(i, 50_000) for i in range(0, made.num_rows, 50_000))


def _shortened(word: pa.Array, place: np.ndarray) -> pa.Array:
    """The words without the character at a place (-1: all of them)."""
    data, off = text_bytes(word)
    bounds, coff, _ = _characters(data, off)
    cut = place >= 0
    a = np.where(cut, bounds[np.where(cut, coff[:-1] + place, 0)], off[1:])
    b = np.where(cut, bounds[np.where(cut, coff[:-1] + place + 1, 0)], off[1:])
    lens = np.stack([a - off[:-1], off[1:] - b], 1)
    raw = data[ragged(np.stack([off[:-1], b], 1).reshape(-1), lens.reshape(-1))]
    upto = np.concatenate([[0], np.cumsum(lens.sum(1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(word), pa.py_buffer(upto), pa.py_buffer(raw))


def _met(t: pa.Table) -> pa.RecordBatch:
    """Partial results (word, k near words, the most frequent of them) of whole keys, sorted by key, place, n descending, word."""
    t = t.combine_chunks()
    key, place = (t[c].to_numpy() for c in ("key", "place"))
    short = _shortened(t["word"].combine_chunks(), place)
    same = key[1:] == key[:-1]
    equal = pc.equal(short.slice(1), short.slice(0, len(short) - 1)).to_numpy(zero_copy_only=False)
    group = np.append(True, ~same)
    if (same & ~equal).any():  # different strings with one key: told apart by the strings
        code = short.dictionary_encode().indices.to_numpy()
        order = np.lexsort((np.arange(len(key)), place, code, key))
        t, key, place, code = t.take(pa.array(order)), key[order], place[order], code[order]
        group = np.append(True, (key[1:] != key[:-1]) | (code[1:] != code[:-1]))
    first, word, n = t["first"].to_numpy(), t["word"].combine_chunks(), t["n"].to_numpy()
    # Replacements: segments of one place.
    seg = group | np.append(True, place[1:] != place[:-1])
    at = np.flatnonzero(seg)
    size = np.diff(np.append(at, len(key)))
    mine = np.repeat(np.arange(len(at)), size)
    row = np.flatnonzero((size[mine] > 1) & (place >= 0))
    best = at[mine[row]]
    best = np.where(row == best, best + 1, best)
    # Insertions: the whole word comes first in its group.
    lead = np.flatnonzero(group)[np.cumsum(group) - 1]
    longer = np.flatnonzero((place >= 0) & first & (place[lead] < 0))
    a, b = np.concatenate([row, longer, lead[longer]]), np.concatenate([best, lead[longer], longer])
    k = np.ones(len(a), np.int64)
    k[: len(row)] = size[mine[row]] - 1
    return pa.RecordBatch.from_arrays([word.take(pa.array(a)), pa.array(k), word.take(pa.array(b)), pa.array(n[b])], names=["word", "k", "near", "near_n"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_met() of sorted rows, a few batches at a time; the rows of a key stay together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < 20_000 and sum(x.nbytes for x in held) < STEP:
            continue
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if whole:
            yield _met(t.slice(0, whole))
            held, size = t.slice(whole).to_batches(), size - whole
    if size:
        yield _met(pa.Table.from_batches(held))


def _rows(counts: DataFrame) -> DataFrame:
    """key, place, first, word, n: all rows of words of LONG characters or less, and those of longer ones that meet another.

    A long word would be carried as many times as it has characters, so its keys first meet without it.
    """
    schema = "key long, place int, first boolean, "
    short = map_arrow(counts.filter(F.length("word") <= LONG), _keyed, schema + "word string, n long")
    long = counts.filter(F.length("word") > LONG).withColumn("id", F.xxhash64("word"))
    if long.isEmpty():
        return short
    thin = counts.filter(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("id"), (F.length("word") > LONG).alias("long"))
    thin = store(map_arrow(thin, lambda b: _keyed(b, ("id", "long")), schema + "id long, long boolean"), "long-words")
    places = thin.filter("place >= 0")
    replaced = places.join(places.groupBy("key", "place").agg(F.count("*").alias("k")).filter("k > 1"), ["key", "place"], "left_semi")
    whole, less = thin.filter("place < 0"), places.filter("first")
    pairs = [replaced, whole.join(less, "key", "left_semi"), less.join(whole, "key", "left_semi")]
    met = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).filter("long").drop("long").distinct()
    return short.unionByName(met.join(long, "id").select("key", "place", "first", "word", "n"))


def near_words(counts: DataFrame) -> DataFrame:
    """word, n_near, near, near_n for the words of counts (word, n; words distinct) that differ from another one by one edit.

    near is the most frequent one of the n_near words, the least of equals.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _rows(counts).repartition(parts, F.shiftrightunsigned("key", 44)).sortWithinPartitions("key", "place", F.desc("n"), "word")
    met = map_arrow(dealt, _segments, "word string, k long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")
    return met.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", "b.near", (-F.col("b.m")).alias("near_n"))


def grouped(counts: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of counts (word, n).

    A word's form is its near word of most occurrences, if those are `ratio` times its own or more; its root is where
    the forms end.
    """
    found = counts.join(near_words(counts), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    known = store(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
    ends = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are taken
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = store(ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(ends)
        ends = now
        if now.filter("moved").isEmpty():
            break
    return known.join(ends.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, draw: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """grouped() over the words of docs."""
    counts = store(word_counts(docs, least_chars=least_chars, least_count=least_count, draw=draw, id_col=id_col, text_col=text_col), "words")
    return grouped(counts, ratio=ratio)


__all__ = ["crc32s", "deletion_keys", "grouped", "near_words", "spelling_variants", "word_counts"]
