"""Operator 5, LM scoring by cross-entropy difference.

Two bigram models, of a target corpus (documents labelled good) and of the background (all documents), share
one vocabulary: the pieces of a public SentencePiece model.  Both are built the same way from exact counts over
whole corpora, background counts scaled to the target's size, so their smoothing matches:

    p(w | h) = (c(h, w) + K * p(w)) / (c(h) + K),   p(w) = (c(w) + 1/2) / (n + V/2)

c(h) counts the bigrams that begin with h, so p(. | h) sums to 1.  A document's score is the mean over its tokens
of loss_target - loss_background in nats (lower: more like the target).  Every document is held out: its own
bigrams, pieces and length are taken off both models' counts, and off the scale between them, before it is scored
(off the target's if it is labelled good), so each is scored by the models of all other documents.

Tasks count their distinct bigrams, a shuffle adds them up, and the table of bigrams stays distributed: it grows
with the input.  The HOT_MOST most frequent bigrams at most are broadcast and looked up in the scan; the
documents' other bigrams are joined to the table by a shuffle.  Unigram and context counts are sums of bigram
counts, bounded by the vocabulary, and broadcast.

Defined cases: a null or empty text has no tokens and a null score; documents without a label, or with a null
one, are background only; several labels of a document count as good if one is; with no good document the
target is uniform; rows that repeat are counted and scored each, held out one by one; other columns are ignored,
whatever their names; an empty table gives an empty result; a very long text is a step of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_arrow, owner, ragged, steps, store
from .vocab import PIECES, fragments, indexed, keep_only, pieces, stored

#: Bigrams that are broadcast at most (24 bytes each).
HOT_MOST = 1 << 20
PRIOR = 50.0
STEP = 4_000_000


def tokens(texts: pa.Array, model: str = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, offsets by text), as the library gives them."""
    import pyarrow.compute as pc

    flat, off = fragments(pc.replace_substring(texts, "▁", " "))
    idx, keys = indexed(flat)
    store = stored("pieces", model)
    keep_only(store)
    row = store.rows(keys)[idx]
    size = store.len[row]
    return store.ids[ragged(store.start[row], size)], np.concatenate([[0], np.cumsum(size)])[off]


def _before(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[1:] = ids[:-1]
        out[off[:-1][np.diff(off) > 0]] = -1
    return out


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of non-negative numbers, with first places, inverse and counts.

    Numbers and places are sorted as one 64-bit number where they fit, which is several times faster than an argsort.
    """
    n = len(values)
    bits = max(n - 1, 1).bit_length()
    if n == 0 or int(values.max()).bit_length() + bits > 63:
        each, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        return each, first, inverse.reshape(-1), counts
    packed = np.sort(values.astype(np.int64) << bits | np.arange(n))
    order, packed = packed & ((1 << bits) - 1), packed >> bits
    begins = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    counts = np.diff(np.append(begins, n))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.repeat(np.arange(len(begins)), counts)
    return packed[begins], order[begins], inverse, counts


def distinct_bigrams(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of the bigrams, in order; which of them each token's is)."""
    bits = int(ids.max()).bit_length() if len(ids) else 1
    each, _, which, _ = grouped((_before(ids, off) + 1) << bits | ids)
    return (each >> bits) << 32 | each & ((1 << bits) - 1), which


class Models:
    """The counts of both corpora by piece (index 0: before a text); row 0 the target, row 1 the background."""

    def __init__(self, uni: np.ndarray, begun: np.ndarray, prior: float = PRIOR) -> None:
        """uni: how often each piece occurs; begun: how many bigrams begin with it; both 2 x (V + 1)."""
        self.uni, self.begun, self.prior = uni, begun, prior
        self.total, self.size = uni.sum(axis=1), uni.shape[1] - 1

    def difference(self, *bigrams: np.ndarray) -> np.ndarray:
        """loss_target - loss_background of bigrams, see logs()."""
        target, background = self.logs(*bigrams)
        return background - target

    def logs(self, key: np.ndarray, counts: np.ndarray, own: np.ndarray, own_begun: np.ndarray, own_right: np.ndarray, n: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        """Log probabilities by both models of bigrams with these counts (2 rows), without the documents that they are in.

        These have n tokens, the bigram own times, own_begun bigrams that begin alike and own_right times its right piece.
        """
        left, right = key >> 32, (key & 0xFFFFFFFF) + 1
        mine = np.stack([good.astype(np.int64), np.ones(len(key), np.int64)])
        total = self.total[:, None] - mine * n
        both = (total > 0).all(axis=0)
        scale = np.ones((2, len(key)))
        scale[1, both] = total[0, both] / total[1, both]
        logs = []
        for k in (0, 1):
            p = ((self.uni[k][right] - own_right * mine[k]) * scale[k] + 0.5) / (total[k] * scale[k] + self.size / 2)
            c, h = (counts[k] - own * mine[k]) * scale[k], (self.begun[k][left] - own_begun * mine[k]) * scale[k]
            logs.append(np.log((c + self.prior * p) / (h + self.prior)))
        return logs


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, good: whether the document has a label of quality 1."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("of")).distinct()
    # Labels grow with the documents, so this is a sort-merge join at every size.
    ids = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return ids.join(good.hint("merge"), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.col("of").isNotNull().alias("good"))


def count_bigrams(docs: DataFrame, *, model: str = PIECES) -> DataFrame:
    """key (left id + 1, right id), target, background: exact counts over all documents.

    docs has text and good (boolean).
    """

    def out(held: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(held, axis=1)
        keys, inv = np.unique(every[0], return_inverse=True)
        sums = np.zeros((2, len(keys)), np.int64)
        for k in (0, 1):
            np.add.at(sums[k], inv, every[k + 1])
        return np.stack([keys, *sums])

    def sent(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, t.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in t], names=["key", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, _, _ in steps(batches, most=STEP):
            ids, off = tokens(column(rows, "text"), model)
            good = column(rows, "good").to_numpy(zero_copy_only=False)
            keys, inv = distinct_bigrams(ids, off)
            mine = good[owner(off)]
            held.append(np.stack([keys, np.bincount(inv[mine], minlength=len(keys)), np.bincount(inv, minlength=len(keys))]))
            size += len(keys)
            if size > 2_000_000:
                held = [out(held)]
                size = held[0].shape[1]
                if size > 1_000_000:
                    yield from sent(held[0])
                    held, size = [], 0
        if held:
            yield from sent(out(held))

    counted = map_arrow(docs.select("text", "good"), run, "key long, target long, background long")
    return counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _models(bigrams: DataFrame, model: str, prior: float) -> Models:
    """Piece counts, as sums of bigram counts by their right and by their left pieces: V + 1 rows at most each."""
    made = []
    for at in (F.col("key").bitwiseAND(0xFFFFFFFF) + 1, F.shiftright("key", 32)):
        t = bigrams.groupBy(at.alias("at")).agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
        out = np.zeros((2, pieces(model).get_piece_size() + 1), np.int64)
        for k, name in enumerate(("target", "background")):
            out[k][t["at"].to_numpy()] = t[name].to_numpy()
        made.append(out)
    return Models(*made, prior)


def _hot(bigrams: DataFrame, most: int) -> tuple[int, bool]:
    """(the least power of two whose bigrams, those as frequent or more, are at most `most`; whether these are all)."""
    by = {r.b: r.n for r in bigrams.groupBy(F.floor(F.log2("background")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for b in sorted(by, reverse=True):
        if total + by[b] > most:
            break
        least, total = b, total + by[b]
    return least, total == sum(by.values())


def score(docs: DataFrame, labels: DataFrame, *, model: str = PIECES, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, loss_difference (mean, nats per token)."""
    spark = docs.sparkSession
    labelled = store(with_target(docs, labels), "lm-texts")
    bigrams = store(count_bigrams(labelled, model=model), "bigrams")
    models = spark.sparkContext.broadcast(_models(bigrams, model, prior))
    least, whole = _hot(bigrams, HOT_MOST)
    t = bigrams.filter(F.col("background") >= F.lit(2.0) ** least).toArrow()
    key = t["key"].to_numpy()
    order = np.argsort(key)
    hot = spark.sparkContext.broadcast((key[order], np.stack([t[c].to_numpy()[order] for c in ("target", "background")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (key, counts) = models.value, hot.value
        for rows, _, _ in steps(batches, most=STEP):
            ids, off = tokens(column(rows, "text"), model)
            n, doc = np.diff(off), owner(off)
            good = column(rows, "good").to_numpy(zero_copy_only=False)
            each, which = distinct_bigrams(ids, off)
            # The distinct bigrams of each document, how many it has, and how many that begin alike.
            _, first, _, own = grouped(doc * max(len(each), 1) + which)
            span = int(ids.max()) + 2 if len(ids) else 1
            _, _, begin, held = grouped(doc * span + (each[which] >> 32))
            _, _, end, ended = grouped(doc * span + ids)
            mine, which, doc, begun, right = each[which[first]], which[first], doc[first], held[begin[first]], ended[end[first]]
            at = np.minimum(np.searchsorted(key, each), max(len(key) - 1, 0))
            known = (key[at] == each if len(key) else np.zeros(len(each), bool))[which]
            value = m.difference(mine[known], counts[:, at[which[known]]], own[known], begun[known], right[known], n[doc[known]], good[doc[known]])
            total = np.bincount(doc[known], value * own[known], len(n))[: len(n)]
            miss = np.flatnonzero(~known)
            rest = pa.StructArray.from_arrays([pa.array(x[miss].astype(np.int64)) for x in (mine, own, begun, right)], names=["key", "own", "begun", "right"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[miss], np.arange(len(n) + 1)).astype(np.int32)), rest)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "good"), pa.array(n.astype(np.int64)), pa.array(total.astype(float)), lists], names=["doc_id", "good", "n_tokens", "known", "rest"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    scanned = map_arrow(labelled, run, f"doc_id {kind}, good boolean, n_tokens long, known double, rest array<struct<key:long,own:long,begun:long,right:long>>")
    mean = F.when(F.col("n_tokens") > 0, (F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("n_tokens"))
    if whole:
        return scanned.withColumn("more", F.lit(0.0)).select("doc_id", "n_tokens", mean.alias("loss_difference"))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, own, begun, right, n, target, background = (column(b, c).to_numpy() for c in ("key", "own", "begun", "right", "n_tokens", "target", "background"))
            value = models.value.difference(key, np.stack([target, background]), own, begun, right, n, column(b, "good").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(value * own)], names=["row", "difference"])

    scanned = store(scanned.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = bigrams.filter(F.col("background") < F.lit(2.0) ** least)
    entries = scanned.select("row", "good", "n_tokens", F.explode("rest").alias("r")).select("row", "good", "n_tokens", "r.*")
    each = map_arrow(entries.join(rare, "key"), differences, "row long, difference double")
    more = each.groupBy("row").agg(F.sum("difference").alias("more"))
    return scanned.join(more, "row", "left").select("doc_id", "n_tokens", mean.alias("loss_difference"))
