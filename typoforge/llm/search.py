"""Operator 13, ranked lexical search: the documents of highest score for each item of a query table.

1. Matching.  Items are taken in blocks of bounded text.  One scan of all documents keeps, for each, its number of terms
   and the block's terms that it holds with their occurrences; this table is the index of the block.  How many documents
   hold a term, the number of documents and of terms are aggregated from it.
2. Scoring by sort-based accumulation.  A batch of documents is turned into arrays of (item, document) keys and
   impacts, one for each item that holds a matched term; the keys, item in the high bits, are radix sorted by 16 bits
   a pass, and sums over equal keys (reduceat) are the scores.  Batches are cut so that the arrays are bounded; a
   document has at most as many impacts as its block has distinct terms of items.
3. Selection.  A task keeps a heap of the best `k` documents for each item.  The heaps of all tasks are range-partitioned
   by (item, score, document), so that an item's rows may lie in several partitions; each keeps an item's first k, and
   the last ranking sees k rows for each partition and item at most.

Scores are integers, so sums don't depend on their order.

Skew: a term of most documents is an array element in each of them, never a shuffle key, and a document is scored
where it lies.  Defined cases: a null or empty text has no terms; such documents count nowhere, such items have no
rows; rows of documents that repeat rank each, as do rows of items; a null doc_id comes behind others of its score;
doc_id is an integer; other columns are ignored, whatever their names; an empty table gives an empty result; a very
long text is a step of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ALNUM, LOWER, column, forget, map_arrow, owner, ragged, steps, store, words

BEST = 10
#: Bytes of text of a block of items; impacts that are sorted at once.
BLOCK_BYTES = 8_000_000
IMPACTS = 1_000_000
#: The weight of a document's length, in percent.
LENGTH_PERCENT = 75


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts, offsets by text)."""
    low = LOWER[data]
    starts, ends, per = words(low, off, ALNUM)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[ragged(starts, ends - starts)])), per


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs)."""
    key = np.sort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.diff(np.append(at, len(key)))


class Items:
    """A block of items: its distinct terms, and for each term the items that hold it and how often."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [r[0] for r in rows]
        raw = [r[1].encode() for r in rows]
        flat, per = _terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64))
        coded = flat.dictionary_encode()
        self.terms = coded.dictionary
        pair, self.times = _counted(coded.indices.to_numpy().astype(np.int64) * max(len(rows), 1) + owner(per))
        term, self.item = np.divmod(pair, max(len(rows), 1))
        self.off = np.searchsorted(term, np.arange(len(self.terms) + 1))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Items]:
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield Items([(r.item, r.text) for r in part.toLocalIterator()])


def _matched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.terms
        many = max(len(known), 1)
        for rows, data, off in steps(batches):
            flat, per = _terms(data, off)
            coded = flat.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = at[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            hit = np.flatnonzero(term >= 0)
            pair, times = _counted(owner(per)[hit] * many + term[hit])
            doc, term = np.divmod(pair, many)
            lists = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), pa.array(np.diff(per)), pa.ListArray.from_arrays(lists, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(times))],
                names=["doc_id", "n", "terms", "times"],
            )

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(0, np.int64)
    for b in batches:
        flat = column(b, "terms").flatten().to_numpy()
        n = np.bincount(flat, minlength=len(total))
        n[: len(total)] += total
        total = n
    at = np.flatnonzero(total)
    for s in range(0, len(at), 50_000):
        x = at[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(total[x])], names=["term", "df"])


def _by_item(key: np.ndarray, items: int) -> np.ndarray:
    """The order of packed keys (item << 32 | document), by 16 bits a pass; documents come in order, so only items' digits are sorted."""
    order = None
    for shift in range(32, 32 + max(items - 1, 1).bit_length(), 16):
        digit = (key >> shift & 0xFFFF).astype(np.uint16)
        if order is None:
            order = np.argsort(digit, kind="stable")  # a radix sort, for 16 bits
        else:
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _scores(term: np.ndarray, impact: np.ndarray, doc: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of matched terms, which come in order of documents."""
    many = items.off[term + 1] - items.off[term]
    at = ragged(items.off[term], many)
    key = items.item[at] << 32 | np.repeat(doc, many)
    value = np.repeat(impact, many) * items.times[at]
    order = _by_item(key, len(items.ids))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(value, first)


class Best:
    """The best k documents of each item so far, as heaps."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        may = np.flatnonzero(score >= self.least[item])
        item, doc, score = item[may], doc[may], score[may]
        order = np.lexsort((ids[doc], ~real[doc], -score, item))
        item, doc, score = item[order], doc[order], score[order]
        start = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        few = place < self.k
        for i, s, r, d in zip(item[few].tolist(), score[few].tolist(), real[doc[few]].tolist(), ids[doc[few]].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, r, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        every = [(i, *e) for i, h in enumerate(self.heaps) for e in h]
        for a in range(0, len(every), 50_000):
            i, s, r, d = (np.array(x) for x in zip(*every[a : a + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(-d, pa.int64(), mask=~r.astype(bool)), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])


def _scored(sent, weights, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value, weights.value
        best = Best(len(items.ids), k)
        many = np.diff(items.off)
        for b in batches:
            lists = column(b, "terms")
            per = np.diff(lists.offsets.to_numpy())
            term, times = lists.flatten().to_numpy(), column(b, "times").flatten().to_numpy()
            raw = column(b, "doc_id")
            real, ids = raw.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(raw, 0).to_numpy()
            norm = 100 - LENGTH_PERCENT + LENGTH_PERCENT * column(b, "n").to_numpy() * n_docs // n_terms
            doc = np.repeat(np.arange(b.num_rows), per)
            impact = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * norm[doc]))
            full = impact > 0
            term, doc, impact = term[full], doc[full], impact[full]
            # Runs of documents whose impacts on items are about IMPACTS, one document at least.
            cost = np.concatenate([[0], np.cumsum(many[term])])[np.searchsorted(doc, np.arange(b.num_rows + 1))]
            a = 0
            while a < b.num_rows:
                z = max(int(np.searchsorted(cost, cost[a] + IMPACTS, side="right")) - 1, a + 1)
                s = slice(*np.searchsorted(doc, [a, z]).tolist())
                if s.stop > s.start:
                    best.take(*_scores(term[s], impact[s], doc[s], items), ids, real)
                a = z
        yield from best.rows()

    return run


def _first(k: int):
    """The first k rows of each item of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            item = column(b, "item").to_numpy()
            start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            size = np.diff(np.append(start, len(item)))
            place = np.arange(len(item)) - np.repeat(start, size)
            if item[0] == last:
                place[: size[0]] += had
            last, had = item[-1], int(place[-1]) + 1
            yield b.filter(pa.array(place < k))

    return run


def _best_of_block(rows: DataFrame, items: Items, item_type: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(items)
    index = store(map_arrow(rows, _matched(sent), "doc_id long, n long, terms array<int>, times array<long>"), "matches")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = map_arrow(index.select("terms"), _held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(items.terms), np.int64)
    for r in held.toLocalIterator():  # one row for each term of the block
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    weights = spark.sparkContext.broadcast(weight)
    found = store(map_arrow(index.filter(F.size("terms") > 0), _scored(sent, weights, n_docs, n_terms, k), "item int, doc_id long, score long"), "found")
    forget(index)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["item", F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    few = map_arrow(dealt, _first(k), "item int, doc_id long, score long")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order[1:]))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"item int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, *, k: int = BEST, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each row of queries."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    items = queries.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    out = None
    for block in _blocks(items, block_bytes):
        best = _best_of_block(rows, block, items.schema["item"].dataType.simpleString(), k)
        out = best if out is None else out.unionByName(best)
    return out


__all__ = ["search"]
