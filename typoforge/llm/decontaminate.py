"""Operator 4, benchmark decontamination: a broadcast hash set of test n-grams, scanned, verified, removed.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters.  Each item
gives its windows of `n` words, an item of fewer words one window of its own.  The windows' 64-bit
hashes are broadcast; documents are scanned word by word in vectorised steps, and each hash hit is
verified on the words themselves.

The broadcast is bounded: items are taken in blocks of at most `block_bytes` of text, and each block is
scanned over all documents, so a benchmark of any size fits.  One block is a single pass without a
shuffle; with more, the hits of a document meet by its key.

Defined cases: null or empty texts have no words and no hits; a null item_id counts as the id "null";
rows of the benchmark that repeat an id are one item; rows of the documents that repeat an id are
judged each by its own text; an empty benchmark hits nothing; other columns are ignored, whatever their names; an
empty table gives an empty result; a very long text is a step of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ALNUM, LOWER, U64, column, filled, fresh, keyed, map_arrow, owner, prefix, ragged, span, steps, word_hashes, words

NGRAM = 10
#: Bytes of text of a block of items; its arrays take about seven times as many.
BLOCK_BYTES = 8_000_000


class Windows:
    """The windows of some items as arrays: by length, hashes in order with the window's first word and its item.

    The items' words stand in one buffer with a space between, so a window is a range of it: about 40 bytes a word.
    """

    def __init__(self, items: list[tuple[str, str]], n: int = NGRAM) -> None:
        self.names = [item for item, _ in items]
        raw = [text.encode() for _, text in items]
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        starts, ends, word_off = words(data, np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64), ALNUM)
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        text = np.full(int((size + 1).sum()), 0x20, np.uint8)
        text[ragged(self.starts, size)] = data[ragged(starts, size)]
        self.text = text.tobytes()
        many = np.diff(word_off)
        width = np.minimum(many, n)
        pre = prefix(word_hashes(data, starts, ends))
        self.hashes, self.first, self.item, self.sieve = {}, {}, {}, {}
        for k in np.unique(width[many > 0]).tolist():
            own = np.flatnonzero(width == k)
            count = many[own] - k + 1
            at = ragged(word_off[own], count)
            h = span(pre, at, at + k)
            order = np.argsort(h, kind="stable")
            self.hashes[k], self.first[k], self.item[k] = h[order], at[order].astype(np.int32), np.repeat(own, count)[order].astype(np.int32)
            self.sieve[k] = np.zeros(1 << 20, bool)
            self.sieve[k][h & U64((1 << 20) - 1)] = True

    def _items(self, size: int, value: np.uint64, found: bytes) -> tuple[str, ...]:
        """The items with a window of this hash and these words."""
        known, first = self.hashes[size], self.first[size]
        out = set()
        for w in range(int(np.searchsorted(known, value)), int(np.searchsorted(known, value, side="right"))):
            i = int(first[w])
            if self.text[self.starts[i] : self.ends[i + size - 1]] == found:  # verified word by word
                out.add(self.names[self.item[size][w]])
        return tuple(out)

    def scan(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """(words that are hit, (document, item) pairs) of lower-cased texts."""
        hit = np.zeros(len(starts) + 1, np.int64)
        pairs: set[tuple[int, str]] = set()
        seen: dict[bytes, tuple[str, ...]] = {}
        if len(starts) and self.hashes:
            doc = owner(word_off)
            pre = prefix(word_hashes(low, starts, ends))
            for size, known in self.hashes.items():
                at = np.arange(max(len(starts) - size + 1, 0))
                if not len(at):
                    continue
                h = span(pre, at, at + size)
                sel = np.flatnonzero(self.sieve[size][h & U64((1 << 20) - 1)])
                sel = sel[doc[sel] == doc[sel + size - 1]]
                if not len(sel):
                    continue
                near = np.minimum(np.searchsorted(known, h[sel]), len(known) - 1)
                for i in sel[known[near] == h[sel]].tolist():
                    found = b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(i, i + size))
                    if found not in seen:
                        seen[found] = self._items(size, h[i], found)
                    if items := seen[found]:
                        hit[i] += 1
                        hit[i + size] -= 1
                        d = int(doc[i])
                        pairs.update((d, x) for x in items)
        return np.cumsum(hit)[:-1] > 0, sorted(pairs)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _item_blocks(benchmark: DataFrame, n: int, block_bytes: int, id_col: str, text_col: str):
    """The windows of the items, in blocks whose text is bounded."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield blocks, Windows([(r.item, r.text) for r in part.toLocalIterator()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = NGRAM, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, th, n_words, n_hit, hits (runs of hit words as byte ranges), items.

    hits are array<struct<start,end>> in bytes of the text, items the sorted ids of the items that occur.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>"
    parts, blocks = [], 1
    for blocks, windows in _item_blocks(benchmark, n, block_bytes, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for rows, data, off in steps(batches):
                low = LOWER[data]
                starts, ends, word_off = words(low, off, ALNUM)
                hit, pairs = w.scan(low, starts, ends, word_off)
                items: list[list[str]] = [[] for _ in range(rows.num_rows)]
                for d, x in pairs:
                    items[d].append(x)
                at = np.flatnonzero(hit)
                doc = np.searchsorted(word_off, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))[: len(first)] - 1
                run_doc = doc[first]
                runs = pa.StructArray.from_arrays([pa.array(starts[at[first]] - off[run_doc]), pa.array(ends[at[last]] - off[run_doc])], ["start", "end"])
                run_off = np.searchsorted(run_doc, np.arange(rows.num_rows + 1)).astype(np.int32)
                n_hit = np.bincount(doc, minlength=rows.num_rows)[: rows.num_rows].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "doc_id"), column(rows, "th"), pa.array(np.diff(word_off)), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(run_off), runs), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "th", "n_words", "n_hit", "hits", "items"],
                )

        parts.append(map_arrow(rows, run, schema))
    if blocks == 1:
        return parts[0]
    # Hits of several blocks: the runs of a row meet by its key and are united there; equal rows find equal runs.
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    found = (
        union.filter("n_hit > 0")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumnsRenamed({"doc_id": "k_id", "th": "k_th"})
    )
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left").select("doc_id", "th", "text", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return map_arrow(joined, _united, schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the words of each text and those inside the united runs."""
    for rows, data, off in steps(batches):
        starts, ends, word_off = words(LOWER[data], off, ALNUM)
        hits, n_hit = [], []
        for d, runs in enumerate(column(rows, "runs").to_pylist()):
            s, e = starts[word_off[d] : word_off[d + 1]] - off[d], ends[word_off[d] : word_off[d + 1]] - off[d]
            mark = np.zeros(len(s) + 1, np.int64)
            for r in runs or []:
                mark[np.searchsorted(s, r["start"])] += 1
                mark[np.searchsorted(e, r["end"]) + 1] -= 1
            on = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            cut = np.split(on, np.flatnonzero(np.diff(on) > 1) + 1) if len(on) else []
            hits.append([{"start": int(s[c[0]]), "end": int(e[c[-1]])} for c in cut])
            n_hit.append(len(on))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "th"), pa.array(np.diff(word_off)), pa.array(n_hit, pa.int64()), pa.array(hits, kind), column(rows, "items")], names=["doc_id", "th", "n_words", "n_hit", "hits", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated documents (mode "documents"), or with the hit words cut out (mode "spans").

    All columns of docs stay; in mode "spans" text loses the byte range of every run of hit words.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    if mode == "documents":
        (whole,) = fresh(docs, "whole")
        # Each block of items drops what it hits, in place: no join, whatever the number of blocks.
        for _, windows in _item_blocks(benchmark, n, block_bytes, "item_id", "text"):
            sent = docs.sparkSession.sparkContext.broadcast(windows)

            def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for rows, data, off in steps(filled(batches, "text", whole), whole):
                    low = LOWER[data]
                    starts, ends, word_off = words(low, off, ALNUM)
                    hit, _ = sent.value.scan(low, starts, ends, word_off)
                    bad = np.zeros(rows.num_rows, bool)
                    bad[np.searchsorted(word_off, np.flatnonzero(hit), side="right") - 1] = True
                    yield rows.filter(pa.array(~bad)).drop_columns([whole])

            docs = map_arrow(docs, clean, docs.schema)
        return docs
    i, h, hits = fresh(docs, "id", "hash", "hits")
    found = find_leaks(docs, benchmark, n=n, block_bytes=block_bytes).filter("n_hit > 0").dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("hits").alias(hits))
    on = docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h))

    @F.pandas_udf("string")
    def cut(texts, hits):
        import pandas as pd

        out = []
        for t, h in zip(texts, hits, strict=True):
            if h is None or t is None:
                out.append(t)
                continue
            raw, at, keep = t.encode(), 0, []
            for r in h:
                keep.append(raw[at : r["start"]])
                at = r["end"]
            out.append(b"".join([*keep, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return docs.join(found, on, "left").withColumn("text", cut("text", hits)).select(*docs.columns)


def leak_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


__all__ = ["Windows", "decontaminate", "find_leaks", "leak_digest"]
