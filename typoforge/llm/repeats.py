"""Finding every window of L symbols that starts at more than one place of a corpus, exactly and without a hot task.

1. Anchors.  In every stretch of W consecutive starts the K-gram of least hash is an anchor, so each window
   of L symbols holds an anchor within its first W symbols, and equal windows hold the same one at the same
   distance d.  An anchor's key hashes the symbols that all its windows share, its full hash the whole
   context (W - 1 symbols before, L after it).
2. Keys are counted (partial aggregation).  A key seen once has no repeated window.  Where all contexts of a
   repeated key are equal, all their windows repeat.
3. For the other repeated keys, each distinct context is fetched once, and a solver (operator 1: suffix
   arrays; operator 2: relative Lempel-Ziv factors) decides for every d whether the window occurs at another
   place of the block.  Contexts come sorted by key and are solved block by block, so memory is bounded;
   contexts of a key never split over blocks; keys that would unbalance the tasks are decided by counting their
   windows instead, with partial aggregation, so no key gathers in one task (both ways give the same windows).
4. Ranges of repeated windows go back to their documents.

Hashes have 64 bits; a context counts as equal to another on two of them (key and full), and the solvers
compare the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, column, keyed, map_arrow, mix, powers, prefix, ragged, span, steps, store, text_bytes

#: A key is settled by counting windows if its contexts are more than HOT, and more than HOT_SHARE of a partition's
#: mean, so that it would unbalance the tasks; solvers take about the same time for every context.
HOT = 4096
HOT_SHARE = 2.5
#: Contexts that a solver takes at once, and a key's more.
BLOCK = 4096
_PLACES = U64((1 << 28) - 1)
#: Bytes of text that one search for anchors takes: small arrays stay in cache.
FIND_BYTES = 400_000


@dataclass(frozen=True)
class Kind:
    """What a window is made of: L symbols, anchors among W starts by K-grams; how to read and solve texts."""

    length: int
    width: int
    gram: int
    symbols: Callable  # (bytes, offsets) -> (64-bit symbols, offsets in symbols, starts or None, ends or None)
    solve: Callable  # (list of contexts) -> repeated[context, d]


@dataclass
class Contexts:
    """Distinct contexts of a block: bytes, symbols, the anchor after `left` symbols; copies of each, and where one is."""

    data: np.ndarray
    symbols: np.ndarray
    off: np.ndarray
    left: np.ndarray
    copies: np.ndarray
    key: np.ndarray
    text: np.ndarray
    pos: np.ndarray


def anchors(sym: np.ndarray, off: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys, full hashes) of the anchors of texts of these symbols."""
    n, w, k, size = len(sym), kind.width, kind.gram, kind.length
    fits = np.flatnonzero(np.diff(off) >= size)
    if not len(fits):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(U64)
    pre = prefix(sym)
    _, down = powers(n + 1)
    # Hashes of all K-grams, in the high bits; below them the place, so that of equals the last is least.
    low = pre[k:] - pre[:-k]
    low *= down[: len(low)]
    low *= U64(0x9FB21C651E98DF25)
    low &= ~_PLACES
    low |= _PLACES - (np.arange(len(low), dtype=U64) & _PLACES)
    reach = 1
    while reach * 2 <= w:
        np.minimum(low[:-reach], low[reach:], out=low[:-reach])
        reach *= 2
    first = np.arange(n - size + 1)
    best = np.minimum(low[: len(first)], low[w - reach : w - reach + len(first)])
    # The place of the least value, from its low bits and the start of the stretch.
    place = (_PLACES - (best & _PLACES)).astype(np.int64)
    if n >> 28:
        place += (first >> 28) << 28
        place += (place < first) * (1 << 28)
    edge = np.zeros(len(first) + 1, np.int8)
    edge[off[fits]] += 1
    edge[off[fits + 1] - size + 1] -= 1
    place = place[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    place = np.unique(place)
    doc = np.searchsorted(off, place, side="right") - 1
    key = span(pre, place, place + size - w + 1)
    left = np.minimum(place - off[doc], w - 1)
    full = span(pre, place - left, np.minimum(place + size, off[doc + 1])) ^ mix(left.astype(U64) + U64(7))
    return place, key, full


def _find(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches, most=FIND_BYTES):
            sym, soff, _, _ = kind.symbols(data, off)
            place, key, full = anchors(sym, soff, kind)
            doc = np.searchsorted(soff, place, side="right") - 1
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "rid").take(take), column(rows, "th").take(take), pa.array((place - soff[doc]).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(full.view(np.int64))],
                names=["rid", "th", "pos", "key", "full"],
            )

    return run


def _fetch(kind: Kind):
    """The contexts at the wanted places of each text, as bytes (symbols are read off them again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches):
            want = column(rows, "want")
            flat, per = want.flatten(), np.diff(want.offsets.to_numpy())
            doc = np.repeat(np.arange(rows.num_rows), per)
            sym, soff, starts, ends = kind.symbols(data, off)
            pos = flat.field("pos").to_numpy() + soff[doc]
            left = np.minimum(pos - soff[doc], kind.width - 1)
            a, b = pos - left, np.minimum(pos + kind.length, soff[doc + 1])
            if starts is not None:
                a, b = starts[a], ends[b - 1]
            raw = data[ragged(a, b - a)].tobytes()
            bounds = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            place = mix(column(rows, "rid").to_numpy().view(U64)) ^ column(rows, "th").to_numpy().view(U64)
            out = [flat.field("key"), flat.field("full"), flat.field("copies"), pa.array(left.astype(np.int32)), text, pa.array(place[doc].view(np.int64)), flat.field("pos")]
            yield pa.RecordBatch.from_arrays(out, names=["key", "full", "copies", "left", "text", "doc", "pos"])

    return run


def _contexts(batch: pa.Table | pa.RecordBatch, kind: Kind) -> Contexts:
    text = batch["text"] if isinstance(batch, pa.Table) else column(batch, "text")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    data, off = text_bytes(text)
    sym, soff, _, _ = kind.symbols(data, off)
    left, copies, key, doc, pos = (np.asarray(batch[c]) for c in ("left", "copies", "key", "doc", "pos"))
    return Contexts(data, sym, soff, left.astype(np.int64), copies, key, doc, pos.astype(np.int64))


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _runs(repeated: np.ndarray, kind: Kind) -> pa.Array:
    """For each context, the union of its repeated windows, relative to the anchor."""
    out = []
    for row in repeated:
        d = np.flatnonzero(row)[::-1]
        runs: list[dict] = []
        for x in (-d).tolist():
            if runs and x <= runs[-1]["hi"]:
                runs[-1]["hi"] = x + kind.length
            else:
                runs.append({"lo": x, "hi": x + kind.length})
        out.append(runs)
    return pa.array(out, _RUNS)


def _joined_runs(kind: Kind):
    """The repeated windows of contexts, listed by distance, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds = column(b, "ds")
            row = np.repeat(np.arange(b.num_rows), np.diff(ds.offsets.to_numpy()))
            repeated = np.zeros((b.num_rows, kind.width), bool)
            repeated[row, ds.flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([column(b, "key"), column(b, "full"), _runs(repeated, kind)], names=["key", "full", "runs"])

    return run


def _solve(kind: Kind):
    """Decide contexts, which come sorted by key, in blocks that keep the contexts of a key together."""

    def solved(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        repeated = kind.solve(_contexts(part, kind), kind)
        return pa.RecordBatch.from_arrays([part["key"].combine_chunks(), part["full"].combine_chunks(), _runs(repeated, kind)], names=["key", "full", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if whole:
                yield solved(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                n -= whole
        if n:
            yield solved(pa.Table.from_batches(held))

    return run


def _windows(kind: Kind):
    """Every window of the contexts of hot keys, with its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = _contexts(b, kind)
            pre = prefix(c.symbols)
            most = np.minimum(np.diff(c.off) - kind.length, c.left)  # last start of a window
            least = np.maximum(c.left - (kind.width - 1), 0)
            n = np.maximum(most - least + 1, 0)
            ctx = np.repeat(np.arange(b.num_rows), n)
            at = ragged(c.off[:-1] + least, n)
            d = c.left[ctx] - (at - c.off[ctx])
            h = span(pre, at, at + kind.length) ^ mix(d.astype(U64) + U64(11))
            take = pa.array(ctx)
            for i in range(0, len(ctx), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), column(b, "key").take(take[s]), column(b, "full").take(take[s]), pa.array(d[s].astype(np.int32)), column(b, "copies").take(take[s])], names=["win", "key", "full", "d", "copies"])

    return run


def repeated_ranges(docs: DataFrame, kind: Kind, *, hot: int = HOT, hot_share: float = HOT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed rows with rid, ranges): ranges has rid, th, runs: array<struct<lo,hi>> in symbols of each text, not yet united."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = map_arrow(rows, _find(kind), "rid long, th long, pos int, key long, full long")
    keys = (
        found.groupBy("key").agg(F.count("*").alias("n"), F.min("full").alias("a"), F.max("full").alias("b")).filter("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    )
    keys = store(keys, "keys")  # as a table, so that a hot key of the join below can be split
    hits = store(found.join(keys, "key"), "anchors")
    need = hits.filter("mixed").groupBy("key", "full").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "th", "pos")).alias("at"))
    want = need.groupBy("at.rid", "at.th").agg(F.collect_list(F.struct("at.pos", "key", "full", "copies")).alias("want"))
    contexts = store(map_arrow(rows.join(want, ["rid", "th"]), _fetch(kind), "key long, full long, copies long, left int, text binary, doc long, pos int"), "contexts")
    most = max(hot, int(hot_share * contexts.count() / parts))
    crowded = store(contexts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "crowded")
    runs = "key long, full long, runs array<struct<lo:int,hi:int>>"
    if crowded.isEmpty():
        decided = map_arrow(contexts.repartition(parts, "key").sortWithinPartitions("key"), _solve(kind), runs)
    else:
        decided = map_arrow(contexts.join(crowded, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key"), _solve(kind), runs)
        windows = map_arrow(contexts.join(crowded, "key", "left_semi"), _windows(kind), "win long, key long, full long, d int, copies long")
        often = store(windows.groupBy("win").agg(F.sum("copies").alias("n")).filter("n > 1").select("win"), "often")
        counted = windows.join(often, "win").groupBy("key", "full").agg(F.collect_list("d").alias("ds"))
        decided = decided.unionByName(map_arrow(counted, _joined_runs(kind), runs))
    decided = store(decided.filter(F.size("runs") > 0), "decided")
    one = F.array(F.struct((F.col("pos") - kind.width + 1).alias("lo"), (F.col("pos") + kind.length).alias("hi")))
    plain = hits.filter("not mixed").select("rid", "th", one.alias("r"))
    moved = F.transform("runs", lambda r: F.struct((F.col("pos") + r["lo"]).alias("lo"), (F.col("pos") + r["hi"]).alias("hi")))
    solved_hits = hits.filter("mixed").join(decided, ["key", "full"]).select("rid", "th", moved.alias("r"))
    ranges = plain.unionByName(solved_hits).groupBy("rid", "th").agg(F.flatten(F.collect_set("r")).alias("runs"))
    return rows, ranges


def apply_ranges(rows: DataFrame, ranges: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run fn over the texts with their ranges (null: none)."""
    return map_arrow(rows.join(ranges, ["rid", "th"], "left"), fn, schema)


def marked(rows: pa.RecordBatch, soff: np.ndarray) -> np.ndarray:
    """For each symbol, whether a range covers it."""
    lists = column(rows, "runs")
    flat = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, n)
    doc = np.repeat(np.arange(rows.num_rows), n)
    lo = np.clip(flat.field("lo").to_numpy() + soff[doc], soff[doc], soff[doc + 1])
    hi = np.clip(flat.field("hi").to_numpy() + soff[doc], soff[doc], soff[doc + 1])
    edge = np.zeros(int(soff[-1]) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge)[:-1] > 0
