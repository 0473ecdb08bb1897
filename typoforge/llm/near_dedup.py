"""Operator 7, MinHash near-dedup by an LSH forest.

Every document's distinct 5-word shingles (A-Z lower-cased) give TREES sorted signature orders of DEPTH
min-hashes each.  Documents with equal shingle sets are one class from here on.  In every order, classes that
share a prefix of at least LEAST min-hashes are a region, and neighbours in the order, which have the longest
common prefix of the region, are candidates: the depth adapts to how crowded a region is.  An order is dealt by
ranges, so no region gathers in one task, and streamed, so memory is a batch.

Candidates are verified on the full shingle sets (100 * intersection >= 85 * union) in three kinds of rounds:
neighbours of every order, which joins most of each group along a path; every class of a region of several
components with the region's most linked class (the source of a star of copies), until that finds nothing or
HUB_ROUNDS times; at last, all classes of regions that still have several components by a prefix join of their
sets.  That join is exact: no pair of different components is left out, however large a region is, and rare
shingles keep its candidates few.  The first two kinds only save work; they are sifted by the lowest bits of all
192 min-hashes.

At similarity 0.85, a pair shares 5 of 8 min-hashes' prefix in none of 24 orders with probability 8e-7.

Texts: words are runs of bytes other than ASCII white space; with fewer than five words the whole sequence is one
shingle; null or wordless texts have none and link with nothing.  Rows that repeat a doc_id are one node
(linked by it); rows with a null doc_id link with nothing, have a null component_id and are kept.  doc_id is an
integer; other columns are ignored, whatever their names; an empty table gives an empty result; a very long text is
a step of its own, and its set is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import LOWER, SPACED, STEP_BYTES, U64, column, forget, fresh, keyed, map_arrow, mix, owner, prefix, ragged, span, steps, store, text_bytes, word_hashes, words
from .components import components
from .vocab import keep_only

TREES = 24
DEPTH = 8
LEAST = 5
#: Rounds with the most linked classes before the prefix join.
HUB_ROUNDS = 2
PERCENT = 85
SHINGLE = 5
#: Bits of the sketch by which candidates of the first rounds are sifted, and how many may differ.
SKETCH = 192
DIFFER = 32


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, sorted within each, offsets by text)."""
    low = LOWER[data]
    starts, ends, word_off = words(low, off, SPACED)
    n_docs = len(off) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n_docs + 1, np.int64)
    pre = prefix(word_hashes(low, starts, ends))
    n = np.diff(word_off)
    has = n > 0
    width = np.minimum(n, size)
    count = np.where(has, n - width + 1, 0)
    at = ragged(word_off[:-1], count)
    doc = np.repeat(np.arange(n_docs), count)
    h = span(pre, at, at + width[doc])
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


_SEED = mix(np.arange(1, TREES * DEPTH + 1, dtype=U64) * U64(0xA24BAED4963EE407)).astype(np.uint32)


def signatures(h: np.ndarray, off: np.ndarray, trees: int = TREES) -> np.ndarray:
    """16-bit min-hashes, texts x (trees * DEPTH), of texts that have shingles."""
    base = (h ^ (h >> U64(32))).astype(np.uint32)
    out = np.empty((len(off) - 1, trees * DEPTH), np.uint16)
    at = off[:-1]
    for i in range(trees * DEPTH):
        v = base ^ _SEED[i]
        v *= np.uint32(0x7FEB352D)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x846CA68B)
        v ^= v >> np.uint32(16)
        out[:, i] = (np.minimum.reduceat(v, at) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def labels(sig: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """For each text and order: a hash of the order and its first LEAST min-hashes; the others, packed in order."""
    s = sig.reshape(len(sig), trees, DEPTH).astype(U64)
    region = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=U64)), s.shape[:2]).copy()
    for k in range(LEAST):
        region = mix(region * U64(31) + s[:, :, k] + U64(1))
    deep = np.zeros(s.shape[:2], U64)
    for k in range(LEAST, DEPTH):
        deep = (deep << U64(16)) | s[:, :, k]
    return region.view(np.int64), deep.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only()
    pair = pa.struct([("region", pa.int64()), ("deep", pa.int64())])
    for rows, data, off in steps(batches):
        h, soff = shingles(data, off)
        n = np.diff(soff)
        full = np.flatnonzero(n > 0)
        a, b = np.zeros(len(n), U64), np.zeros(len(n), U64)
        region, deep = np.zeros((0, TREES), np.int64), np.zeros((0, TREES), np.int64)
        sketch = np.zeros((len(n), 3), np.int64)
        if len(full):
            at = soff[:-1][full]
            a[full] = np.add.reduceat(mix(h + U64(3)), at)
            b[full] = np.bitwise_xor.reduceat(mix(h + U64(5)), at)
            sig = signatures(h, np.append(at, len(h)))
            region, deep = labels(sig)
            sketch[full] = np.packbits(sig[:, :SKETCH].astype(np.uint8) & 1, axis=1).view(np.int64)
        lens = np.where(n > 0, TREES, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(region.reshape(-1)), pa.array(deep.reshape(-1))], fields=list(pair)))
        yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "th"), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.array(sketch[:, k].copy()) for k in range(3)), lists], names=["doc_id", "th", "n", "sa", "sb", "s1", "s2", "s3", "labels"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of regions, each with the class before it in the order (null where that is of another region).

    Rows come sorted by (region, deep, cls), and only the last one of a batch is held.  The first and the last row of
    a partition are always members, as the rest of their region may stand in the next partition.
    """
    last, first = None, True
    for b in batches:
        if not b.num_rows:
            continue
        region, cls = (column(b, c).to_numpy() for c in ("region", "cls"))
        if last is None:
            before, had = cls[0], False
        else:
            before, had = last[2:]
            region, cls = np.append(last[0], region), np.append(last[1], cls)
        prev = np.append(before, cls[:-1])
        has = np.append(had, region[1:] == region[:-1])
        member = has | np.append(has[1:], False)
        member[0] |= first
        last = region[-1], cls[-1], prev[-1], has[-1]
        if len(region) > 1:
            first = False
            yield _members(region[:-1], cls[:-1], prev[:-1], has[:-1], member[:-1])
    if last is not None:
        yield _members(*(np.array([x]) for x in last), np.ones(1, bool))


def _members(region: np.ndarray, cls: np.ndarray, prev: np.ndarray, has: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(region[member]), pa.array(cls[member]), pa.array(prev[member], mask=~has[member])], names=["region", "cls", "prev"])


#: What a class is sifted by.
ROW = ("n", "s1", "s2", "s3")


def _sifted(a: str, b: str) -> F.Column:
    """Whether classes a and b (structs) are of different components, and sizes and sketches allow a link."""
    at = lambda side, c: F.col(f"{side}.{c}")
    differ = sum((F.bit_count(at(a, c).bitwiseXOR(at(b, c))) for c in ("s1", "s2", "s3")), F.lit(0))
    alike = 100 * F.least(at(a, "n"), at(b, "n")) >= PERCENT * F.greatest(at(a, "n"), at(b, "n"))
    return (at(a, "comp") != at(b, "comp")) & alike & (differ <= DIFFER)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _split(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with comp; only regions of several components."""
    rows = members.join(found, members["cls"] == found["node"], "left").select("region", "cls", *ROW, F.coalesce("component", "cls").alias("comp"))
    rows = store(rows, "split")
    several = rows.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("region")
    out = store(rows.join(several, "region"), "several")
    forget(rows)
    return out


def _with_hubs(split: DataFrame, links: DataFrame) -> DataFrame:
    """Candidate pairs of each region's most linked class with all others."""
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a")))
    degree = ends.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("degree"))
    me = F.struct("cls", *ROW, "comp")
    hubs = split.join(degree, "cls").groupBy("region").agg(F.max_by(me, F.struct("degree", "cls")).alias("x"))
    both = split.select("region", me.alias("y")).join(hubs, "region").filter(_sifted("x", "y"))
    return both.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _least(n: np.ndarray) -> np.ndarray:
    """The least size of a set that can be linked with one of n."""
    return -(-PERCENT * n // 100)


def _needed(both: np.ndarray) -> np.ndarray:
    """How many shingles two sets that are linked share at least, by the sum of their sizes."""
    return -(-PERCENT * both // (100 + PERCENT))


def _bounds(most: int) -> np.ndarray:
    """The least size of every bucket of sizes, each about a 25th wider than the last."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 26 // 25))
    return np.array(out, np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with the roles that they have in the prefix join: (bucket of the smaller set's size, whether this is the
    larger one, the last place of a shingle, in the order of shingles, that a link must share one up to)."""
    role = pa.struct([("b", pa.int32()), ("large", pa.bool_()), ("last", pa.int64())])
    for rows, data, off in steps(batches):
        h, soff = shingles(data, off)
        n = np.diff(soff)
        bounds = _bounds(int(n.max(initial=1)))
        own, low = (np.searchsorted(bounds, x, side="right") - 1 for x in (n, _least(n)))
        count = own - low + 1
        doc, b = np.repeat(np.arange(len(n)), count), ragged(low, count)
        last = n[doc] - _needed(n[doc] + np.maximum(bounds[b], _least(n[doc])))
        # Each set's roles as the larger one, by bucket, and behind them the one as the smaller.
        at = np.cumsum(count)
        made = pa.StructArray.from_arrays([pa.array(x) for x in (np.insert(b, at, own).astype(np.int32), np.insert(np.ones(len(b), bool), at, False), np.insert(last, at, n - _needed(2 * n)))], fields=list(role))
        roles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at + np.arange(1, len(n) + 1)]).astype(np.int32)), made)
        lists = pa.ListArray.from_arrays(pa.array(soff.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([column(rows, "cls"), column(rows, "comp"), pa.array(n), roles, lists], names=["cls", "comp", "n", "roles", "h"])


def _apart(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs of all classes of regions with several components, by prefixes of their sets, rarest shingles first.

    Sets of s <= l shingles at PERCENT share at least o = ceil(PERCENT * (s + l) / (100 + PERCENT)), so in any order of
    all shingles they share one among the first s - o + 1 and l - o + 1.  In the order of their frequency those of most
    texts occur nowhere else, and only shared shingles become rows.  Rows meet by shingle and bucket of the smaller
    set's size; where one component has most rows of such a key, these don't meet each other.
    """
    who = split.select("cls", "comp").distinct()
    sets = store(map_arrow(texts.join(who, "cls").select("cls", "comp", "text"), _sets, "cls long, comp long, n long, roles array<struct<b:int,large:boolean,last:long>>, h array<long>"), "sets")
    each = sets.select("cls", F.explode("h").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1")
    shared = each.join(often, "x").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("order"))
    most = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1 - F.col("alone")
    shared = shared.join(sets.drop("h"), "cls").withColumn("alone", F.col("n") - F.size("order"))  # shingles of this set only come first
    places = shared.select("cls", "comp", "n", "roles", "alone", F.posexplode(F.slice("order", 1, F.greatest(most, F.lit(0)).cast("int"))).alias("at", "e"))
    placed = places.select("cls", "comp", "n", (F.col("alone") + F.col("at")).alias("at"), "e.x", F.explode("roles").alias("r")).filter("at <= r.last")
    index = store(placed.select("x", "r.b", "r.large", "cls", "comp", "n", "at"), "prefixes")
    counts = index.groupBy("x", "b", "comp").agg(F.count("*").alias("k"))
    several = counts.groupBy("x", "b").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    index = store(index.join(several, ["x", "b"]).withColumn("minor", F.col("comp") != F.col("main")).drop("main"), "keys")
    s, l = index.filter("not large").alias("s"), index.filter("large").alias("l")  # noqa: E741
    need = F.ceil(PERCENT * (F.col("s.n") + F.col("l.n")) / (100 + PERCENT))
    smaller = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.cls") < F.col("l.cls")))
    early = (F.col("s.at") <= F.col("s.n") - need) & (F.col("l.at") <= F.col("l.n") - need)
    sized = 100 * F.col("s.n") >= PERCENT * F.col("l.n")
    on = (F.col("s.x") == F.col("l.x")) & (F.col("s.b") == F.col("l.b")) & smaller & sized & early & (F.col("s.comp") != F.col("l.comp"))
    pair = F.least("s.cls", "l.cls").alias("a"), F.greatest("s.cls", "l.cls").alias("b")
    met = s.filter("minor").join(l, on).select(*pair).unionByName(s.filter("not minor").join(l.filter("minor"), on).select(*pair))
    return met.distinct()


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that hold on their full texts."""
    one = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return store(map_arrow(two, _verify, "a long, b long"), "links")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts' shingle sets are similar enough."""
    for batch in batches:
        sizes = [pc.binary_length(column(batch, side)).to_numpy().astype(np.int64) for side in ("text_a", "text_b")]
        ends = np.flatnonzero(np.diff(np.cumsum(sizes[0] + sizes[1]) // STEP_BYTES, append=-1)) + 1
        for s, e in zip(np.append(0, ends[:-1])[: len(ends)].tolist(), ends.tolist(), strict=True):
            rows = batch.slice(s, e - s)
            h, pair, size = [], [], []
            for side in ("text_a", "text_b"):
                data, off = text_bytes(column(rows, side))
                x, soff = shingles(data, off)
                h.append(x)
                pair.append(owner(soff))
                size.append(np.diff(soff))
            x, p = np.concatenate(h), np.concatenate(pair)
            order = np.argsort(x)
            order = order[np.argsort(p[order], kind="stable")]
            x, p = x[order], p[order]
            both = p[1:][(x[1:] == x[:-1]) & (p[1:] == p[:-1])]
            inter = np.bincount(both, minlength=rows.num_rows)
            union = size[0] + size[1] - inter
            keep = pa.array(100 * inter >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([column(rows, "a").filter(keep), column(rows, "b").filter(keep)], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = store(map_arrow(rows, _sign, "doc_id long, th long, n long, sa long, sb long, s1 long, s2 long, s3 long, labels array<struct<region:long,deep:long>>"), "signatures")
    # One class for each set; its node is its least doc_id.  Labels follow from the set.
    real = signed.filter("n > 0 and doc_id is not null")
    classes = real.groupBy("sa", "sb", "n").agg(F.min(F.struct("doc_id", "th")).alias("at"), *(F.first(c).alias(c) for c in ("s1", "s2", "s3", "labels")))
    classes = store(classes.select("sa", "sb", "n", F.col("at.doc_id").alias("cls"), F.col("at.th").alias("th"), "s1", "s2", "s3", "labels"), "classes")
    # The orders, dealt by ranges of (region, deep, cls), so that a region of any size is split.
    leaves = classes.select("cls", F.explode("labels").alias("l")).select("l.region", "l.deep", "cls")
    order = leaves.repartitionByRange(parts, "region", "deep", "cls").sortWithinPartitions("region", "deep", "cls")
    near = store(map_arrow(order, _neighbours, "region long, cls long, prev long"), "neighbours")
    info = classes.select("cls", *ROW)
    members = store(near.join(info, "cls"), "members")
    wanted = near.select("cls").distinct().join(classes.select("cls", "th"), "cls")
    texts = store(rows.join(wanted.select(F.col("cls").alias("doc_id"), "th"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("cls"), "text"), "texts")

    me, other = F.struct("cls", *ROW, F.col("cls").alias("comp")), info.select(F.col("cls").alias("prev"), F.struct("cls", *ROW, F.col("cls").alias("comp")).alias("x"))
    pairs = members.filter("prev is not null").select("prev", me.alias("y")).distinct().join(other, "prev").filter(_sifted("x", "y"))
    links = _linked(pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct(), texts)
    found = components(links)
    split = _split(members, found)
    for _ in range(HUB_ROUNDS):
        hubs = _linked(_with_hubs(split, links), texts)
        if hubs.isEmpty():
            break
        links, found = links.unionByName(hubs), components(_edges(found).unionByName(hubs))
        forget(split)
        split = _split(members, found)
    more = _linked(_apart(split, texts), texts)
    forget(split, members, near, texts)
    # Rows that repeat a doc_id with other texts are one node already: classes that share it as a member link.
    same = real.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("sa").alias("x"), F.max("sa").alias("y")).filter("x <> y").select("doc_id")
    member = real.join(same, "doc_id").join(classes.select("sa", "sb", "n", "cls"), ["sa", "sb", "n"]).select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
    whole = components(_edges(found).unionByName(more).unionByName(member))
    named = classes.join(whole, classes["cls"] == whole["node"], "left").select("sa", "sb", "n", F.coalesce("component", "cls").alias("component_id"))
    out = signed.drop("labels", "s1", "s2", "s3").join(named, ["sa", "sb", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs).drop("th")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group (of the least doc_id), all columns as they are; one of rows that repeat an id and its text."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).filter("doc_id is not null")
    rows = store(found.groupBy("doc_id", "th").agg(F.first("kept").alias("kept"), F.count("*").alias("k")).filter("not kept or k > 1"), "dropped")
    i, h = fresh(docs, "id", "hash")
    mine = (docs[f"`{id_col}`"].cast("long") == F.col(i)) & (F.xxhash64(docs[f"`{text_col}`"]) == F.col(h))
    named = lambda x: x.select(F.col("doc_id").alias(i), F.col("th").alias(h))
    out = docs.join(named(rows), mine, "left_anti")
    again = rows.filter("kept")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(named(again), mine, "left_semi").dropDuplicates([id_col, text_col]))
