"""Operator 6, token ids in a binary file format of frequency-ranked, byte-aligned variable-length codes.

Documents are dealt out in ranges of ascending doc_id (equal ids by text), sorted, encoded with the
tokenizers library (each distinct word of a worker once while kept) and closed with an end id.  A segment holds half a
million ids of consecutive documents and is decodable alone:

    magic "TFSV" | u32 n_docs | u32 n_ids | u32 n_ranks | u32 ranks[] | u32 lengths[n_docs]
    | control bytes (four 2-bit byte counts each) | data bytes

ranks[] lists the segment's ids by descending frequency (ties by id); an id is coded as its rank in 1 to 4
bytes, and the byte counts live apart in the control bytes, so decoding is a numpy table lookup over whole
arrays.  Segments are rows of a Parquet table (part, seq, n_docs, n_ids, first, doc_ids, segment), written by
Spark's committer in the shared folder, so a lost executor's task is simply written again.

Skew: ranges of doc_id are balanced by sampling; ties of one id only share a range.  Memory: a segment and a
text.  Defined cases: a null or empty text has only the end id; null doc_ids come first; rows that repeat are
all written; extra columns are ignored, whatever their names; an empty table gives an empty file; a very long text is a
step of its own and may fill a segment alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, map_arrow, ragged, shared_dir, steps
from .vocab import WORD_BPE, indexed, keep_only, stored, word_bpe, word_tiles

MAGIC = b"TFSV"
SEGMENT_IDS = 500_000
END_ID = 1
STEP = 6_000_000
#: For each control byte: the byte counts of its four ids.
COUNTS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment of these ids, of documents of these lengths."""
    n = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(n)
    order = np.lexsort((used, -n[used]))
    rank = np.zeros(len(n), np.uint32)
    rank[used[order]] = np.arange(len(used), dtype=np.uint32)
    code = rank[ids]
    size = (code > 0xFF).astype(np.uint8) + (code > 0xFFFF) + (code > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = size
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    lanes = code.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = lanes[np.arange(4) <= size[:, None]]
    head = np.array([len(lengths), len(ids), len(used)], "<u4").tobytes()
    return b"".join([MAGIC, head, used[order].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()])


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents) of a segment."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_ids, n_ranks = np.frombuffer(segment, "<u4", 3, 4).tolist()
    at = 16
    ranks = np.frombuffer(segment, "<u4", n_ranks, at)
    at += 4 * n_ranks
    lengths = np.frombuffer(segment, "<u4", n_docs, at)
    at += 4 * n_docs
    control = np.frombuffer(segment, np.uint8, -(-n_ids // 4), at)
    at += len(control)
    data = np.frombuffer(segment, np.uint8, offset=at)
    if not n_ids:
        return np.zeros(0, np.uint32), lengths
    size = COUNTS[control].reshape(-1)[:n_ids]
    first = np.cumsum(size) - size
    code = data[first].astype(np.uint32)
    for k in range(1, int(size.max())):
        more = np.flatnonzero(size > k)
        code[more] |= data[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks[code], lengths


def _encode(model: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        docs: list[pa.Array] = []

        def flush():
            nonlocal seq, first, ids, lens, docs
            flat, lengths, names = np.concatenate(ids), np.concatenate(lens), pa.concat_arrays(docs)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([pack(flat, lengths)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "first", "doc_ids", "segment"],
            )
            seq, first, ids, lens, docs = seq + 1, first + len(flat), [], [], []
            return row

        words = stored("words", model)
        keep_only(words)
        for rows, data, off in steps(batches, most=STEP):
            special = [i for i, t in enumerate(column(rows, "text").to_pylist()) if "<|" in t] if b"<|" in memoryview(np.ascontiguousarray(data)).tobytes() else []
            flat, tile_off = word_tiles(data, off)
            idx, keys = indexed(flat)
            row = words.rows(keys)[idx]
            size = words.len[row]
            out = words.ids[ragged(words.start[row], size)]
            upto = np.concatenate([[0], np.cumsum(size)])[tile_off]
            if special:  # may hold strings of special tokens, which the library reads before lower-casing
                parts = [out[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                for i, e in zip(special, word_bpe(model).encode_batch_fast([column(rows, "text")[i].as_py() for i in special], add_special_tokens=False), strict=True):
                    parts[i] = np.asarray(e.ids, np.int32)
                out, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            lengths = np.diff(upto) + 1
            whole = np.insert(out, upto[1:], end_id)
            ids.append(whole.astype(np.uint32))
            lens.append(lengths)
            docs.append(column(rows, "doc_id"))
            if sum(map(len, ids)) >= segment_ids:
                yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, *, model: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all texts, in ascending doc_id order, as a file of segments."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = map_arrow(dealt, _encode(model, end_id, segment_ids), f"part int, seq int, n_docs long, n_ids long, first long, doc_ids array<{kind}>, segment binary")
    made.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 and, if asked for, ids of every document of a file."""
    table = spark.read.parquet(path)
    # One number a part: as many rows as the file has parts.
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, base = 0, {}
    for p in sorted(totals):
        base[p], before = before, before + totals[p]
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths = unpack(column(b, "segment")[i].as_buffer())
                off = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64, len(lengths))
                start = off[:-1] + base[column(b, "part")[i].as_py()] + column(b, "first")[i].as_py()
                out = [column(b, "doc_ids")[i].values, pa.array(start), pa.array(np.diff(off)), pa.array(crc)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    narrow = table.select("part", "first", "doc_ids", "segment")
    return narrow.mapInArrow(run, schema)


def ids_digest(docs: DataFrame, **options) -> DataFrame:
    """Write the ids, read the file back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)
