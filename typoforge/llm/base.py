"""Shared ground of the corpus operators: storage every executor sees, and byte-level text arrays.

Texts are handled as whole UTF-8 byte buffers taken straight from Arrow.  White space, ASCII letters
and digits are single bytes that never occur inside a multi-byte character, so word boundaries found
on bytes are the boundaries found on code points.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a longer document is a step of its own).
STEP_BYTES = 2_000_000
U64 = np.uint64


# --------------------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where there are no other machines."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.typoforge.shared.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="typoforge-")
        spark.conf.set("spark.typoforge.shared.dir", path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back (cuts lineage; survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of store() that no later plan reads."""
    for f in frames:
        if f is not None and getattr(f, "stored_at", None):
            remove(f.sparkSession, f.stored_at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, text: th (64 bits) tells apart rows that repeat a doc_id with another text; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches small enough for texts of any usual length."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == conf.get("spark.typoforge.batch", "10000"):  # Spark's default; a user's own setting stays
        conf.set(_BATCH, "2000")
        conf.set("spark.typoforge.batch", "2000")
    return df.mapInArrow(fn, schema)


# --------------------------------------------------------------------------- Arrow text buffers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def steps(batches: Iterator[pa.RecordBatch], col: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows of about `most` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(col)))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filled(batches: Iterator[pa.RecordBatch], name: str, whole: str) -> Iterator[pa.RecordBatch]:
    """The batches with a last column `whole`: the named text column with nulls as empty texts."""
    for b in batches:
        yield b.append_column(whole, pc.fill_null(column(b, name), ""))


# --------------------------------------------------------------------------- words


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes of words that end at ASCII white space; bytes of lower-cased alphanumeric words; A-Z to a-z.
SPACED = ~_table((0x09, 0x0D), (0x20, 0x20))
ALNUM = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes that stay within a document, and word offsets by document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def owner(off: np.ndarray) -> np.ndarray:
    """For each element of ragged rows with these offsets, its row."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) - np.repeat(ends - lens, lens) + np.repeat(starts, lens)


# --------------------------------------------------------------------------- hashing

_B = U64(0x9E3779B97F4A7C15)


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _B, U64)
    down = np.full(n, U64(_inverse(int(_B))), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n:
        size <<= 1
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Every byte's 64-bit code.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _B)


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base^position, from which span() hashes any range of symbols."""
    up, _ = powers(len(symbols) + 1)
    out = np.empty(len(symbols) + 1, U64)
    out[0] = 0
    np.cumsum(symbols * up[: len(symbols)], dtype=U64, out=out[1:])
    return out


def span(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges starts..ends, alike for equal symbol sequences anywhere."""
    _, down = powers(len(pre))
    return mix((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes of words that are hashed together, eight at a time.
_TOGETHER = 40


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of any length, not linear in their bytes: a bijection is mixed in after every eight.

    span() is for short windows of such hashes only: sums modulo 2^64 are equal for certain sequences of 1,024 symbols.
    """
    n = ends - starts
    out = mix(n.astype(U64) * _B + U64(0x51ED270B7F3A2C95))
    long = np.flatnonzero(n > _TOGETHER)
    raw = memoryview(np.ascontiguousarray(data))
    out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), U64, len(long))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    at = np.flatnonzero((n > 0) & (n <= _TOGETHER))
    for k in range(0, _TOGETHER, 8):
        left = n[at] - k
        chunk = eight[starts[at] + k]
        last = left < 8
        chunk[last] &= (U64(1) << (left[last].astype(U64) * U64(8))) - U64(1)
        out[at] = mix(out[at] ^ mix(chunk ^ U64((k + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF)))
        at = at[left > 8]
        if not len(at):
            break
    return out


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs (touching ranges join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]
