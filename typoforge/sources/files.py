"""A source of file prefixes: listing, heads and byte-capped reads on executors, as rows."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files and bytes of a partition at most (a file counts as OPEN bytes more than are read of it).
FILES = 500
BYTES = 64 << 20
OPEN = 64 << 10

SCHEMA = "path string, bytes long, data binary, truncated boolean"
_ARROW = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("data", pa.binary()), ("truncated", pa.bool_())])


class Files(InputPartition):
    """Paths and sizes of the files of a partition."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str, str]:
    """(file system, path in it, what to put before its paths): any that Arrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner, path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]


class PrefixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.cap, self.lines = int(options.get("prefix", "0")), options.get("lines", "false").lower() == "true"
        self.deep = options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[Files]:
        """Runs of files, by the bytes that are read of them; hidden files and folders are left out, as Spark's sources do."""
        from pyarrow import fs

        where, inner, _ = _filesystem(self.path)
        top = where.get_file_info(inner)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.is_file else where.get_file_info(fs.FileSelector(inner, recursive=self.deep))
        hidden = lambda p: any(x[:1] in ("_", ".") for x in posixpath.relpath(p, inner).split("/")) if p != inner else False
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, self.pattern) and not hidden(f.path))
        out, now, size = [], [], 0
        for f in files:
            cost = OPEN + min(f[1], self.cap)
            if now and (len(now) == FILES or size + cost > BYTES):
                out.append(Files(now))
                now, size = [], 0
            now.append(f)
            size += cost
        return [*out, Files(now)] if now else out or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        """Each file's first bytes, as many as asked for; with `lines`, a file that has more is cut behind its last line feed."""
        where, _, scheme = _filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for path, size in part.files:
            data, more = b"", size > self.cap
            if self.cap and size:
                with where.open_input_stream(path) as f:
                    data = f.read(self.cap)
            if more and self.lines and (at := data.rfind(b"\n")) >= 0:
                data = data[: at + 1]
            rows.append((scheme + path, size, data, more))
            held += len(data)
            if held > BYTES // 4:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FilePrefixes(DataSource):
    """spark.read.format("file_prefixes"): path, bytes, data (the first `prefix` bytes), truncated.

    Options: pattern (of file names), prefix (0: none is read), lines (cut at the last line feed), recursive.  Files are
    listed once, without being opened; executors read the prefixes.  Paths are local or of a file system that Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_prefixes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(dict(self.options))


def file_prefixes(spark: SparkSession, path: str, *, pattern: str = "*", prefix: int = 0, lines: bool = False, recursive: bool = True) -> DataFrame:
    """The files below a path (or one file) with their first bytes."""
    spark.dataSource.register(FilePrefixes)
    return spark.read.format("file_prefixes").option("pattern", pattern).option("prefix", prefix).option("lines", lines).option("recursive", recursive).load(path)


def text_of(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 (a character that is cut) becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def read_capped(spark: SparkSession, path: str, *, pattern: str = "*.jsonl", cap: int = 10 << 20) -> DataFrame:
    """path, bytes, text, truncated: files of `cap` bytes or less whole, others up to their last line feed within it."""
    return file_prefixes(spark, path, pattern=pattern, prefix=cap, lines=True).select("path", "bytes", text_of(F.col("data")).alias("text"), "truncated")


def capped_lines(spark: SparkSession, path: str, *, pattern: str = "*.jsonl", cap: int = 10 << 20) -> DataFrame:
    """path, number (from 0), line, truncated: the lines of read_capped(), blank ones left out."""
    lines = read_capped(spark, path, pattern=pattern, cap=cap).select("path", "truncated", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    return lines.filter(F.trim("line") != "").select("path", "number", F.regexp_replace("line", "\r$", "").alias("line"), "truncated")
