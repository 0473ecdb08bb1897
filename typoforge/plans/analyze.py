"""Code analysis over tables: Arrow-batched wrappers of the scope resolver.

Filter and select before these operators: Spark does not push either through them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOKEN
from . import scopes


def extract_names(samples: DataFrame, *, by: str = "sample_index", code: str = "code") -> DataFrame:
    """by, name, scope_id, kind, line, col of every renameable definition; sources that don't parse give no row."""
    kind = samples.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            with scopes.shapes_remembered():
                for i, source in zip(b[by], b[code], strict=True):
                    try:
                        rows += [(i, p.name, p.scope, p.kind, p.line, p.col) for p in scopes.definitions(source or "")]
                    except scopes.UnparseableCodeError:
                        continue
            yield pd.DataFrame(rows, columns=[by, "name", "scope_id", "kind", "line", "col"])

    return samples.select(by, code).mapInPandas(run, f"{by} {kind}, name string, scope_id int, kind string, line int, col int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_of(code: pd.Series) -> pd.Series:
    """The distinct names of a source that can be renamed, sorted; null if it doesn't parse."""

    def one(source: str | None) -> list[str] | None:
        try:
            return scopes.renameable_names(source or "")
        except scopes.UnparseableCodeError:
            return None

    with scopes.shapes_remembered():
        return pd.Series([one(c) for c in code], dtype=object)


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    def one(source: str | None) -> bool:
        try:
            scopes.analyse(source or "")
        except scopes.UnparseableCodeError:
            return False
        return True

    return code.map(one)


@F.pandas_udf(T.StringType())
def rename_names(code: pd.Series, names: pd.Series) -> pd.Series:
    """code after a map of renames; null if it doesn't parse."""

    def one(source, mapping):
        try:
            return scopes.rename(source or "", dict(mapping or {}))
        except scopes.UnparseableCodeError:
            return None

    with scopes.shapes_remembered():
        return pd.Series([one(c, m) for c, m in zip(code, names, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def rename_binding(code: pd.Series, line: pd.Series, col: pd.Series, new: pd.Series) -> pd.Series:
    """code after renaming the one binding defined at a position."""

    def one(source, r, c, name):
        try:
            return scopes.rename_at(source or "", int(r), int(c), name)
        except scopes.UnparseableCodeError:
            return None

    return pd.Series([one(*x) for x in zip(code, line, col, new, strict=True)], dtype=object)


def code_tokens(code: Column) -> Column:
    """array<struct<text,row,col,kind,is_name>> of a source."""

    @F.arrow_udf(f"array<{TOKEN.simpleString()}>")
    def run(code: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for s in code.to_pylist():
            rows += [(t.text, t.row, t.col, t.kind, t.is_name) for t in scopes.code_tokens(s or "")]
            ends.append(len(rows))
        flat = list(zip(*rows, strict=True)) if rows else [()] * 5
        columns = [pa.array(c, k) for c, k in zip(flat, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=TOKEN.names))

    return run(code)


@F.pandas_udf(T.IntegerType())
def count_name(code: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([scopes.count_name(c or "", n) for c, n in zip(code, name, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def count_names(code: pd.Series, names: pd.Series) -> pd.Series:
    """count_name of each of an array of names, by one reading of the source."""
    return pd.Series([scopes.count_names(c or "", n) for c, n in zip(code, names, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def substitute(code: pd.Series, edits: pd.Series) -> pd.Series:
    """code with tokens (row, col, old, new) replaced in place."""
    return pd.Series([scopes.substituted(c or "", [(e["row"], e["col"], e["old"], e["new"]) for e in x]) for c, x in zip(code, edits, strict=True)], dtype=object)


def positions(samples: DataFrame, *, by: str = "sample_index", code: str = "code") -> DataFrame:
    """by, ordinal, name, line, col: definitions in order, for position_diff()."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("line", "col", "name")
    return extract_names(samples, by=by, code=code).select(by, "name", "line", "col", F.row_number().over(w).alias("ordinal"))


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest text that both hold; of equals the first in a, then in b."""
    n, m = len(a), len(b)
    if n == 1 or m == 1:
        i, j = (0, b.find(a)) if n == 1 else (a.find(b), 0)
        return (0, 0, 0) if i < 0 or j < 0 else (i, j, 1)
    most, wide = min(n, m), not (a.isascii() and b.isascii())
    first, last, bits = ("utf-32-be", "utf-32-le", 32) if wide else ("ascii", "ascii", 8)
    # How much both begin and end with: numbers of their characters differ from the highest character that does.
    x = int.from_bytes(a[:most].encode(first), "big") ^ int.from_bytes(b[:most].encode(first), "big")
    y = int.from_bytes(a[n - most :].encode(last), "little") ^ int.from_bytes(b[m - most :].encode(last), "little")
    common = most - (min(x.bit_length(), y.bit_length()) + bits - 1) // bits
    size, at, i = max(common, 1) - 1, 0, 0  # one more is there, so the first place of the longest is met below
    while i + size < n:
        if a[i : i + size + 1] in b:
            size, at = size + 1, i
        else:
            i += 1
    return at, b.find(a[at : at + size]), size


def differing_spans(a: str, b: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end in a, start, end in b) of what lies between the blocks that difflib.SequenceMatcher finds without junk, in order."""
    todo, blocks = [(0, len(a), 0, len(b))] if a and b else [], [(len(a), len(b), 0)]
    while todo:
        s, e, t, u = todo.pop()
        i, j, size = longest_block(a[s:e], b[t:u])
        if size:
            i, j = s + i, t + j
            blocks.append((i, j, size))
            if s < i and t < j:
                todo.append((s, i, t, j))
            if i + size < e and j + size < u:
                todo.append((i + size, e, j + size, u))
    at, bt = 0, 0
    for i, j, size in sorted(blocks):
        if i > at or j > bt:
            yield at, i, bt, j
        at, bt = i + size, j + size


def line_diff(before: str | Column, after: str | Column) -> Column:
    """array<struct<line,op,text>> of what differs, line by line: op is removed or added, text the differing span.

    Spans lie between the blocks of difflib.SequenceMatcher: the longest text in common first, then either side of it.
    """

    @F.arrow_udf("array<struct<line:int,op:string,text:string>>")
    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        lines, ops, texts, ends = [], [], [], [0]
        for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True):
            for i, (p, q) in enumerate(zip_longest((a or "").split("\n"), (b or "").split("\n"), fillvalue=""), 1):
                if p == q:
                    continue
                for s, e, t, u in differing_spans(p, q):
                    for op, text in (("removed", p[s:e]), ("added", q[t:u])):
                        if text:
                            lines.append(i)
                            ops.append(op)
                            texts.append(text)
            ends.append(len(lines))
        columns = [pa.array(c, k) for c, k in ((lines, pa.int32()), (ops, pa.string()), (texts, pa.string()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["line", "op", "text"]))

    return run(F.col(before) if isinstance(before, str) else before, F.col(after) if isinstance(after, str) else after)


def align_to_subwords(samples: DataFrame, *, ids=None, start: int = 0, end: int = 1, most: int = 512) -> DataFrame:
    """sample_index, pos, input_id, word_id: subwords of the code tokens between a start and an end id (whose word is
    null), cut at `most`.  ids gives a token's subwords (its UTF-8 bytes unless given)."""
    from ..operators.encode import byte_ids

    ids = ids or byte_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, inputs, words = [], [], [], []
            for i, source in zip(b["sample_index"].to_pylist(), b["code"].to_pylist(), strict=True):
                inner, owners = [], []
                for w, t in enumerate(scopes.code_tokens(source or "")):
                    if len(inner) >= most - 2:
                        break
                    x = ids(t.text)
                    inner += x
                    owners += [w] * len(x)
                inner, owners = inner[: most - 2], owners[: most - 2]
                inputs += [start, *inner, end]
                words += [None, *owners, None]
                at += [i] * (len(inner) + 2)
                pos += range(len(inner) + 2)
            columns = [pa.array(at, pa.int64()), *(pa.array(c, pa.int32()) for c in (pos, inputs, words))]
            yield pa.RecordBatch.from_arrays(columns, names=["sample_index", "pos", "input_id", "word_id"])

    return samples.select("sample_index", "code").mapInArrow(run, "sample_index long, pos int, input_id int, word_id int")


def marked_subwords(code: str | Column, *, ids, start: int = 0, end: int = 1, most: int = 512) -> Column:
    """array<struct<input_id,name>>: the subwords of align_to_subwords(), in order.

    name is the token's text on the first subword of a name token, empty on that of any other, and null elsewhere.
    """

    @F.arrow_udf("array<struct<input_id:int,name:string>>")
    def run(code: pa.Array) -> pa.Array:
        inputs, names, ends = [], [], [0]
        for source in code.to_pylist():
            own, marks = [], []
            for t in scopes.code_tokens(source or ""):
                if len(own) >= most - 2:
                    break
                x = ids(t.text)
                if len(x):
                    own += x
                    marks += [t.text if t.is_name else "", *[None] * (len(x) - 1)]
            inputs += [start, *own[: most - 2], end]
            names += [None, *marks[: most - 2], None]
            ends.append(len(inputs))
        each = pa.StructArray.from_arrays([pa.array(inputs, pa.int32()), pa.array(names, pa.string())], names=["input_id", "name"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return run(code)
