"""Operator 1, suffix-array dedup: bytes covered by a 200-byte string that starts at more than one place.

repeats.py brings together the distinct contexts in which a repeat may start or end.  For each block of them,
one suffix array of their right sides and reversed left sides is built by linear grouping construction over
symbols of BLOCK_BYTES bytes ranked in byte order; neighbours' common prefixes, in bytes, then give for every distance d
which contexts agree on all 200 bytes.

Linear grouping construction (grouping_suffix_array): suffixes start in groups by first symbol.  Groups are
taken in descending order; each member gets its previous-smaller pointer, the nearest suffix to the left in a
lower group, and the suffixes pointed at move up within their groups, by how many members point at them, so
that in the end groups are ordered by Lyndon prefix.  A second pass emits the order of each group from the
order already emitted.  Nothing is renamed or sorted recursively.

Texts are UTF-8 bytes; a null text is empty; matches do not cross documents, but count within one; repeated
rows are places of their own; a null doc_id is kept; doc_id is an integer; other columns are ignored, whatever their
names; an empty table gives an empty result; a very long text is a step of its own.  Memory: a step of texts, or the
contexts of one partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import BYTE_CODE, column, ragged, steps
from .repeats import Contexts, Kind, apply_ranges, marked, repeated_ranges

LENGTH = 200
WIDTH = 128
GRAM = 24
#: Bytes of a symbol of the suffix array.
BLOCK_BYTES = 25


def grouping_suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence whose last symbol is unique and the least."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    by: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by.setdefault(c, []).append(i)
    order = sorted(by)
    members = [by[c] for c in order]
    name = {c: g for g, c in enumerate(order)}
    group = [name[c] for c in symbols]
    size = [len(m) for m in members]
    lower = list(range(-1, len(order) - 1))
    higher = [*range(1, len(order)), -1]
    done = [False] * len(order)
    smaller = [-1] * n

    def move(old: int, js: list[int]) -> None:
        """Put these members of a group into a new group just above it."""
        new = len(members)
        members.append(js)
        size.append(len(js))
        size[old] -= len(js)
        done.append(False)
        above = higher[old]
        lower.append(old)
        higher.append(above)
        higher[old] = new
        if above >= 0:
            lower[above] = new
        for j in js:
            group[j] = new

    g = len(order) - 1
    while g >= 0:
        done[g] = True
        n_members = size[g]
        if n_members == 1:
            # One member points at one suffix, which moves up unless it is alone in its group.
            i = members[g][0] if len(members[g]) == 1 else next(i for i in members[g] if group[i] == g)
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and size[group[j]] > 1:
                move(group[j], [j])
        elif n_members:
            if len(members[g]) != n_members:
                members[g] = [i for i in members[g] if group[i] == g]
            members[g].sort()
            pointed: dict[int, int] = {}
            for i in members[g]:
                j = i - 1
                while j >= 0 and done[group[j]]:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            for times in sorted(set(pointed.values()), reverse=True):
                moved: dict[int, list[int]] = {}
                for j, k in pointed.items():
                    if k == times:
                        moved.setdefault(group[j], []).append(j)
                for old, js in moved.items():
                    if len(js) != size[old]:  # else all that is left moves: the group stays where it is
                        move(old, js)
        g = lower[g]

    place, at, g = [0] * len(members), 0, 0
    while g >= 0:  # group 0, of the last symbol alone, is the lowest
        place[g] = at
        at += size[g]
        g = higher[g]
    out = [-1] * n
    out[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = smaller[j]
    return out


def _padded(data: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Rows of bytes data[at:at+n], reversed if `back`, with zeros behind."""
    out = np.zeros((len(at), width), np.uint8)
    row = np.repeat(np.arange(len(at)), n)
    col = ragged(np.zeros(len(at), np.int64), n)
    out[row, col] = data[at[row] + (n[row] - 1 - col if back else col)]
    return out


def _common(rows: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes, in bytes, of neighbours in this order (the first has none)."""
    differ = rows[order[1:]] != rows[order[:-1]]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[-1], np.minimum(n, np.minimum(lens[order[1:]], lens[order[:-1]]))])


def solve(c: Contexts, kind: Kind) -> np.ndarray:
    """repeated[context, d]: whether the window that starts d bytes before the anchor occurs in another context, or in a copy."""
    m, reach = len(c.left), kind.width
    right_len = np.minimum(np.diff(c.off) - c.left, kind.length)
    w_right, w_left = -(-kind.length // BLOCK_BYTES) * BLOCK_BYTES, -(-(reach - 1) // BLOCK_BYTES) * BLOCK_BYTES
    right = _padded(c.data, c.off[:-1] + c.left, right_len, w_right, False)
    left = _padded(c.data, c.off[:-1], c.left, w_left, True)
    blocks = np.concatenate([right, left], axis=1).view(f"S{BLOCK_BYTES}")
    rank = np.unique(blocks, return_inverse=True)[1].reshape(blocks.shape) + 2
    n_right, ones = w_right // BLOCK_BYTES, np.ones((m, 1), np.int64)
    text = np.concatenate([rank[:, :n_right], ones, rank[:, n_right:], ones], axis=1)
    sa = np.array(grouping_suffix_array([*text.reshape(-1).tolist(), 0]), np.int64)[1:]
    at = sa % text.shape[1]
    by_right, by_left = sa[at == 0] // text.shape[1], sa[at == n_right + 1] // text.shape[1]
    lcp_right, lcp_left = _common(right, right_len, by_right), _common(left, c.left, by_left)
    out = np.zeros((m, reach), bool)
    a, b = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(reach):
        fits = (c.left >= d) & (right_len >= kind.length - d)
        a[by_right] = np.cumsum(lcp_right < kind.length - d)
        b[by_left] = np.cumsum(lcp_left < d)
        i = np.flatnonzero(fits)
        if len(i):
            _, where, n = np.unique(a[i] * (m + 1) + b[i], return_inverse=True, return_counts=True)
            out[i, d] = (n[where.reshape(-1)] > 1) | (c.copies[i] > 1)
    return out


def _bytes(data: np.ndarray, off: np.ndarray):
    return BYTE_CODE[data], off, None, None


KIND = Kind(LENGTH, WIDTH, GRAM, _bytes, solve)


def remove_repeats(docs: DataFrame, *, kind: Kind = KIND, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans (byte ranges) and kept (binary)."""
    rows, ranges = repeated_ranges(docs, kind, id_col=id_col, text_col=text_col, **({} if hot is None else {"hot": hot, "hot_share": 0.0}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches):
            gone = marked(rows, off)
            total = np.concatenate([[0], np.cumsum(gone)])
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = off[1:-1][off[1:-1] < len(gone)]
            first[inner] = gone[inner]
            runs = np.concatenate([[0], np.cumsum(first)])
            removed = total[off[1:]] - total[off[:-1]]
            raw = memoryview(np.ascontiguousarray(data))
            digests, kept = [], []
            for d, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                rest = data[s:e][~gone[s:e]].tobytes() if removed[d] else raw[s:e]
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(bytes(rest))
            out = [column(rows, "doc_id"), pa.array(np.diff(off)), pa.array(removed), pa.array(runs[off[1:]] - runs[off[:-1]]), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return apply_ranges(rows, ranges, run, f"doc_id {kind_of_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


__all__ = ["KIND", "grouping_suffix_array", "remove_repeats", "solve"]
