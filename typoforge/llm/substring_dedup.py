"""Operator 2, substring dedup: words covered by a window of 35 words that starts at more than one place.

repeats.py deals the pieces of documents in which a repeat may start or end to blocks, so that equal ones meet in
one.  A block's pieces, those that overlap in a document joined again, are its reference: every place stands in it
once, indexed by a suffix array.  Each piece is factored greedily against that reference by relative Lempel-Ziv
parsing: from the current word, the longest match with another place becomes a factor (at most LONGEST words; a
word that occurs nowhere else is a literal); matches are looked up at the starts of factors only.  A factor of 35
words or more is a duplicate span.  Windows that cross a factor's end are checked there, each by a look-up of its own.

Words are runs of bytes other than ASCII white space, compared by 64-bit hashes.  A null text has no words;
matches do not cross documents, but count within one; repeated rows are places of their own; a null doc_id is
kept; doc_id is an integer; other columns are ignored; an empty table gives an empty result; a very long text is a
step of its own, and its words are held as hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import SPACED, column, ragged, steps, word_hashes, words
from .repeats import Contexts, Kind, apply_ranges, marked, repeated_ranges

LENGTH = 35
WIDTH = 24
GRAM = 4
#: Words of a factor at most, a power of two over LENGTH.
LONGEST = 64


class Reference:
    """An indexed reference block: the pieces of documents, joined where they overlap, under a suffix array."""

    def __init__(self, c: Contexts) -> None:
        size = np.diff(c.off)
        start = c.pos - c.left
        order = np.lexsort((start, c.text))
        first = np.concatenate([[True], c.text[order][1:] != c.text[order][:-1]])
        # Documents side by side on one line, so that one running maximum finds what overlaps.
        base = np.cumsum(first) * (int(start.max(initial=0)) + int(size.max(initial=0)) + 2)
        begin = base + start[order]
        until = np.maximum.accumulate(begin + size[order])
        before = np.concatenate([[0], until[:-1]])
        new = np.maximum(until - np.maximum(begin, before), 0)
        self.symbols = c.symbols[ragged(c.off[1:][order] - new, new)]
        upto = np.cumsum(new)
        #: Where each context starts in the reference.
        self.start = np.empty(len(order), np.int64)
        self.start[order] = upto - (until - begin)
        piece = np.cumsum(begin > before)
        last = upto[np.flatnonzero(np.append(np.diff(piece), 1))] if len(piece) else np.zeros(0, np.int64)
        #: Where pieces start, and where each place's piece ends.
        self.pieces = np.append(0, last[:-1])[: len(last)]
        self.stop = last[np.repeat(piece - 1, new)]
        self._index()

    def _index(self) -> None:
        """The suffix array of the pieces' first LONGEST words, by doubling, with the ranks that compare any two places."""
        n = len(self.symbols)
        at = np.arange(n)
        self.ranks = [np.unique(self.symbols, return_inverse=True)[1].reshape(-1) + 1]
        width = 1
        while width < LONGEST:
            r = self.ranks[-1]
            behind = np.where(at + width < self.stop, r[np.minimum(at + width, n - 1)], 0)
            self.ranks.append(np.unique(r * (n + 1) + behind, return_inverse=True)[1].reshape(-1) + 1)
            width *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = at

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words places x and y have in common, told apart up to LONGEST at least."""
        common = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            left = np.minimum(self.stop[x] - x, self.stop[y] - y) - common
            i = np.flatnonzero(left > 0)
            i = i[self.ranks[k][x[i] + common[i]] == self.ranks[k][y[i] + common[i]]]
            common[i] += np.minimum(1 << k, left[i])
        return common

    def longest(self, at: np.ndarray) -> np.ndarray:
        """The longest match of each of these places with another one: a neighbour in the suffix array has it."""
        out = np.zeros(len(at), np.int64)
        for step in (-1, 1):
            next_to = self.rank[at] + step
            i = np.flatnonzero((next_to >= 0) & (next_to < len(self.order)))
            out[i] = np.maximum(out[i], self._common(at[i], self.order[next_to[i]]))
        return np.minimum(out, LONGEST)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes) of the greedy factors of all pieces, in order; a word without a match is one of its own, of size 1.

        The pieces are parsed side by side, a factor of each at a time; only where a factor starts is a match looked up.
        """
        starts, sizes, x = [], [], self.pieces
        while len(x):
            size = np.maximum(self.longest(x), 1)
            starts.append(x)
            sizes.append(size)
            more = x + size < self.stop[x]
            x = (x + size)[more]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, size = np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(at)
        return at[order], size[order]

    def spans(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, whether the window that starts there lies in a factor of `length` words or more, and each place's factor's end."""
        n = len(self.symbols)
        starts, sizes = self.factors()
        edge = np.zeros(n + 1, np.int64)
        long = np.flatnonzero(sizes >= length)
        edge[starts[long]] += 1
        edge[starts[long] + sizes[long] - length + 1] -= 1
        return np.cumsum(edge[:-1]) > 0, np.repeat(starts + sizes, sizes)

    def repeated(self, length: int) -> np.ndarray:
        """For each place, whether the window that starts there is repeated: inside a long factor, or checked at a factor's end."""
        out, ends = self.spans(length)
        at = np.arange(len(out))
        crossing = np.flatnonzero((at + length > ends) & (at + length <= self.stop))
        out[crossing] = self.longest(crossing) >= length
        return out


def solve(c: Contexts, kind: Kind) -> np.ndarray:
    """repeated[context, d], by factoring the pieces of the block against it."""
    ref = Reference(c)
    known = ref.repeated(kind.length)
    most = np.minimum(np.diff(c.off) - kind.length, c.left)  # last start of a window, in the context
    least = np.maximum(c.left - (kind.width - 1), 0)
    n = np.maximum(most - least + 1, 0)
    ctx = np.repeat(np.arange(len(c.left)), n)
    at = ragged(least, n)
    out = np.zeros((len(c.left), kind.width), bool)
    out[ctx, c.left[ctx] - at] = known[ref.start[ctx] + at] | (c.copies[ctx] > 1)
    return out


def _words(data: np.ndarray, off: np.ndarray):
    starts, ends, word_off = words(data, off, SPACED)
    return word_hashes(data, starts, ends), word_off, starts, ends


KIND = Kind(LENGTH, WIDTH, GRAM, _words, solve)


def remove_repeated_words(docs: DataFrame, *, kind: Kind = KIND, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (words joined by one space)."""
    rows, ranges = repeated_ranges(docs, kind, id_col=id_col, text_col=text_col, **({} if hot is None else {"hot": hot, "hot_share": 0.0}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches):
            starts, ends, word_off = words(data, off, SPACED)
            gone = marked(rows, word_off)
            total = np.concatenate([[0], np.cumsum(gone)])
            # All kept words, each followed by a space; the last of a text goes without.
            at = np.flatnonzero(~gone)
            size = ends[at] - starts[at]
            upto = np.concatenate([[0], np.cumsum(size + 1)])
            flat = np.full(int(upto[-1]), 0x20, np.uint8)
            flat[ragged(upto[:-1], size)] = data[ragged(starts[at], size)]
            kept_off = word_off - total[word_off]
            raw = memoryview(flat)
            bounds = [(int(upto[a]), int(upto[b]) - 1 if b > a else int(upto[a])) for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
            out = [column(rows, "doc_id"), pa.array(np.diff(word_off)), pa.array(total[word_off[1:]] - total[word_off[:-1]]), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in bounds], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array([bytes(raw[a:b]).decode() for a, b in bounds], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return apply_ranges(rows, ranges, run, f"doc_id {kind_of_id}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
