"""Operator 10, SentencePiece encoding and decoding with seeded merge-dropout.

Encoding is the merge agenda of BPE: adjacent symbols whose join is a piece are candidates, the best score
(leftmost of equals) is taken first, and each candidate that comes up is skipped with probability `dropout`
by a keyed hash.  The key of an occurrence is a hash of (seed, document id, number of the pre-token in the
document), so every occurrence has a segmentation of its own, runs and partitionings agree, and an executor's
retry gives the same ids.  With dropout 0 the ids are the library's own.  Characters outside the vocabulary, and
a literal U+2581, become byte pieces, so decoding gives back every text byte for byte.

Draws of an occurrence with key h, candidate t counted from 0, `cut` = dropout * 2^16:
up to SHORT characters, the first min(16, characters + 1) are 16-bit lanes of mix(h + 1), mix(h + 2), ...;
these bits together are the occurrence's mask, and later draws are the low 16 bits of mix(mix(mask + 1) + t).
Longer pre-tokens draw the low 16 bits of mix(h + t).  So equal (pre-token, mask) are encoded once a step.

The agendas of all pre-tokens of a step advance together, one candidate of each at a time, as array operations.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows that repeat are alike; a null
id is an id of its own; other columns are ignored; an empty table gives an empty result; a very long text is a
step of its own; memory is a step of texts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, column, map_arrow, mix, ragged, steps, text_bytes
from .vocab import PIECES, fragments, keep_only, pieces

DROPOUT = 0.1
SEED = 20260
#: Characters up to which draws are a mask of 16 bits.
SHORT = 12
#: Characters of the widths in which agendas advance together; longer pre-tokens have one alone.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 21, 28, 40, 64)
#: Agendas that advance together at most.
TOGETHER = 16_384
_NONE = np.int32(2**31 - 1)
_KEY = U64(0x9E3779B97F4A7C15)


class Pairs:
    """The joins of adjacent pieces, as an open-addressed table: (left, right) to (rank of its score, joined piece)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bits = max(16, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.pieces = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        rank, piece = np.array(list(pairs.values()), np.int32).T
        at, left = self._place(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = key[free]  # of those with one place, the last stays
            self.ranks[at[free]], self.pieces[at[free]] = rank[free], piece[free]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U64) * _KEY) >> U64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces of joins that exist."""
        key = left.astype(np.int64) << 32 | right
        at = self._place(key)
        while len(other := np.flatnonzero(self.keys[at] != key)):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
        return self.pieces[at]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of joins, _NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = self._place(key)
        out = self.ranks[at]
        held = self.keys[at]
        other = np.flatnonzero(held != key)
        out[other] = _NONE
        other = other[held[other] >= 0]
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            held = self.keys[at[other]]
            hit = held == key[other]
            out[other[hit]] = self.ranks[at[other[hit]]]
            other = other[~hit & (held >= 0)]
        return out


class Codec:
    """Encoder and decoder of a SentencePiece BPE model."""

    def __init__(self, model: str = PIECES, dropout: float = DROPOUT, seed: int = SEED) -> None:
        sp = pieces(model)
        n = sp.get_piece_size()
        self.seed, self.cut = seed, round(dropout * 65536)
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.id = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        score = {i: -sp.get_score(i) for i in self.id.values()}
        rank = {x: k for k, x in enumerate(sorted(set(score.values())))}
        self.rank = {i: rank[x] for i, x in score.items()}
        self.pairs = Pairs({(self.id[p[:k]], self.id[p[k:]]): (self.rank[i], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id})
        # Symbols: pieces by id; from `unknown` on, code points that never join; `pad` behind a pre-token's end.
        self.unknown, self.pad = n, n + 0x110000
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1 and p != "▁":
                self.symbol[ord(p)] = i
        self.symbol[0x20] = self.id["▁"]
        self.names = {i: p for p, i in self.id.items()}
        raw = [b""] * n
        for p, i in self.id.items():
            raw[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _masks(self, h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The first draws of short pre-tokens with these keys, as bits."""
        out = np.zeros(len(h), np.int64)
        for k in range(16):
            if k % 4 == 0:
                lanes = mix(h + U64(k // 4 + 1))
            out |= ((lanes >> U64(16 * (k % 4)) & U64(0xFFFF)) < self.cut).astype(np.int64) << k
        return out & ((1 << np.minimum(chars + 1, 16)) - 1)

    def _skips(self, t: int, seeds: np.ndarray, later: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Whether the t-th candidate of each agenda is skipped; seeds are masks of short pre-tokens, else keys."""
        drawn = (mix(later + U64(t)) & U64(0xFFFF)) < self.cut
        if t < 16:
            masked = (chars <= SHORT) & (t < np.minimum(chars + 1, 16))
            drawn = np.where(masked, (seeds >> U64(t) & U64(1)).astype(bool), drawn)
        return drawn

    def _together(self, sym: np.ndarray, seeds: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The symbols of pre-tokens (rows, padded) after their agendas are done."""
        rows, width = sym.shape
        out = np.full((rows, width), self.pad, np.int32)
        live = np.arange(rows)
        later = np.where(chars <= SHORT, mix(seeds + U64(1)), seeds)
        rank = np.full((rows, width), _NONE, np.int32)
        rank[:, :-1] = self.pairs.find(sym[:, :-1].reshape(-1), sym[:, 1:].reshape(-1)).reshape(rows, width - 1)
        t = 0
        while len(live):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(live)), best]
            done = value == _NONE
            if done.any():
                out[live[done], : sym.shape[1]] = sym[done]
                go = ~done
                live, sym, rank, best, value, seeds, later, chars = (x[go] for x in (live, sym, rank, best, value, seeds, later, chars))
                if not len(live):
                    break
            if sym.shape[1] > 2 and (sym[:, -1] == self.pad).all():
                sym, rank = sym[:, :-1], np.ascontiguousarray(rank[:, :-1])
            r, w = np.arange(len(live)), sym.shape[1]
            skipped = self._skips(t, seeds, later, chars) if self.cut else np.zeros(len(live), bool)
            t += 1
            rank[r[skipped], best[skipped]] = _NONE
            join = np.flatnonzero(~skipped)
            if not len(join):
                continue
            at = best[join]
            # The joined symbol stands at `at`; all behind the right one move up.
            to = np.arange(w)[None, :] + (np.arange(w)[None, :] > np.where(skipped, w, best)[:, None])
            last = to[:, -1] == w
            to[last, -1] = w - 1
            flat = to + (r * w)[:, None]
            piece = self.pairs.joined(sym[join, at], sym[join, at + 1])
            sym, rank = sym.reshape(-1)[flat], rank.reshape(-1)[flat]
            sym[last, -1], rank[last, -1] = self.pad, _NONE
            sym[join, at] = piece
            rank[:, -1] = _NONE
            right = np.flatnonzero(at < w - 1)
            rank[join[right], at[right]] = self.pairs.find(sym[join[right], at[right]], sym[join[right], at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[join[left], at[left] - 1] = self.pairs.find(sym[join[left], at[left] - 1], sym[join[left], at[left]])
        return out

    def _alone(self, sym: list[int], key: int) -> list[int]:
        """One long pre-token: its agenda as a heap."""
        n, names = len(sym), self.names
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def candidate(i: int, j: int):
            if sym[i] < self.unknown and sym[j] < self.unknown and (got := self.id.get(names[sym[i]] + names[sym[j]])) is not None:
                return self.rank[got], i, sym[i], sym[j], got
            return None

        agenda = [c for i in range(n - 1) if (c := candidate(i, i + 1))]
        heapq.heapify(agenda)
        t = 0
        while agenda:
            _, i, a, b, got = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            if self.cut:
                skipped = int(mix(np.array([(key + t) & 0xFFFFFFFFFFFFFFFF], U64))[0]) & 0xFFFF < self.cut
                t += 1
                if skipped:
                    continue
            sym[i], sym[j] = got, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if 0 <= x and y < n and (c := candidate(x, y)):
                    heapq.heappush(agenda, c)
        return [s for s in sym if s >= 0]

    def _segment(self, code: np.ndarray, off: np.ndarray, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of pre-tokens `which` (code points code[off[w]:off[w + 1]]) with these seeds."""
        chars = np.diff(off)[which]
        parts, where = [], []
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((chars > low) & (chars <= width))
            low = width
            for s in range(0, len(group), TOGETHER):
                rows = group[s : s + TOGETHER]
                n = chars[rows]
                sym = np.full((len(rows), width), self.pad, np.int32)
                sym[np.arange(width)[None, :] < n[:, None]] = self.symbol[code[ragged(off[which[rows]], n)]]
                parts.append(self._together(sym, seeds[rows], n))
                where.append(rows)
        lens = np.zeros(len(which), np.int64)
        made = [p != self.pad for p in parts]
        for rows, m in zip(where, made, strict=True):
            lens[rows] = m.sum(axis=1)
        rest = np.flatnonzero(chars > low)
        alone = [np.array(self._alone(self.symbol[code[off[which[i]] : off[which[i] + 1]]].tolist(), int(seeds[i])), np.int32) for i in rest.tolist()]
        lens[rest] = [len(x) for x in alone]
        start = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), np.int32)
        for rows, p, m in zip(where, parts, made, strict=True):
            out[ragged(start[rows], lens[rows])] = p[m]
        for i, x in zip(rest.tolist(), alone, strict=True):
            out[start[i] : start[i] + len(x)] = x
        strange = np.flatnonzero(out >= self.unknown)
        if not len(strange):
            return out, lens
        # Characters outside the vocabulary become their bytes' pieces.
        spelled, index = np.unique(out[strange], return_inverse=True)
        spelled = [[self.byte[b] for b in chr(x - self.unknown).encode()] for x in spelled.tolist()]
        size = np.array([len(x) for x in spelled])[index.reshape(-1)]
        row = np.repeat(np.arange(len(which)), lens)
        lens = lens + np.bincount(row[strange], size - 1, len(which)).astype(np.int64)
        each = np.ones(len(out), np.int64)
        each[strange] = size
        wide = np.repeat(out, each)
        wide[ragged((np.cumsum(each) - each)[strange], size)] = np.concatenate([spelled[k] for k in index.reshape(-1).tolist()])
        return wide, lens

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); keys: see document_key()."""
        keep_only()
        flat, off = fragments(texts)
        if not len(flat):
            return np.zeros(0, np.int32), off
        coded = flat.dictionary_encode()
        idx = coded.indices.to_numpy().astype(np.int64)
        data, at = text_bytes(coded.dictionary)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars_off = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        chars = np.diff(chars_off)[idx]
        if self.cut:
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            seeds = mix(keys[doc] + (np.arange(len(idx)) - off[doc]).astype(U64) * _KEY)
            short = np.flatnonzero(chars <= SHORT)
            seeds[short] = self._masks(seeds[short], chars[short]).astype(U64)
        else:
            seeds, short = np.zeros(len(idx), U64), np.arange(len(idx))
        pair, inverse = np.unique(idx[short] << 16 | seeds[short].astype(np.int64), return_inverse=True)
        long = np.setdiff1d(np.arange(len(idx)), short, assume_unique=True)
        row = np.empty(len(idx), np.int64)
        row[short], row[long] = inverse.reshape(-1), len(pair) + np.arange(len(long))
        ids, size = self._segment(code, chars_off, np.concatenate([pair >> 16, idx[long]]), np.concatenate([(pair & 0xFFFF).astype(U64), seeds[long]]))
        start = np.cumsum(size) - size
        upto = np.concatenate([[0], np.cumsum(size[row])])
        return ids[ragged(start[row], size[row])], upto[off]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets by text): byte pieces give bytes, and the dummy space goes."""
        size = self.raw_len[ids]
        upto = np.concatenate([[0], np.cumsum(size)])[off]
        data = self.raw[ragged(self.raw_start[ids], size)]
        full = np.diff(upto) > 0
        keep = np.ones(len(data), bool)
        keep[upto[:-1][full]] = False
        return data[keep], upto - np.concatenate([[0], np.cumsum(full)])


@functools.lru_cache(4)
def codec(model: str, dropout: float, seed: int) -> Codec:
    return Codec(model, dropout, seed)


def document_key(seed: int, doc_id) -> int:
    """The 64-bit key of a document's draws."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")


def _keys(seed: int, rows: pa.RecordBatch) -> np.ndarray:
    return np.array([document_key(seed, x) for x in column(rows, "doc_id").to_pylist()], U64)


def encode_pieces(docs: DataFrame, *, model: str = PIECES, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: array<int> of every row of docs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout, seed)
        for rows, _, _ in steps(batches):
            ids, off = c.encode(column(rows, "text"), _keys(seed, rows))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, *, model: str = PIECES, ids_col: str = "ids") -> DataFrame:
    """encoded with its ids replaced by text."""
    names = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, 0.0, 0)
        for b in batches:
            lists = column(b, ids_col)
            ids = np.asarray(lists.flatten())
            off = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            data, at = c.decode(ids, off)
            text = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), text], names=[*names, "text"])

    schema = encoded.select(*names).schema.add("text", "string")
    return map_arrow(encoded.select(*names, ids_col), run, schema)


def pieces_digest(docs: DataFrame, *, model: str = PIECES, dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Encode, decode, compare: doc_id, n_bytes, n_tokens, ids_crc32 (little-endian u32), lossless; with_ids adds ids."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout, seed)
        for rows, data, off in steps(batches):
            ids, at = c.encode(column(rows, "text"), _keys(seed, rows))
            back, back_off = c.decode(ids, at)
            if len(back) == len(data) and (back_off == off).all():
                wrong = np.flatnonzero(back != data)
                lossless = np.ones(rows.num_rows, bool)
                lossless[np.searchsorted(off, wrong, side="right") - 1] = False
            else:
                lossless = np.array([back[p:q].tobytes() == data[r:s].tobytes() for p, q, r, s in zip(back_off[:-1], back_off[1:], off[:-1], off[1:], strict=True)])
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = np.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            out = [column(rows, "doc_id"), pa.array(np.diff(off)), pa.array(np.diff(at)), pa.array(crc), pa.array(lossless)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless", *["ids"] * with_ids])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return map_arrow(rows, run, schema)
