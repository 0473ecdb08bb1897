"""Operator 11, byte-level BPE encoding and decoding.

A text is cut at special tokens and into pre-tokens, and every distinct pre-token of a worker is merged once: its
bytes are a doubly linked list of symbols, and a priority queue holds the ranks of the merges that adjacent symbols
allow, the leftmost first among equals.  A popped entry whose symbols have changed since is stale and skipped; a merge
relinks the list and pushes the pairs that it makes.  Decoding concatenates the vocabulary's strings and turns bytes
that are no UTF-8 into U+FFFD.

The cut is array work over the characters of a step: letters, digits, white space and the rest are runs; the last
white space before other text is apart, and joins it if it is a space; an apostrophe alone takes s, t, m, d, re, ve or
ll with it.  The class of a character beyond ASCII is asked of the library, once for each character of a worker, so
both follow one version of Unicode.

Defined cases: a null or empty text has no ids and decodes to the empty text; a special token's string in a text is
that token, as is the library's default; rows that repeat, also with a null id, give a row each; other columns are
ignored, whatever their names; an empty table gives an empty result; a very long text is a step of its own, and a
pre-token of any length costs its length times the logarithm of that.  Nothing is shuffled, and no key meets another,
so there is no skew but that of a single text; memory is a step of texts and a bounded store.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, map_arrow, ragged, steps
from .vocab import Store, flattened, keep_only, vocabulary, word_bpe

BYTE_BPE = "byte_bpe_50k.json"
#: Bytes of texts that are encoded at once, and pre-tokens that a worker keeps.
STEP = 6_000_000
KEPT = 600_000
REST, LETTER, DIGIT, SPACE, UNKNOWN = 0, 1, 2, 3, 255


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of a byte-level BPE in the tokenizers library's JSON format."""

    def __init__(self, model: str = BYTE_BPE) -> None:
        with open(vocabulary(model), encoding="utf-8") as f:
            spec = json.load(f)
        bpe, cut = spec["model"], spec["pre_tokenizer"]
        plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError(f"{model} is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{model}: added tokens that take their surroundings are not supported")
        letters, ids = byte_letters(), bpe["vocab"]
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: k for k, (a, b) in enumerate(merges)}
        self.joined = [ids[a + b] for a, b in merges]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        raw = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for word, i in ids.items():
            raw[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            raw[i] = word
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.probe = word_bpe(model).pre_tokenizer
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(128):
            x = chr(c)
            self.kinds[c] = LETTER if x.isalpha() else DIGIT if x.isdigit() else SPACE if x in " \t\n\r\x0b\x0c" else REST
        self.store = Store(lambda keys: flattened([self.merged(k) for k in keys]), KEPT)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one pre-token or special token."""
        if raw in self.special:
            return [self.special[raw]]
        rank, n = self.rank, len(raw)
        sym = [self.first[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j]) != r:
                continue
            sym[i], sym[j] = self.joined[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << 32 | sym[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank.get(sym[h] << 32 | sym[i])) is not None:
                push(queue, r << 32 | h)
        return [s for s in sym if s >= 0]

    def kind(self, code: np.ndarray) -> np.ndarray:
        """Letter, digit, white space or the rest, of characters; new ones are tried beside a letter, a digit and a full stop."""
        out = self.kinds[code]
        if (out == UNKNOWN).any():
            for c in np.unique(code[out == UNKNOWN]).tolist():
                x = chr(c)
                starts = {a for _, (a, _) in self.probe.pre_tokenize_str(f"a{x}a1{x}1.{x}.")}
                self.kinds[c] = LETTER if 1 not in starts else DIGIT if 4 not in starts else REST if 7 not in starts else SPACE
            out = self.kinds[code]
        return out

    def _marked(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(starts, ends) of special tokens, as rows; they never cross texts."""
        found = []
        raw = data.tobytes()
        if self.marks and self.marks.search(raw):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                found += [m.span() for m in self.marks.finditer(raw, a, b)]
        return np.array(found, np.int64).reshape(-1, 2).T

    def pre_tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the pre-tokens of all texts, with the end behind them; offsets by text)."""
        if not len(data):
            return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
        begin, end = self._marked(data, off)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n, lead = len(at), data[at]
        code = lead.astype(np.int64)
        # Characters of two to four bytes: the lead's bits, then six of each further byte.
        for least, most, keep, more in ((0xC2, 0xDF, 0x1F, 1), (0xE0, 0xEF, 0x0F, 2), (0xF0, 0xF4, 0x07, 3)):
            wide = np.flatnonzero((lead >= least) & (lead <= most))
            x = code[wide] & keep
            for k in range(1, more + 1):
                x = x << 6 | data[at[wide] + k] & 0x3F
            code[wide] = x
        kind = self.kind(code)
        edge = np.zeros(n + 1, bool)  # starts of texts, of special tokens, and of what is behind those
        edge[np.searchsorted(at, np.concatenate([off, begin, end]))] = True
        cut = edge[:-1].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        tail = np.flatnonzero((kind == SPACE) & np.append(cut[1:], True) & ~edge[1:])  # the last white space before other text
        cut[tail] = True
        cut[tail[code[tail] == 0x20] + 1] = False
        # An apostrophe that is a pre-token's whole start, before one of the endings.
        mark = np.flatnonzero((code == 0x27) & cut)
        letter = lambda k: np.where((mark + k < n) & ~np.logical_or.reduce([edge[np.minimum(mark + j, n)] for j in range(1, k + 1)]), code[np.minimum(mark + k, n - 1)], 0)
        one, two = letter(1), letter(2)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        mark, size = mark[size > 0], size[size > 0]
        cut[mark + 1] = False
        behind = mark + size + 1
        cut[behind[behind < n]] = True
        if len(begin):
            inside = np.searchsorted(at, begin) + 1
            cut[ragged(inside, np.searchsorted(at, end) - inside)] = False
        starts = at[cut]
        return np.append(starts, len(data)), np.searchsorted(starts, off)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text) of UTF-8 bytes with offsets."""
        keep_only(self.store)
        bounds, per = self.pre_tokens(data, off)
        if len(bounds) == 1:
            return np.zeros(0, np.int32), per
        flat = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = flat.dictionary_encode()
        row = self.store.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = self.store.len[row]
        return self.store.ids[ragged(self.store.start[row], size)], np.concatenate([[0], np.cumsum(size)])[per]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets by text) of ids with offsets."""
        size = self.raw_len[ids]
        data, upto = self.raw[ragged(self.raw_start[ids], size)], np.concatenate([[0], np.cumsum(size)])[off]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not ((data[upto[:-1][np.diff(upto) > 0]] & 0xC0) == 0x80).any()  # no text starts inside a character
        except UnicodeDecodeError:
            whole = False
        if whole:
            return data, upto
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)


@functools.lru_cache(2)
def byte_bpe(model: str = BYTE_BPE) -> ByteBpe:
    return ByteBpe(model)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def _digests(data: np.ndarray, off: np.ndarray) -> pa.Array:
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, *, model: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches, most=STEP):
            ids, at = byte_bpe(model).encode(data, off)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, *, model: str = BYTE_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of token ids; null ids are none."""
    rows = tokens.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "ids")
            off = lists.offsets.to_numpy().astype(np.int64)
            data, at = byte_bpe(model).decode(lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0])
            text = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pc.cast(text, pa.string())], names=["doc_id", "text"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digest(docs: DataFrame, *, model: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32 bits), decoded_sha256, and lossless: decoding gave back the text."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(model)
        for rows, data, off in steps(batches, most=STEP):
            ids, at = bpe.encode(data, off)
            back, upto = bpe.decode(ids, at)
            if np.array_equal(upto, off) and np.array_equal(back, data):
                same = np.ones(rows.num_rows, bool)
            else:
                same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(upto[:-1], upto[1:], off[:-1], off[1:], strict=True)], bool)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), pa.array(np.diff(at)), _digests(ids.astype("<u4"), at * 4), _digests(back, upto), pa.array(same)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


__all__ = ["ByteBpe", "bpe_digest", "byte_bpe", "decode", "encode"]
