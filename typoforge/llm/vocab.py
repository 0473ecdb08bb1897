"""Public vocabularies: exact cuts of texts into pre-tokens, and per-worker stores of what a pre-token encodes to."""

from __future__ import annotations

import functools
import itertools
import os
import re
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import LOWER, SPACED, ragged

_ALNUM, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _UPPER[0x41:0x5B] = True

PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def vocabulary(name_or_path: str) -> str:
    """A path as given, or the installed public file of that name."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@functools.lru_cache(4)
def pieces(model: str = PIECES):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(model))
    every = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in p.lstrip("▁") or "\n" in p or re.search("[A-Za-z0-9][.,]", p) for p in every):
        raise ValueError(f"{model}: pieces cross the places where fragments() cuts texts")
    return sp


def fragments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Exact pre-tokens of a SentencePiece BPE model with a dummy prefix: (fragments of all texts, offsets by text).

    No piece has a space after another character, a line feed, or a full stop or comma after an ASCII letter or
    digit, so no merge crosses the start of a run of spaces, either side of a line feed, or the start of such a
    mark (pieces() checks the vocabulary for this).  Every text that isn't empty gets its dummy space first.
    """
    texts = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), texts, "")
    _, off, buf = texts.buffers()
    n = len(texts)
    o = np.frombuffer(off, np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = np.frombuffer(buf, np.uint8)[o[0] : o[-1]] if buf is not None else np.zeros(0, np.uint8)
    o = (o - o[0]).astype(np.int64)
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(n + 1, np.int64)
    space, line = raw == 0x20, raw == 0x0A
    cut = line.copy()
    mark = (raw == 0x2E) | (raw == 0x2C)
    cut[1:] |= (space[1:] & ~space[:-1]) | line[:-1] | (mark[1:] & (_ALNUM | _UPPER)[raw[:-1]])
    cut[o[:-1][np.diff(o) > 0]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(raw)).astype(np.int32)
    made = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    return made, np.searchsorted(at, o)


def piece_ids(sp, frags: list[str]) -> list[list[int]]:
    """The ids of fragments as the library gives them inside a text."""
    made = sp.encode([f[1:] if f[0] == " " else "\n" + f for f in frags], num_threads=1)
    alone = {" ": [sp.piece_to_id("▁")], "\n": [sp.piece_to_id("<0x0A>")]}
    return [alone.get(f) or (ids if f[0] == " " else ids[2:]) for f, ids in zip(frags, made, strict=True)]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, how many each list has)."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lens.sum())), lens


#: All stores of this worker: a worker serves one operator after another.
_STORES: weakref.WeakSet = weakref.WeakSet()


def keep_only(*stores: Store) -> None:
    """Empty all other stores of this worker, so that its memory is that of the operator it runs."""
    others = [s for s in _STORES if s.n and s not in stores]
    for s in others:
        s.clear()
    if others:
        pa.default_memory_pool().release_unused()


class Store:
    """Ids by key, computed once while kept.

    Beyond `most` keys, those seen in one call only go (all go if the others are over half), so memory is bounded
    whatever the vocabulary.  encode takes a list of keys and returns (all ids, how many each key has).
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 150_000) -> None:
        self.encode, self.most = encode, most
        self.clear()
        _STORES.add(self)

    def clear(self) -> None:
        self.row: dict = {}
        self.n = 0
        self.len = np.zeros(1 << 12, np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.seen = np.zeros(1 << 12, bool)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0

    def shrink(self) -> None:
        stay = self.seen[: self.n]
        kept = int(stay.sum())
        if 2 * kept > self.most:
            self.clear()
            return
        at = np.cumsum(stay) - 1
        self.row = {k: int(at[r]) for k, r in self.row.items() if stay[r]}
        lens = self.len[: self.n][stay]
        ids = self.ids[ragged(self.start[: self.n][stay], lens)]
        self.n, self.used = kept, len(ids)
        self.len[:kept], self.start[:kept], self.ids[: len(ids)] = lens, np.cumsum(lens) - lens, ids
        self.seen[:] = False

    def rows(self, keys: list) -> np.ndarray:
        """A row for each of these keys, which are distinct."""
        if self.n > self.most:
            self.shrink()
        get = self.row.get
        out = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        self.seen[out[out >= 0]] = True
        if len(new):
            missing = [keys[i] for i in new.tolist()]
            ids, lens = self.encode(missing)
            first, count, total = self.n, len(missing), len(ids)
            while first + count > len(self.len):
                self.len, self.start = np.concatenate([self.len, self.len]), np.concatenate([self.start, self.start])
                self.seen = np.concatenate([self.seen, np.zeros(len(self.seen), bool)])
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, self.ids])
            self.len[first : first + count] = lens
            self.start[first : first + count] = self.used + np.cumsum(lens) - lens
            self.ids[self.used : self.used + total] = ids
            self.used += total
            self.n += count
            self.seen[first : first + count] = False
            self.row.update(zip(missing, range(first, first + count), strict=True))
            out[new] = np.arange(first, first + count)
        return out


@functools.lru_cache(8)
def stored(kind: str, model: str) -> Store:
    """The store of this worker for a kind of encoder."""
    if kind == "pieces":
        sp = pieces(model)
        return Store(lambda keys: flattened(piece_ids(sp, keys)))
    if kind == "words":
        return Store(WordBpe(model), 700_000)
    if kind == "byte words":
        return Store(_byte_words(model))
    raise ValueError(kind)


def _byte_words(model: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary(model), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda keys: flattened([made.encode_ordinary(" " + k) for k in keys])


@functools.lru_cache(2)
def word_bpe(model: str = WORD_BPE):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(model))


class WordBpe:
    """Ids of the tiles of word_tiles() by the tokenizers library.

    Tiles of ASCII letters alone are one pre-token each, so many are encoded as one text and told apart by the
    tokens that end a word.
    """

    def __init__(self, model: str) -> None:
        self.tok = word_bpe(model)
        n = self.tok.get_vocab_size()
        self.final = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def __call__(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [k.strip(" \t\n\r\x0b\x0c") for k in keys]
        plain = np.fromiter((w.isascii() and w.isalpha() for w in words), bool, len(words))
        parts, where = [], [np.flatnonzero(plain), np.flatnonzero(~plain)]
        for at, group in ((where[0], 1000), (where[1], 1)):
            texts = [" ".join(words[i] for i in at[a : a + group].tolist()) for a in range(0, len(at), group)]
            ids, lens = flattened([e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            if group > 1:
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) != len(at):  # can't be with this kind of vocabulary; each alone is always right
                    ids, lens = flattened([e.ids for e in self.tok.encode_batch_fast([words[i] for i in at.tolist()], add_special_tokens=False)])
                else:
                    lens = np.diff(ends, prepend=0)
            parts.append((ids, lens))
        lens = np.empty(len(keys), np.int64)
        start = np.empty(len(keys), np.int64)
        shift = 0
        for at, (ids, n) in zip(where, parts, strict=True):
            lens[at] = n
            start[at] = shift + np.cumsum(n) - n
            shift += len(ids)
        flat = np.concatenate([parts[0][0], parts[1][0]])
        return flat[ragged(start, lens)], lens


def word_tiles(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut into words with the white space after them, full stops and commas after a word apart: (tiles, offsets by text).

    The word BPE lower-cases (A-Z is done here), drops white space, and never joins a letter or digit with a
    full stop or comma, so a text's ids are those of its tiles.
    """
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    low = LOWER[data]
    inside = SPACED[low]
    cut = inside.copy()
    cut[1:] &= ~inside[:-1]
    mark = (low == 0x2E) | (low == 0x2C)
    mark[1:] &= _ALNUM[low[:-1]]
    mark[0] = False
    mark[:-1] &= ~inside[1:]
    cut |= mark
    cut[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(low)).astype(np.int32)
    made = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(low))
    return made, np.searchsorted(at, off)


def spaced_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space: (words of all texts, offsets by text)."""
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = pc.list_flatten(lists)
    counts = np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        doc = np.repeat(np.arange(len(texts)), counts)[full]
        counts = np.bincount(doc, minlength=len(texts))
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate([[0], np.cumsum(counts)])


def indexed(flat: pa.Array) -> tuple[np.ndarray, list]:
    """(index of each word among the distinct ones, distinct words)."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
