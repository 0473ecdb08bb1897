"""Operator 9, quality rules by tokeniser fertility.

Two public vocabularies measure every text: a SentencePiece BPE with byte fallback (characters per token,
byte-fallback share, token entropy) and a multilingual byte-level BPE (characters per token).  Each word is
encoded alone after a space, once per worker, and documents add up what their words give.  Bands for each
language (or, without a known language, for the script most of its letters are in) reject texts that no
vocabulary can cut well (random characters, encoded blobs) or that cut too well (a few words over and over).

Before the bands, the base rules: fewer than 50 words, or more than half of the words inside 3-word windows
that occur at least twice.

Defined cases: a null or empty text has no words and fails the base; a null or unknown language is judged by
script; rows that repeat are judged each by itself; other columns pass through, whatever their names; an empty
table gives an empty result; a very long text is a step of its own.  Lines and windows are told apart by 64-bit
hashes within one document.  Memory: a step of texts, and a bounded store of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACED, U64, column, filled, fresh, map_arrow, mix, owner, prefix, ragged, span, steps, word_hashes, words
from .vocab import PIECES, indexed, keep_only, spaced_words, stored

BYTE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
#: Bytes of text that one step measures; its arrays take about 60 times as much.
STEP = 1_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Band(NamedTuple):
    """What a text of a language or script may measure."""

    least_chars: float  # characters per SentencePiece token
    most_chars: float
    least_byte_chars: float  # characters per token of the byte-level vocabulary
    most_fallback: float  # share of byte-fallback tokens
    least_entropy: float  # bits per token, of texts of 50 words or more


#: Bands of languages (fit_bands() over the labelled documents of the sample tables gives narrower ones), then of scripts
#: for texts of no such language: between what prose of the script measures and what random letters of it do.
BANDS = {
    "en": Band(1.6, 6.0, 1.85, 0.05, 4.0),
    "de": Band(1.7, 6.0, 2.0, 0.05, 4.0),
    "fr": Band(1.5, 6.0, 1.7, 0.05, 4.0),
    "es": Band(1.55, 6.0, 1.75, 0.05, 4.0),
    "latin": Band(1.0, 8.0, 1.5, 0.25, 3.5),
    "greek": Band(0.5, 3.0, 1.3, 0.15, 3.5),
    "cyrillic": Band(1.3, 6.0, 1.5, 0.15, 3.5),
    "hebrew": Band(0.5, 3.0, 1.12, 0.15, 3.5),
    "arabic": Band(0.6, 3.0, 1.2, 0.15, 3.5),
    "devanagari": Band(0.5, 3.0, 0.62, 0.3, 3.5),
    "thai": Band(0.55, 3.0, 0.72, 0.3, 3.5),
    "hangul": Band(0.45, 3.0, 0.7, 0.4, 3.5),
    "han": Band(0.42, 3.0, 0.5, 0.4, 3.5),
    "other": Band(0.25, 8.0, 0.28, 0.9, 3.0),
}
#: Scripts as they are counted; han includes kana.
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "hangul", "han", "other")


def _script_tables() -> tuple[np.ndarray, np.ndarray]:
    """Scripts (index, -1: no letter) by the first byte of a character, and by the first two bytes."""
    first = np.full(256, -1, np.int8)
    both = np.full(1 << 16, -1, np.int8)
    at = SCRIPTS.index
    for name, ranges in (("latin", [(0xC3, 0xC9)]), ("greek", [(0xCD, 0xCF)]), ("cyrillic", [(0xD0, 0xD4)]), ("hebrew", [(0xD6, 0xD7)]), ("arabic", [(0xD8, 0xDB)]), ("other", [(0xCA, 0xCC), (0xD5, 0xD5), (0xDC, 0xE1), (0xEA, 0xEA), (0xF0, 0xF0)]), ("hangul", [(0xEB, 0xED)]), ("han", [(0xE3, 0xE9)])):
        for a, b in ranges:
            first[a : b + 1] = at(name)
    both[:] = np.repeat(first, 256)
    two = (("devanagari", 0xE0A4, 0xE0A5), ("thai", 0xE0B8, 0xE0B9), ("hangul", 0xE184, 0xE187), ("latin", 0xE1B8, 0xE1BB), ("greek", 0xE1BC, 0xE1BF), ("hangul", 0xEAB0, 0xEABF), ("other", 0xED9F, 0xEDBF), ("han", 0xEFA4, 0xEFAB), ("arabic", 0xEFAD, 0xEFBB))
    for name, a, b in two:
        both[a : b + 1] = at(name)
    both[0xE380] = -1  # punctuation
    return first, both


_FIRST, _BOTH = _script_tables()


def scripts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text, the index of the script that most of its letters are in (the first of equals; other: no letters)."""
    n_docs, k = len(off) - 1, len(SCRIPTS)
    ascii_letters = np.zeros(256, bool)
    ascii_letters[0x41:0x5B] = ascii_letters[0x61:0x7B] = True
    plain = np.concatenate([[0], np.cumsum(ascii_letters[data])])
    at = np.flatnonzero(data >= 0xC3)
    pair = data[at].astype(np.int64) << 8 | data[np.minimum(at + 1, max(len(data) - 1, 0))]
    script = _BOTH[pair]
    at, script = at[script >= 0], script[script >= 0]
    doc = np.searchsorted(off, at, side="right") - 1
    count = np.bincount(doc * k + script, minlength=n_docs * k).reshape(n_docs, k)
    count[:, 0] += plain[off[1:]] - plain[off[:-1]]
    return np.where(count.any(axis=1), count.argmax(axis=1), k - 1)


def entropy(doc: np.ndarray, ids: np.ndarray, n_docs: int, vocab: int) -> np.ndarray:
    """Bits per token of each document's distribution of ids."""
    key = np.sort(doc * vocab + ids)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(key)))
    d = key[at] // vocab
    total = np.bincount(d, n, n_docs)
    part = np.bincount(d, n * np.log2(n), n_docs)
    safe = np.maximum(total, 1)
    return np.log2(safe) - part / safe


def _measure(texts: pa.Array, data: np.ndarray, off: np.ndarray, model: str, byte_model: str) -> dict[str, np.ndarray]:
    n_docs = len(off) - 1
    starts, ends, word_off = words(data, off, SPACED)
    doc = owner(word_off)
    head = (data & 0xC0) != 0x80  # first bytes of characters
    upto = np.concatenate([[0], np.cumsum(head)])
    by_doc = lambda x: np.bincount(doc, x, n_docs).astype(np.int64)
    out = {"n_words": np.diff(word_off), "word_chars": by_doc(upto[ends] - upto[starts])}
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbols"] = sym[off[1:]] - sym[off[:-1]]

    # Lines: cut at line feeds and at the ends of texts; those with a word count.
    feed = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([off[:-1], feed + 1]))
    line_end = np.sort(np.concatenate([off[1:], feed]))
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le = line_start[has], line_end[has]
    ld = np.searchsorted(off, ls, side="right") - 1
    salt = mix(np.arange(n_docs, dtype=U64) + U64(1))
    distinct = np.unique(word_hashes(data, ls, le) ^ salt[ld], return_index=True)[1]
    out["n_dup_lines"] = np.bincount(ld, minlength=n_docs)[:n_docs] - np.bincount(ld[distinct], minlength=n_docs)[:n_docs]
    # 3-word windows.
    at = np.arange(max(len(starts) - 2, 0))
    at = at[doc[at] == doc[at + 2]] if len(at) else at
    h = span(prefix(word_hashes(data, starts, ends)), at, at + 3) ^ salt[doc[at]]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[at[twice] + k] = True
    out["n_repeat_words"] = by_doc(hit)

    # Tokens: words encode once; the step's distinct words meet the store.
    flat, flat_off = spaced_words(texts)
    idx, keys = indexed(flat)
    store, byte_store = stored("pieces", model), stored("byte words", byte_model)
    keep_only(store, byte_store)
    row = store.rows([" " + k.replace("▁", " ") for k in keys])
    size = store.len[row]
    every = store.ids[ragged(store.start[row], size)]  # of the distinct words
    fallback = np.bincount(np.repeat(np.arange(len(keys)), size), (every >= 3) & (every < 259), len(keys)).astype(np.int64)
    byte_row = byte_store.rows(keys)
    byte_size = byte_store.len[byte_row]
    wdoc = owner(flat_off)
    chars = np.maximum(out["word_chars"], 0)
    n_tok = np.bincount(wdoc, size[idx], n_docs)
    n_byte = np.bincount(wdoc, byte_size[idx], n_docs)
    safe = np.maximum(n_tok, 1)
    out["chars_per_token"] = chars / safe
    out["byte_chars_per_token"] = chars / np.maximum(n_byte, 1)
    out["fallback_share"] = np.bincount(wdoc, fallback[idx], n_docs) / safe
    first = np.cumsum(size) - size
    ids = every[ragged(first[idx], size[idx])]
    out["entropy"] = entropy(np.repeat(wdoc, size[idx]), ids.astype(np.int64), n_docs, 1 << 16)
    out["script"] = scripts(data, off)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out


def _kept(m: dict[str, np.ndarray], langs: list, bands: dict[str, Band]) -> np.ndarray:
    at = [x if x in bands and x not in SCRIPTS else SCRIPTS[k] for x, k in zip(langs, m["script"].tolist(), strict=True)]
    band = np.array([bands[x] for x in at], float).reshape(-1, len(Band._fields)).T
    fine = (m["chars_per_token"] >= band[0]) & (m["chars_per_token"] <= band[1]) & (m["byte_chars_per_token"] >= band[2])
    return ~m["base_failed"] & fine & (m["fallback_share"] <= band[3]) & (m["entropy"] >= band[4])


def fit_bands(docs: DataFrame, labels: DataFrame, *, margin: float = 0.1, least_rows: int = 20, **options) -> dict[str, Band]:
    """Bands of the languages of docs that keep every document labelled good, `margin` wider than what those measure.

    labels has doc_id and quality (1: good); a language with fewer good documents than least_rows gets no band.
    Documents that fail the base rules don't count.  The result is one row a language, from partial aggregates.
    """
    (i,) = fresh(docs, "id")
    good = labels.filter("quality = 1").select(F.col("doc_id").alias(i)).distinct()
    chosen = docs.join(good, docs["doc_id"] == F.col(i), "left_semi").select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    m = measure(chosen, with_lang=True, **options).filter("not base_failed")
    fitted = m.groupBy("lang").agg(
        F.count("*").alias("k"), F.min("chars_per_token").alias("a"), F.max("chars_per_token").alias("b"), F.min("byte_chars_per_token").alias("c"), F.max("fallback_share").alias("d"), F.min("entropy").alias("e")
    )
    rows = fitted.filter((F.col("k") >= least_rows) & (F.col("lang") != "")).collect()
    return {r.lang: Band(r.a * (1 - margin), r.b * (1 + margin), r.c * (1 - margin), r.d * (1 + margin) + margin / 10, r.e * (1 - margin)) for r in rows}


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DOUBLES = ("chars_per_token", "byte_chars_per_token", "fallback_share", "entropy")


def measure(docs: DataFrame, *, bands: dict[str, Band] | None = None, model: str = PIECES, byte_model: str = BYTE_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_lang: bool = False) -> DataFrame:
    """One row a document: doc_id, the counts, the measures, base_failed and kept; lang if asked for."""
    bands = bands or BANDS
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(batches, most=STEP):
            m = _measure(column(rows, "text"), data, off, model, byte_model)
            kept = _kept(m, column(rows, "lang").to_pylist(), bands)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), *(pa.array(m[k].astype(np.int64)) for k in LONGS), *(pa.array(m[k]) for k in DOUBLES), pa.array(m["base_failed"]), pa.array(kept), *[column(rows, "lang")] * with_lang],
                names=["doc_id", *LONGS, *DOUBLES, "base_failed", "kept", *["lang"] * with_lang],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, {', '.join(f'{k} long' for k in LONGS)}, {', '.join(f'{k} double' for k in DOUBLES)}, base_failed boolean, kept boolean" + ", lang string" * with_lang)


def keep_good(docs: DataFrame, *, bands: dict[str, Band] | None = None, model: str = PIECES, byte_model: str = BYTE_VOCABULARY, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, all columns as they are."""
    bands = bands or BANDS
    (whole,) = fresh(docs, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in steps(filled(batches, text_col, whole), whole, STEP):
            m = _measure(column(rows, whole), data, off, model, byte_model)
            at = rows.schema.get_field_index(lang_col)
            langs = pc.cast(rows.column(at), pa.string()).to_pylist() if at >= 0 else [None] * rows.num_rows
            yield rows.filter(pa.array(_kept(m, langs, bands))).drop_columns([whole])

    return map_arrow(docs, run, docs.schema)


def quality_digest(docs: DataFrame, **options) -> DataFrame:
    return measure(docs, **options)

