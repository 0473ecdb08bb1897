"""The pipeline's rows against a plain version of its five stages, on the smallest tables."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import plain

import corpus_pipeline
from typoforge.llm import pii, quality, subwords, vocab

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_quality(text, lang, sp, encode):
    if plain.quality_counts(text)["base_failed"]:
        return False
    words = WORD.findall(text)
    ids = [i for w in words for i in sp.encode(w)]
    chars, n = sum(map(len, words)), Counter(ids)
    bits = -sum(k / len(ids) * math.log2(k / len(ids)) for k in n.values())
    band = quality.BANDS[lang]
    share = sum(3 <= i < 259 for i in ids) / len(ids)
    by_bytes = chars / sum(len(encode([w])[0]) for w in words)
    return band.least_chars <= chars / len(ids) <= band.most_chars and by_bytes >= band.least_byte_chars and share <= band.most_fallback and bits >= band.least_entropy


def without_near_copies(rows):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [(d, t) for d, t in rows if find(d) == d]


def without_leaks(rows, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))]


def test_pipeline_matches_a_plain_version(spark, data):
    docs = duckdb.sql(f"select doc_id, text, lang from '{data}/documents.parquet' order by 1").fetchall()
    items = [x for (x,) in duckdb.sql(f"select text from '{data}/benchmark.parquet'").fetchall()]
    sp, made = vocab.pieces(), vocab._byte_words(quality.BYTE_VOCABULARY)
    encode = lambda w: [made(w)[0]]
    rows = [(d, t) for d, t, lang in docs if kept_by_quality(t, lang, sp, encode)]
    rows = [(d, pii.scrubbed(t)) for d, t in without_leaks(without_near_copies(rows), items)]
    want = []
    for d, t in rows:
        assert not pii.brute(t)
        ids = plain.dropped_merges(sp, t, d, subwords.SEED, subwords.DROPOUT)
        want.append((d, len(t.encode()), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    got = corpus_pipeline.run(spark, data).select("doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < len(docs)
