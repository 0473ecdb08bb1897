"""Very long texts, columns with clashing names, and the pipeline's defined cases."""

import hashlib
import random
import zlib

import numpy as np
import plain
import pytest

import corpus_pipeline
from typoforge.llm import base, decontaminate, lm_scoring, near_dedup, pii, quality, substring_dedup, subwords, suffix_dedup, token_counts, token_file, vocab


def prose(seed, n):
    """Words that don't repeat, with lines and marks."""
    r = random.Random(seed)
    return " ".join(f"{r.choice(['the', 'house', 'über', 'running'])}{i:x}{seed}" + r.choice(["", "", ",", ".\n"]) for i in range(n))


@pytest.fixture(scope="module")
def long(spark):
    """A text over STEP_BYTES that repeats its first 3,000 words at its end, a near copy of it, and a short one."""
    text = prose(1, 190_000)
    words = text.split(" ")
    text = " ".join([*words, *words[:3000]])
    assert len(text.encode()) > base.STEP_BYTES
    near = " ".join([*words[:50_000], "changed", *words[50_001:], *words[:3000]]) + " write to ann.lee@mail.example.org"
    rows = [(1, text), (2, near), (3, prose(2, 80))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_long_texts_lose_exactly_what_repeats(long):
    rows, docs = long
    words = [t.split() for _, t in rows]
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_words(docs).collect()}
    # All but the changed word's windows are in both texts.
    assert [got[i].n_words for i in (1, 2, 3)] == list(map(len, words))
    assert got[1].n_removed == len(words[0]) - 1 and got[2].n_removed == len(words[1]) - 4 and got[3].n_removed == 0
    data = [t.encode() for _, t in rows]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    common = lambda a, b: next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
    start = common(data[0], data[1])
    tail = common(data[0][::-1], data[1][: data[1].index(b" write to")][::-1])
    assert got[1].n_removed == start + tail and got[3].n_removed == 0
    assert got[2].n_removed == start + tail + 1  # the space behind the repeated words is behind their first occurrence too
    kept = data[0][start : len(data[0]) - tail]
    assert got[1].kept_sha256 == hashlib.sha256(kept).hexdigest() and 0 < len(kept) < 20


def test_long_texts_have_the_libraries_tokens(spark, long):
    rows, docs = long
    sp, tok = vocab.pieces(), vocab.word_bpe()
    pieces = {i: sp.encode(t) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_digest(docs).collect()} == {i: len(x) for i, x in pieces.items()}
    assert {r.doc_id: r.n_tokens for r in lm_scoring.score(docs, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")).collect()} == {i: len(x) for i, x in pieces.items()}
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    got = {r.doc_id: r for r in token_file.ids_digest(docs).collect()}
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in got.items()} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    whole = {r.doc_id: r for r in subwords.pieces_digest(docs, dropout=0.0).collect()}
    assert {i: (r.n_tokens, r.ids_crc32, r.lossless) for i, r in whole.items()} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, x in pieces.items()}
    assert all(r.lossless and r.n_tokens >= len(pieces[r.doc_id]) for r in subwords.pieces_digest(docs).collect())


def test_long_texts_are_linked_scanned_and_measured(spark, long):
    rows, docs = long
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_digest(docs).collect()}
    size = lambda t: len({tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)})
    assert near == {1: (size(rows[0][1]), 1, True), 2: (size(rows[1][1]), 1, False), 3: (size(rows[2][1]), 3, True)}
    item = " ".join(rows[0][1].split()[150_000:150_012])
    leaks = {r.doc_id: (r.n_hit > 0, r.n_items) for r in decontaminate.leak_digest(docs, spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string")).collect()}
    assert leaks == {1: (True, 1), 2: (True, 1), 3: (False, 0)}
    found = {r.doc_id: (r.n_email, r.spans) for r in pii.pii_digest(docs).collect()}
    at = rows[1][1].index("ann.lee")
    assert found[2] == (1, f"email:{at}:{at + len('ann.lee@mail.example.org')}") and found[1] == found[3] == (0, "")
    short = [(i, t) for i, t in rows if i == 3] + [(4, prose(9, 3000) + "\n" + prose(9, 2999))]
    measured = {r.doc_id: r for r in quality.quality_digest(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    for i, t in short:
        want = plain.quality_counts(t)
        assert all(measured[i][k] == v for k, v in want.items())
    assert {r.doc_id: r.n_words for r in quality.quality_digest(docs).collect()} == {i: len(t.split()) for i, t in rows}


NAMES = ("id", "hash", "hits", "whole", "comp", "cls", "th", "kept", "runs", "region", "items", "row")


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in NAMES)).repartition(3)


def test_clashing_columns_pass_through(spark):
    one = prose(3, 300)
    rows = [(1, one, "en"), (2, one + " more", "en"), (3, prose(4, 200), None), (3, prose(4, 200), None), (None, one, "en"), (4, None, "en"), (5, "a@b.example.org and a longer line of words", "xx")]
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, " ".join(prose(4, 200).split()[20:40]))], "item_id int, text string")
    outs = {
        "near": near_dedup.drop_near_duplicates(docs), "good": quality.keep_good(docs), "documents": decontaminate.decontaminate(docs, bench),
        "spans": decontaminate.decontaminate(docs, bench, mode="spans"), "pii": pii.redact_pii(docs),
    }
    for name, out in outs.items():
        assert out.columns == docs.columns, name
        for r in out.collect():
            k = int(r.id[2:])
            assert all(r[n] == f"{n}{k}" for n in NAMES) and r.doc_id == rows[k][0], name
    ids = lambda out: sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
    every = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert ids(outs["near"]) == [(False, 0), (True, 1), (True, 3), (True, 4), (True, 5)]
    assert ids(outs["spans"]) == ids(outs["pii"]) == every and ids(outs["documents"]) == [x for x in every if x != (True, 3)]
    cut = {r.doc_id: r.text for r in outs["spans"].collect()}
    assert len(cut[3].split()) < 200 and cut[1] == one and cut[4] is None
    assert "example.org" not in next(r.text for r in outs["pii"].collect() if r.doc_id == 5)
    for f in (near_dedup.drop_near_duplicates, quality.keep_good, pii.redact_pii, lambda d: decontaminate.decontaminate(d, bench), lambda d: decontaminate.decontaminate(d, bench, mode="spans")):
        assert f(docs.limit(0)).count() == 0


def test_pipeline_on_defined_cases(spark, tmp_path):
    sf = str(tmp_path)
    english = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en' and n_chars > 600").orderBy("doc_id").limit(12).select("doc_id", "text", "lang")
    good = [tuple(r) for r in quality.keep_good(english).orderBy("doc_id").collect()]
    good = [g for g, r in zip(good, good, strict=True)][:5]
    assert len(good) == 5
    text = good[0][1]
    rows = [*good, good[1], (None, good[2][1] + " and so on", "en"), (900, None, "en"), (901, "", "en"), (902, " \n ", None), (903, text + " again", "en"), (904, "\n".join([text] * 400), "en")]
    docs = clashing(spark, rows)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "words that are nowhere to be found in any of these texts at all")], "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    least = {g[0] for g in near_dedup.drop_near_duplicates(spark.createDataFrame(good, "doc_id long, text string, lang string")).collect()}
    assert set(got) == {*least, None}  # exact and near copies go, as do empty texts and one that repeats itself; a null id stays
    assert all(r.lossless for r in got.values())
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
