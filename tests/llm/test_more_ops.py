"""Operators 11 to 13 against the libraries and plain versions: nulls, repeats, ties, clashing columns, empty tables, long texts."""

import hashlib
import random

import numpy as np
import plain
import pytest

from typoforge.llm import byte_bpe, search, spelling, vocab

LETTERS = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "中", " ", "　", "²", "٣", "<|endoftext|>", "<|", "😀", "́", "—", "!", ".", "the", "\x1c", "\x85", "ᲊ", "՘"]
SCHEMA = "doc_id long, text string, item int, word string, n long, key long, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "x") for i, t in rows], SCHEMA).repartition(3)


def in_order(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(4)
    rows = [(i, "".join(r.choice(LETTERS) for _ in range(r.randint(0, 60)))) for i in range(400)]
    return [*rows, (3, "repeated"), (3, "repeated"), (None, "no id"), (None, "no id"), (7, None), (8, ""), (9, "<|endoftext|>"), (10, " x" * 9 + "<|endoftext|><|endoftext|>  y")]


def test_byte_bpe_is_the_library(spark, mixed):
    tok = vocab.word_bpe(byte_bpe.BYTE_BPE)
    want = []
    for i, t in mixed:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), True))
    assert in_order(byte_bpe.bpe_digest(frame(spark, mixed)).collect()) == in_order(want)


def test_byte_bpe_decodes_what_it_encodes(spark, mixed):
    docs = frame(spark, mixed)
    tokens = byte_bpe.encode(docs)
    assert in_order(byte_bpe.decode(tokens).collect()) == in_order((i, t or "") for i, t in mixed)
    cut = tokens.selectExpr("doc_id", "slice(ids, 2, 3) AS ids").collect()  # may start and end inside characters
    tok = vocab.word_bpe(byte_bpe.BYTE_BPE)
    got = byte_bpe.decode(spark.createDataFrame(cut, "doc_id long, ids array<int>")).collect()
    assert in_order(got) == in_order((r.doc_id, tok.decode(list(r.ids), skip_special_tokens=False)) for r in cut)


def test_byte_bpe_long_texts(spark):
    tok = vocab.word_bpe(byte_bpe.BYTE_BPE)
    long = [(1, "ab" * 400_000), (2, "Words and more, it's 12 of them.\n" * 250_000), (3, " " * 300_000 + "x")]
    got = {r.doc_id: tuple(r) for r in byte_bpe.bpe_digest(frame(spark, long)).collect()}
    for i, t in long:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True)


def test_characters_are_the_librarys():
    """Every assigned kind of character that differs by version is asked of the library."""
    bpe = byte_bpe.ByteBpe()
    code = np.array([0x41, 0x31, 0x20, 0x2E, 0xE9, 0xB2, 0xA0, 0x1C8A, 0x558, 0x10D40, 0x85, 0x1C, 0x200D])
    assert bpe.kind(code).tolist() == [1, 2, 3, 0, 1, 2, 3, 1, 0, 2, 3, 0, 0]


def spelled(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abé") for _ in range(r.randint(2, 7))) for _ in range(700)]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", "", " 1", "\n"]) for _ in range(r.randint(0, 400)))) for i in range(50)]
    rows += [(None, "ababab " * 30), (None, "ababab " * 30), (3, None), (4, ""), (5, "x" * 100_000 + " Ünder×÷ÿ" * 9)]
    long, huge = "ab" * 60, "q" * 30_000
    near = [long, long[:50] + "c" + long[51:], long + "x", long[:99] + "z", long[:99] + "zz", long[:100], long[:101], "a" * 100, "a" * 101, "a" * 102, "a" * 60 + "b" + "a" * 41]
    rows.append((60, "meridian " * 200 + "meridien " * 30 + "meridienn " * 6 + "merídian " * 9 + "Meridia " * 5))
    return rows + [(9 + i, " ".join(near + [huge, huge[:-1], huge[:9] + "r" + huge[10:]] * (i < 2))) for i in range(8)]


@pytest.mark.parametrize(("chars", "count", "ratio", "draw"), [(6, 5, 5, 7), (3, 2, 2, 7), (6, 5, 5, None)])
def test_spelling_variants(spark, chars, count, ratio, draw):
    rows = spelled()
    got = spelling.spelling_variants(frame(spark, rows), least_chars=chars, least_count=count, ratio=ratio, draw=draw)
    want = plain.spelling(rows, draw, chars, count, ratio)
    assert in_order(got.collect()) == in_order(want)
    assert sum(x[2] != x[0] for x in want) > 2 and any(len(x[0]) > 100 and x[4] for x in want)


def test_spelling_keys_with_collisions(spark):
    """With four keys in all, only the strings tell words apart."""
    counts = spark.createDataFrame([(w, n) for w, _, _, n, _, _ in plain.spelling(spelled(2), 7, 3, 2) if len(w) <= 100], "word string, n long")
    want = in_order(spelling.grouped(counts).collect())
    from typoforge.llm.base import U64, mix

    met = spelling._met

    def few(t):
        key = t["key"].to_numpy().view(np.uint64)
        order = np.lexsort((np.arange(len(key)), t["place"].to_numpy(), mix(key) & U64(3)))
        t = t.take(order)
        return met(t.set_column(0, "key", [(mix(t["key"].to_numpy().view(np.uint64)) & U64(3)).astype(np.int64)]))

    table = []
    for b in spelling._keyed(iter(counts.toArrow().combine_chunks().to_batches())):
        table.append(b)
    import pyarrow as pa

    every = pa.Table.from_batches(table).sort_by([("key", "ascending"), ("place", "ascending"), ("n", "descending"), ("word", "ascending")])
    a, b = (sorted(map(str, f(every).to_pylist())) for f in (met, few))
    # One word's best in a segment is its first or second row either way.
    assert a == b and len(a) > 100 and len(want) == counts.count()


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, []).limit(0)).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "short 12")])).count() == 0


def found():
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("a b c dé É x1 longer the the the of".split()) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, "a b c"), (7, "a b c"), (7, "a b c"), (8, None), (9, ""), (10, "the " * 600_000 + "rare")]
    return rows, [(1, "a b the"), (1, "a b the"), (2, None), (3, ""), (4, "nothing here"), (None, "rare É"), (5, "the of A a"), (6, "c " * 40)]


@pytest.mark.parametrize(("k", "block_bytes", "impacts"), [(10, 8_000_000, 1_000_000), (10, 12, 5), (400, 8_000_000, 50), (1, 30, 1)])
def test_search(spark, monkeypatch, k, block_bytes, impacts):
    rows, items = found()
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id int, text string, item int, doc_id string")
    monkeypatch.setattr(search, "IMPACTS", impacts)
    got = search.search(frame(spark, rows), queries, k=k, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score")
    assert in_order(got.collect()) == in_order(plain.search(rows, items, k))


def test_search_of_nothing(spark):
    rows, items = found()
    docs, queries = frame(spark, rows), spark.createDataFrame(items, "item_id int, text string")
    assert search.search(docs.limit(0), queries).count() == 0 and search.search(docs, queries.limit(0)).count() == 0
    assert search.search(docs, queries).schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"


def thue_morse(n, swap=False):
    """n letters a and b (n a power of two) whose sums modulo 2^64 are those of the swapped ones, for any odd base."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_and_lines_are_told_apart(spark, n):
    from typoforge.llm import near_dedup, quality, substring_dedup

    t, u = thue_morse(n), thue_morse(n, True)
    around = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*around[:17], x, *around[17:]])) for i, x in enumerate((t, u))] + [(2, t), (3, u)]
    rows.append((4, " ".join(f"v{i}" for i in range(60)) + f"\n{t}\n{u}\n{t}"))
    docs = frame(spark, rows)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_words(docs).collect()} == dict.fromkeys(range(5), 0)
    assert all(r.kept for r in near_dedup.near_digest(docs).collect())
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_digest(docs).collect()}[4] == 1


def test_word_hashes_of_every_length():
    from typoforge.llm.base import word_hashes

    r = random.Random(3)
    words = [bytes(r.choice(b"ab") for _ in range(n)) for n in range(130) for _ in range(20)]
    for shift in (b"", b"x", b"xyz"):
        data = shift + b"".join(words)
        ends = len(shift) + np.cumsum([len(w) for w in words])
        h = word_hashes(np.frombuffer(data, np.uint8), ends - [len(w) for w in words], ends)
        by = {}
        for w, x in zip(words, h.tolist(), strict=True):
            by.setdefault(x, set()).add(w)
        assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(words))


def test_the_only_good_document_is_not_in_its_model(spark):
    from typoforge.llm import lm_scoring

    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the", f"own{i}"]) for _ in range(40))) for i in range(11)]
    labels = lambda *good: spark.createDataFrame([(i, int(i in good), 0) for i in range(11)], "doc_id long, quality int, toxic int")
    one, none = ({x.doc_id: x.loss_difference for x in lm_scoring.score(frame(spark, rows), labels(*good)).collect()} for good in ((1,), ()))
    assert abs(one[1] - none[1]) < 1e-9 and all(one[i] < none[i] for i in range(11) if i != 1)
