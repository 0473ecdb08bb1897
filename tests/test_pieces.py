"""Longest-match pieces and their alignment against a plain version."""

import random

from typoforge.operators.pieces import aligned, longest_pieces


def cut(word, vocab, longest):
    out, at = [], 0
    while at < len(word):
        for n in range(min(longest, len(word) - at), 0, -1):
            piece = ("##" if at else "") + word[at : at + n]
            if piece in vocab:
                out.append((at, n, vocab[piece]))
                at += n
                break
        else:
            return [(0, len(word), 2)]
    return out


def test_pieces_and_alignment(spark):
    r = random.Random(1)
    text = lambda k: "".join(r.choice("abcé") for _ in range(k))
    vocab = {p: i for i, p in enumerate(sorted({text(r.randint(1, 4)) for _ in range(40)} | {"##" + text(r.randint(1, 5)) for _ in range(60)} - {"##é"} | {"##a", "##b", "##c", "a", "b", "c"}), 3)}
    words = [text(r.randint(0, 14)) for _ in range(300)] + ["é" * 40, "abc" * 200]
    v = spark.createDataFrame([(p, i) for p, i in vocab.items()], "piece string, idx int")
    rows = [(s, k, r.choice(words)) for s in range(12) for k in range(r.randint(0, 60))] + [(50, 0, ""), (51, 0, "abc" * 200)]
    tokens = spark.createDataFrame(rows, "sample_index long, pos int, text string").repartition(3)
    for longest in (16, 2):
        made = longest_pieces(tokens.withColumnRenamed("text", "word"), v, longest=longest)
        got = {x.word: [tuple(p) for p in x.pieces] for x in made.collect()}
        assert got == {w: cut(w, vocab, longest) for _, _, w in rows if w}
    assert any(p == [(0, len(w), 2)] for w, p in got.items()) and any(len(p) > 5 for p in got.values())
    want = []
    for s in {x[0] for x in rows}:
        flat = [(i, k, a, a + n) for _, k, w in sorted(x for x in rows if x[0] == s) for a, n, i in cut(w, vocab, 2)][:30]
        want += [(s, p, *x) for p, x in enumerate([(0, None, None, None), *flat, (1, None, None, None)])]
    assert sorted(map(str, map(tuple, aligned(tokens, made, most=32).collect()))) == sorted(map(str, want))
    assert longest_pieces(tokens.limit(0), v, word="text").count() == 0
    assert [len(x.pieces) for x in longest_pieces(tokens, v.limit(0), word="text").limit(5).collect()] == [1] * 5
