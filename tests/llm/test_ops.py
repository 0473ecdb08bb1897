"""The corpus operators on small tables against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import plain
import pytest

from typoforge.llm import decontaminate, lm_scoring, near_dedup, pii, quality, substring_dedup, subwords, suffix_dedup, token_counts, token_file, vocab
from typoforge.llm.base import text_bytes
from typoforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, n long"


def corpus(seed=1):
    """Texts with shared passages, near copies, repeats within a text, short, empty and null ones, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "é", "or", "ing", "x", "ß", "tion"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() + r.choice(["", "", ",", ".\n"]) for _ in range(n))
    passage, line = text(60), "L" * 150
    out = [text(r.randint(0, 150)) for _ in range(30)]
    out += [text(20) + passage + text(25) for _ in range(6)] + [line + text(50) for _ in range(8)] + [passage, passage + " " + passage]
    base = text(300).split(" ")
    for k in range(8):
        copy = list(base)
        copy[k * 7] = "changed"
        out.append(" ".join(copy))
    out += ["", " \n\t", "a b", "a b", None, None, "ab " * 400, "mail a@b.co +1 234 567 89 10.0.0.1 4111 1111 1111 1111", "one\ntwo\none\n\n"]
    rows = [(i, t, r.choice(["en", "de", None]), "s", len(t or ""), 0, "k", 0) for i, t in enumerate(out)]
    return [*rows, rows[3], rows[40], (None, out[5], None, None, None, 0, "k", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def expect(rows):
    from pyspark.sql import Row

    return sorted(str(Row(**x)) for x in rows)


@pytest.mark.parametrize("hot", [None, 1])
def test_bytes_repeats(docs, hot):
    texts = [(r[0], (r[1] or "").encode()) for r in corpus()]
    n = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        want.append({"doc_id": d, "n_bytes": len(t), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()})
    got = suffix_dedup.remove_repeats(docs, hot=hot)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expect(want)


@pytest.mark.parametrize("hot", [None, 1])
def test_word_repeats(docs, hot):
    texts = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    n = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    want = []
    for d, w in texts:
        gone = {i + k for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for k in range(35)}
        want.append({"doc_id": d, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()})
    got = substring_dedup.remove_repeated_words(docs, hot=hot, with_text=True)
    assert pairs(got, "doc_id", "n_words", "n_removed", "kept_sha256") == expect(want)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_repeats_of_null_ids(spark):
    """Texts whose 32-bit hashes are equal, beside a null id and an id of -1, are still told apart."""
    seen, pair = {}, None
    hashes = spark.range(300000).selectExpr("id", "hash(concat(repeat(concat('word', id, ' '), 60), 'end')) AS h").groupBy("h").agg({"id": "min", "*": "count"})
    twice = hashes.filter("`count(1)` > 1").limit(1).collect()
    if twice:
        ids = [x.id for x in spark.range(300000).selectExpr("id", "hash(concat(repeat(concat('word', id, ' '), 60), 'end')) AS h").filter(f"h = {twice[0].h}").collect()]
        pair = [f"word{i} " * 60 + "end" for i in ids[:2]]
    a, b = pair or ["x1 " * 90, "x2 " * 90]
    own = lambda t: " ".join(f"{w}{i}" for i, w in enumerate(t.split()))
    rows = [(None, own("p " * 90)), (None, own("q " * 90)), (-1, own("r " * 90)), (7, own("p " * 90)), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeated_words(docs).collect()}
    assert (None, 90) in got and (7, 90) in got and (-1, 0) in got and (None, 0) in got
    got = {(r.doc_id, r.n_removed > 0) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {(None, True), (None, False), (7, True), (-1, False)}


def test_factoring():
    """Blocks of pieces against counting; without its factors the parse would miss windows, as most lie inside of one."""
    import time

    from typoforge.llm.repeats import Contexts
    from typoforge.llm.substring_dedup import KIND, Reference, solve

    def contexts(places, texts, copies):
        cut = [(d, p, max(0, p - KIND.width + 1), min(len(texts[d]), p + KIND.length)) for d, p in places]
        sym = np.concatenate([texts[d][a:b] for d, _, a, b in cut]).astype(np.uint64)
        off = np.concatenate([[0], np.cumsum([b - a for _, _, a, b in cut])])
        col = lambda k: np.array([c[k] for c in cut], np.int64)
        return Contexts(sym.view(np.uint8), sym, off, col(1) - col(2), np.array(copies), np.zeros(len(cut), np.int64), col(0), col(1)), cut

    r = np.random.default_rng(3)
    for _ in range(150):
        base = r.integers(0, 9, 400)
        texts = [np.concatenate([r.integers(0, 9, r.integers(0, 30)), base[(s := r.integers(0, 200)) : s + r.integers(30, 200)], r.integers(0, 9, 40)]) for _ in range(6)]
        texts.append(np.tile([1, 2, 3], 40))
        places = sorted({(int(d), int(p)) for d in range(7) for p in r.integers(0, len(texts[d]) - 35, 5)})
        copies = [int(r.integers(1, 3)) if r.random() < 0.1 else 1 for _ in places]
        c, cut = contexts(places, texts, copies)
        seen = {}
        for d in range(7):
            there = {i for x, _, a, b in cut if x == d for i in range(a, b)}
            for i in there:
                if all(i + k in there for k in range(35)):
                    seen.setdefault(tuple(texts[d][i : i + 35].tolist()), set()).add((d, i))
        want = np.zeros((len(cut), KIND.width), bool)
        for k, (d, p, a, b) in enumerate(cut):
            for i in range(a, min(b - 34, p + 1)):
                want[k, p - i] = copies[k] > 1 or len(seen[tuple(texts[d][i : i + 35].tolist())]) > 1
        assert (solve(c, KIND) == want).all()
    texts = [np.concatenate([r.integers(9, 2**60, 23), base[:35], r.integers(9, 2**60, 40)]) for _ in range(8000)]
    c, _ = contexts([(d, 23) for d in range(8000)], texts, [1] * 8000)
    start = time.perf_counter()
    made = solve(c, KIND)
    assert time.perf_counter() - start < 5 and made[:, 0].all() and made.sum() == 8000
    ref = Reference(c)
    find = ref.longest
    ref.longest = lambda at: np.minimum(find(at), 34)  # no factor is long enough, no boundary finds a window
    assert not ref.repeated(35).any()


def test_windows_come_from_factors_and_their_boundaries():
    """Matches are looked up where factors start and for windows that cross an end, nowhere else; neither will do alone."""
    from typoforge.llm.repeats import Contexts
    from typoforge.llm.substring_dedup import LONGEST, Reference

    r = np.random.default_rng(5)
    passage = r.integers(1, 2**60, 300)
    texts = [np.concatenate([r.integers(1, 2**60, 20), passage[a : a + n], r.integers(1, 2**60, 20)]) for a, n in ((0, 300), (10, 250), (100, 64), (200, 50), (0, 34))]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sym = np.concatenate(texts).astype(np.uint64)
    zero = np.zeros(len(texts), np.int64)
    ref = Reference(Contexts(sym.view(np.uint8), sym, off, zero, zero + 1, zero, np.arange(len(texts)), zero))
    seen, find = [], ref.longest
    ref.longest = lambda at: (seen.append(at), find(at))[1]
    known = ref.repeated(35)
    windows = Counter(tuple(t[i : i + 35]) for t in texts for i in range(len(t) - 34))
    want = np.zeros(len(sym), bool)
    for d, t in enumerate(texts):
        for i in range(len(t) - 34):
            want[off[d] + i] = windows[tuple(t[i : i + 35])] > 1
    assert (known == want).all() and want.sum() > 400
    inside, ends = ref.spans(35)
    assert inside.any() and (want & ~inside).any() and not (inside & ~want).any()  # without the boundary check, windows are missed
    starts, sizes = ref.factors()
    assert sizes.max() <= LONGEST and sizes.sum() == len(sym) and (np.diff(starts) == sizes[:-1]).all()
    looked = np.unique(np.concatenate(seen))
    allowed = np.union1d(starts, np.flatnonzero(np.arange(len(sym)) + 35 > ends))
    assert np.isin(looked, allowed).all() and len(looked) < len(sym)


def test_suffix_arrays():
    r = random.Random(7)
    for t in range(1500):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 50))]
        s = ((s[:4] * 12)[: len(s)] if t % 3 == 0 else s) + [0]
        assert suffix_dedup.grouping_suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [0, 1 << 17])
def test_token_counts(docs, hot):
    sp = vocab.pieces()
    want = [{"doc_id": r[0], "n_bytes": len((r[1] or "").encode()), "n_tokens": len(sp.encode(r[1] or "")), "over_limit": False} for r in corpus()]
    assert pairs(token_counts.count_digest(docs, hot_most=hot), "doc_id", "n_bytes", "n_tokens", "over_limit") == expect(want)


def test_fragments_are_exact():
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "the", " ", "  ", "\n", "\t", "é", "▁", "Ａ", ".", ",", "\r", "B2", "<s>", "\0"]) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    import pyarrow.compute as pc

    flat, off = vocab.fragments(pc.replace_substring(pa.array(texts), "▁", " "))
    ids = vocab.piece_ids(vocab.pieces(), flat.to_pylist())
    assert [sum(ids[a:b], []) for a, b in zip(off[:-1], off[1:], strict=True)] == vocab.pieces().encode(texts)


def test_decontamination(spark, docs):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))
    passage = corpus()[32][1]
    items = [("7", passage), ("10", " ".join(words(passage)[20:28])), ("3", "A B"), ("3", "mail"), (None, "one two one"), ("x", ""), ("y", None), ("z", "nowhere to be found at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    window = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            window.setdefault(tuple(w[a : a + n]), set()).add("null" if i is None else i)
    want = []
    for row in corpus():
        w, hit, found = words(row[1]), set(), set()
        for n in {len(k) for k in window}:
            for a in range(len(w) - n + 1):
                if (x := window.get(tuple(w[a : a + n]))):
                    found |= x
                    hit |= set(range(a, a + n))
        want.append({"doc_id": row[0], "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)})
    for block in (32_000_000, 40):  # one block, and several
        assert pairs(decontaminate.leak_digest(docs, bench, block_bytes=block), *want[0]) == expect(want), block
        bad = {x["doc_id"] for x in want if x["contaminated"]}
        left = decontaminate.decontaminate(docs, bench, block_bytes=block)
        assert left.columns == docs.columns and not bad & {r.doc_id for r in left.collect()} and left.count() == sum(not x["contaminated"] for x in want)
    clash = docs.withColumnsRenamed({"pos": "_id", "key": "_th", "n": "_hits"})
    cut = decontaminate.decontaminate(clash, bench, mode="spans")
    assert cut.columns == clash.columns and cut.count() == len(want)
    many = decontaminate.Windows([(str(i), " ".join(f"w{i}x{k}" for k in range(100))) for i in range(4000)])
    import pickle

    assert len(pickle.dumps(many)) < 12 * sum(len(f"w{i}x{k} ") for i in range(4000) for k in range(100))


@pytest.mark.parametrize("hot", [None, 0, 30])
def test_lm_scores(spark, docs, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(lm_scoring, "HOT_MOST", hot)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)] + [(2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sp = vocab.pieces()
    want = plain.held_out_losses(sp.encode, sp.get_piece_size(), [r[:2] for r in corpus()], set(range(0, 40, 2)), lm_scoring.PRIOR)
    clash = docs.withColumnsRenamed({"pos": "of", "key": "good", "n": "row"})
    got = lm_scoring.score(clash, labels).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and g[2] == (w[2] and pytest.approx(w[2], abs=1e-9))


def test_lm_models_are_distributions(spark, docs):
    sp = vocab.pieces()
    v, r = sp.get_piece_size(), np.random.default_rng(1)
    counts = r.integers(0, 3, (2, 40, 30))  # of bigrams of few pieces
    counts[1] += counts[0]
    uni, begun = np.zeros((2, v + 1), np.int64), np.zeros((2, v + 1), np.int64)
    uni[:, 1:31], begun[:, :40] = counts.sum(axis=1), counts.sum(axis=2)
    m = lm_scoring.Models(uni, begun)
    own = np.minimum(counts[0], r.integers(0, 2, (40, 30)))  # a good document's bigrams, which are held out
    for doc in (own, own * 0):
        for h in range(40):
            c, mine, right = np.zeros((2, v), np.int64), np.zeros(v, np.int64), np.zeros(v, np.int64)
            c[:, :30], mine[:30], right[:30] = counts[:, h], doc[h], doc.sum(axis=0)
            logs = m.logs(h << 32 | np.arange(v), c, mine, np.full(v, doc[h].sum()), right, np.full(v, doc.sum()), np.ones(v, bool))
            assert [np.exp(x).sum() for x in logs] == pytest.approx([1.0, 1.0])


def test_no_labelled_document(spark, docs):
    sp, labels = vocab.pieces(), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = plain.held_out_losses(sp.encode, sp.get_piece_size(), [r[:2] for r in corpus()], set(), lm_scoring.PRIOR)
    got = lm_scoring.score(docs, labels).collect()
    assert sorted(round(r.loss_difference, 9) for r in got if r.n_tokens) == sorted(round(w[2], 9) for w in want if w[1])


def test_token_file(docs, spark, tmp_path):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*e.ids, 1] for e in vocab.word_bpe().encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    start, want = 0, []
    for r, x in zip(rows, ids, strict=True):
        want.append({"doc_id": r[0], "start": start, "n_tokens": len(x), "ids_crc32": zlib.crc32(np.array(x, "<u4").tobytes())})
        start += len(x)
    path = str(tmp_path / "ids")
    token_file.write_ids(docs, path, segment_ids=200)
    back = token_file.read_ids(spark, path, with_ids=True)
    assert pairs(back, "doc_id", "start", "n_tokens", "ids_crc32") == expect(want)
    assert [r.ids for r in back.orderBy("start").collect()] == ids


def test_word_tiles_are_exact():
    r = random.Random(5)
    parts = ["a", "the", " ", ". ", ", ", "\n", "É", "́", "don't", ".", "Hello", "İ", "'S", "\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "((", " ", "ΑΣ", "n't."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    table = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

    class Here:
        def partitionId(self):  # noqa: N802
            return 0

    held, token_file.TaskContext.get = token_file.TaskContext.get, staticmethod(Here)
    try:
        got = [token_file.unpack(s.as_py()) for b in token_file._encode(vocab.WORD_BPE, 1, 1000)(iter([table])) for s in b["segment"]]
    finally:
        token_file.TaskContext.get = held
    flat = [ids[a - n : a].tolist() for ids, lens in got for a, n in zip(np.cumsum(lens), lens, strict=True)]
    assert flat == [[*e.ids, 1] for e in vocab.word_bpe().encode_batch(texts, add_special_tokens=False)]


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def exact_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [{"doc_id": d, "n_shingles": len(s), "component_id": None if d is None else find(d), "kept": d is None or find(d) == d} for d, s in sets]


def test_near_duplicates(docs):
    want = exact_components([(r[0], r[1]) for r in corpus()])
    assert pairs(near_dedup.near_digest(docs), *want[0]) == expect(want)
    clash = docs.withColumnsRenamed({"pos": "_id", "key": "id", "n": "hash"})
    kept = near_dedup.drop_near_duplicates(clash)
    assert kept.columns == clash.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({x["doc_id"] for x in want if x["kept"] and x["doc_id"] is not None})


def test_near_duplicates_of_one_link(spark):
    """3,000 copies that differ by a word each, and outliers that link with exactly one of them."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]

    def changed(words, tag, places):
        return [f"{tag}x{k}" if k in places else w for k, w in enumerate(words)]

    copies = [changed(base, f"c{i}", {5 + i % 190}) for i in range(3000)]
    rows = [(i, " ".join(c)) for i, c in enumerate(copies)]
    for i in range(120):
        parent = 25 * i
        places = r.sample([k for k in range(8, 192, 12) if abs(k - 5 - parent % 190) > 8], 3)
        rows.append((4000 + i, " ".join(changed(copies[parent], f"o{i}", set(places)))))
    sets = {d: shingle_set(t) for d, t in rows}
    for d in range(4000, 4120):
        near = [i for i in range(3000) if 100 * len(sets[d] & sets[i]) >= 85 * len(sets[d] | sets[i])]
        assert near == [25 * (d - 4000)]
    got = near_dedup.near_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x.component_id for x in got.collect()} == {0}


def test_near_duplicates_of_one_source(spark):
    """A star: 1,100 copies at 0.85 to 0.9 to their source and below 0.85 to each other, so nothing but the source links them."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(404)]
    rows = [(5000, " ".join(base))]
    for i in range(1100):
        at = r.randint(0, 3)
        copy = list(base)
        for k in range(r.choice([4, 5, 6])):
            copy[(at + 60 * k + r.randint(0, 49)) % 404] = f"v{i}x{k}"
        rows.append((i, " ".join(copy)))
    sets = [shingle_set(t) for _, t in rows]
    near = [100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets]
    assert all(near)
    got = near_dedup.near_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in got.collect()} == {0}


def test_forgotten_tables(spark):
    import os

    from typoforge.llm.base import forget, store

    t = store(spark.range(3), "kept")
    path = t.stored_at
    assert t.count() == 3 and os.path.exists(path)
    forget(t, None, spark.range(1))
    assert not os.path.exists(path)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)] + [(200, 201 + i) for i in range(20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 90: 90, 95: 90, 100: 90, **{200 + i: 200 for i in range(21)}}


def test_pii(docs):
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("a@.-+ 0123b1.. 2-(@é%") for _ in range(r.randint(0, 40)))
        assert [x for x in pii.find(t) if x[0] in pii.BASE] == pii.brute(t)
    want = [{"doc_id": x[0], "base_sha256": hashlib.sha256(pii.joined(pii.brute(x[1] or "")).encode()).hexdigest(), "n_email": sum(k == "email" for k, _, _ in pii.brute(x[1] or ""))} for x in corpus()]
    assert pairs(pii.pii_digest(docs), *want[0]) == expect(want)
    t = "see https://a.example/x. Account no: 1234 5678, IBAN GB82 WEST 1234 5698 7654 32"
    assert {k for k, _, _ in pii.find(t)} >= {"url", "account", "iban"} and "[URL]" in pii.redacted(t, pii.find(t))
    clash = docs.withColumnsRenamed({"pos": "whole", "key": "_whole", "n": "spans"})
    assert pii.redact_pii(clash).columns == clash.columns and quality.keep_good(clash).columns == clash.columns
    clean = pii.redact_pii(docs)
    assert clean.columns == docs.columns and all(not pii.brute(x.text or "") for x in clean.collect() if x.doc_id is not None)


def test_ibans_after_a_cue():
    raw = "DE89 3704 0044 0532 0130 00"
    for t in (f"IBAN: {raw} BIC COBADEFFXXX", f"iban for payments by bank transfer only: {raw}", f"IBAN AB12 3456 7890 1234 or {raw}.", f"IBAN:{raw.replace(' ', '')}", f"IBAN{raw}", "IBAN" + "." * 59 + raw):
        assert [t[s:e].replace(" ", "") for k, s, e in pii.find(t) if k == "iban"] == [raw.replace(" ", "")], t
        assert raw not in pii.scrubbed(t)
    assert not [x for x in pii.find(f"IBAN {raw[:-1]}1 BIC") if x[0] == "iban"]


def test_quality(docs, spark):
    want = [{"doc_id": x[0], **plain.quality_counts(x[1])} for x in corpus()]
    assert pairs(quality.measure(docs), *want[0]) == expect(want)
    kept = {x.doc_id for x in quality.measure(docs).filter("kept").collect()}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {x.doc_id for x in good.collect()} == kept
    noise = "".join(random.Random(4).choice("qzxjkvwpy#$%&|<>") for _ in range(2000))
    odd = spark.createDataFrame([(1, " ".join(noise[i : i + 9] for i in range(0, 2000, 9)), "en")], "doc_id long, text string, lang string")
    assert [x.kept for x in quality.measure(odd).collect()] == [False]


PROSE = {
    "cyrillic": ("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами без какого бы то ни было различия, как то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения.", "а", "я"),
    "greek": ("Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες.", "α", "ω"),
    "arabic": ("يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو الميلاد.", "ا", "ي"),
    "devanagari": ("सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आज़ादियों को प्राप्त करने का हक़ है और इस मामले में जाति, वर्ण, लिंग, भाषा, धर्म, राजनीति या अन्य विचार.", "अ", "ह"),
    "hangul": ("모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해, 민족적 또는 사회적 출신, 재산, 출생 또는 기타의 신분과 같은 어떠한 종류의 차별이 없이, 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다.", "가", "힣"),
    "han": ("人人 生而 自由, 在 尊严 和 权利 上 一律 平等. 他们 赋有 理性 和 良心, 并 应 以 兄弟 关系 的 精神 相 对待. 人人 有 资格 享有 本 宣言 所载 的 一切 权利 和 自由, 不分 种族, 肤色, 性别, 语言, 宗教, 政治 或 其他 见解, 国籍 或 社会 出身, 财产, 出生 或 其他 身份 等 任何 区别. 人人 有权 享有 生命.", "一", "龥"),
    "hebrew": ("כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחרויות שנקבעו בהכרזה זו ללא הפליה כלשהי מטעמי גזע, צבע, מין, לשון, דת, דעה פוליטית או דעה בבעיות אחרות, בגלל מוצא לאומי או חברתי, קנין, לידה או מעמד אחר.", "א", "ת"),
}


def test_quality_bands_by_script(spark):
    """Prose of each script stays, random letters of it in words of the same lengths go."""
    r, rows = random.Random(5), []
    for k, (text, a, b) in enumerate(PROSE.values()):
        rows.append((2 * k, text, None))
        rows.append((2 * k + 1, " ".join("".join(chr(r.randint(ord(a), ord(b))) for _ in range(max(2, len(w)))) for w in (text.split() * 3)), "xx"))
    data, off = text_bytes(pa.array([x[1] for x in rows]))
    assert [quality.SCRIPTS[k] for k in quality.scripts(data, off)] == [s for s in PROSE for _ in range(2)]
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {k: (False, k % 2 == 0) for k in range(2 * len(PROSE))}


def test_fitted_bands(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    bands = quality.fit_bands(docs, labels, least_rows=5)
    assert set(bands) <= {"en", "de", "fr", "es"} and "en" in bands
    good = {x.doc_id for x in labels.filter("quality = 1").collect()}
    lang = {x.doc_id: x.lang for x in docs.collect()}
    own = quality.measure(docs, bands={**quality.BANDS, **bands}).collect()
    assert all(x.kept for x in own if x.doc_id in good and not x.base_failed and lang[x.doc_id] in bands)
    assert all(b.least_chars >= quality.BANDS[k].least_chars and b.least_byte_chars >= quality.BANDS[k].least_byte_chars for k, b in bands.items())


def test_subwords(docs):
    got = subwords.pieces_digest(docs, with_ids=True)
    assert got.filter("not lossless").count() == 0
    encoded = subwords.encode_pieces(docs)
    texts = sorted(x.text for x in subwords.decode_pieces(encoded).collect())
    assert texts == sorted((r[1] or "") for r in corpus())
    again = subwords.encode_pieces(docs.repartition(1))
    assert pairs(encoded, "doc_id", "ids") == pairs(again, "doc_id", "ids")
    exact = {r[0]: vocab.pieces().encode(r[1] or "") for r in corpus() if r[0] is not None}
    same = {r.doc_id: r.ids for r in subwords.encode_pieces(docs, dropout=0.0).collect() if r.doc_id is not None}
    assert same == exact and any(r.ids != exact[r.doc_id] for r in encoded.collect() if r.doc_id is not None)
    want = {r[0]: plain.dropped_merges(vocab.pieces(), r[1] or "", r[0], subwords.SEED, subwords.DROPOUT) for r in corpus()}
    assert all(r.ids == want[r.doc_id] for r in encoded.collect())
    ab = spark_free(subwords.Codec(), ["ab " * 300] * 2)
    assert ab[0] != ab[1] and len(set(ab[0])) > 2  # occurrences of a pre-token differ, within and across documents


def test_merge_dropout_by_hand():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", "the", "ing", " ", "  ", "é", "er", "on", ".", "\n", "▁", "漢", "\0", "internationalisation"]) for _ in range(r.randint(0, 14))) for _ in range(700)]
    texts += ["a▁b", "▁", " ▁ ", "x" * 90, "the" * 40, " " * 70]
    for dropout in (0.0, 0.1, 0.5):
        ids = spark_free(subwords.Codec(dropout=dropout), texts)
        assert ids == [plain.dropped_merges(vocab.pieces(), t, i, subwords.SEED, dropout) for i, t in enumerate(texts)]


def spark_free(c, texts):
    ids, off = c.encode(pa.array(texts), np.array([subwords.document_key(subwords.SEED, i) for i in range(len(texts))], np.uint64))
    data, at = c.decode(ids, off)
    assert [data[at[i] : at[i + 1]].tobytes().decode() for i in range(len(texts))] == texts
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        suffix_dedup.remove_repeats(empty), substring_dedup.remove_repeated_words(empty), token_counts.count_digest(empty), decontaminate.leak_digest(empty, bench), lm_scoring.score(empty, labels),
        token_file.ids_digest(empty), near_dedup.near_digest(empty), pii.pii_digest(empty), quality.measure(empty), subwords.pieces_digest(empty),
    ]
    assert [m.count() for m in made] == [0] * 10
