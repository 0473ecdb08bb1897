"""Plain versions of what the operators compute, one text and one step at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

_WHOLE = (1 << 64) - 1


def _mix(x):
    x &= _WHOLE
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WHOLE
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WHOLE
    return x ^ (x >> 31)


def pre_tokens(text):
    """A text with its dummy space, cut before runs of spaces, around line feeds, and before . and , after A-Z a-z 0-9."""
    if not text:
        return []
    s = " " + text
    starts = [
        i for i in range(len(s))
        if i == 0 or s[i] == "\n" or s[i - 1] == "\n" or (s[i] == " " != s[i - 1]) or (s[i] in ".," and s[i - 1].isascii() and s[i - 1].isalnum())
    ]
    return [s[a:b] for a, b in zip(starts, [*starts[1:], len(s)], strict=True)]


def dropped_merges(sp, text, doc_id, seed, dropout):
    """Ids of a text by merge-dropout with keyed draws, merging one pair at a time."""
    cut, out = round(dropout * 65536), []
    key = int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")

    def piece(s):
        i = sp.piece_to_id(s)
        return i if sp.id_to_piece(i) == s and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) else None

    for place, token in enumerate(pre_tokens(text)):
        h = _mix(key + place * 0x9E3779B97F4A7C15)
        if len(token) <= 12:
            lanes = [_mix(h + k // 4 + 1) >> 16 * (k % 4) & 0xFFFF for k in range(min(16, len(token) + 1))]
            first = [x < cut for x in lanes]
            after = _mix(sum(b << k for k, b in enumerate(first)) + 1)
        else:
            first, after = [], h
        draw = lambda t, first=first, after=after: first[t] if t < len(first) else (_mix(after + t) & 0xFFFF) < cut
        symbols = ["▁" if c == " " else None if c == "▁" or piece(c) is None else c for c in token]
        spelled, fresh, t = list(token), [True] * (len(token) - 1), 0
        while True:
            best = None
            for i in range(len(symbols) - 1):
                if fresh[i] and None not in symbols[i : i + 2] and (p := piece(symbols[i] + symbols[i + 1])) is not None and (best is None or sp.get_score(p) > best[0]):
                    best = sp.get_score(p), i
            if best is None:
                break
            i = best[1]
            if cut:
                t += 1
                if draw(t - 1):
                    fresh[i] = False
                    continue
            symbols[i : i + 2], spelled[i : i + 2] = [symbols[i] + symbols[i + 1]], [spelled[i] + spelled[i + 1]]
            del fresh[i]
            fresh[max(i - 1, 0) : i + 1] = [True] * len(fresh[max(i - 1, 0) : i + 1])
        for s, c in zip(symbols, spelled, strict=True):
            out += [sp.piece_to_id(f"<0x{b:02X}>") for b in c.encode()] if s is None else [piece(s)]
    return out


def held_out_losses(encode, size, rows, good, prior):
    """Mean loss_target - loss_background of rows (id, text), each scored by bigram models counted anew over all others."""
    ids = [encode(t or "") for _, t in rows]

    def model(corpus):
        pieces, pairs, begun = Counter(), Counter(), Counter()
        for x in corpus:
            for h, w in zip([-1, *x], x, strict=False):
                pieces[w] += 1
                pairs[h, w] += 1
                begun[h] += 1
        return pieces, pairs, begun, sum(pieces.values())

    out = []
    for k, ((d, _), x) in enumerate(zip(rows, ids, strict=True)):
        others = [i for i in range(len(rows)) if i != k]
        target, background = model([ids[i] for i in others if rows[i][0] in good]), model([ids[i] for i in others])
        ratio = target[3] / background[3] if target[3] and background[3] else 1.0

        def loss(m, scale, h, w):
            pieces, pairs, begun, n = m
            back = (pieces[w] * scale + 0.5) / (n * scale + size / 2)
            return -math.log((pairs[h, w] * scale + prior * back) / (begun[h] * scale + prior))

        each = [loss(target, 1.0, h, w) - loss(background, ratio, h, w) for h, w in zip([-1, *x], x, strict=False)]
        out.append((d, len(x), sum(each) / len(each) if each else None))
    return out


def quality_counts(text):
    """The base counts of the quality rules."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    return out | {"base_failed": out["n_words"] < 50 or 100 * len(hit) > 50 * len(w)}


def edits_apart(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(rows, draw=199, chars=6, count=5, ratio=5):
    """word, form, root, n, n_near, form_n of the words of (id, text) rows, every pair of like lengths compared."""
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if draw and h % draw == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= chars and k >= count}
    by_length, near = {}, {w: [] for w in n}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, ()) if edits_apart(w, v)]
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return [(w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()]


def search(docs, items, k=10):
    """(item, rank, document, score) of every item, each document scored term by term."""
    term = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(term(t))) for d, t in docs]
    some = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * some + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for i, t in items:
        scored = []
        for d, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * some // total if total else 0
            s = sum(weight[w] * (1000000000 * b[w] // (1000 * b[w] + 8 * m)) for w in term(t) if b[w])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return out
