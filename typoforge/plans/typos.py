"""Typos of names in tables of any size: worked out within a name's row, so that of all typos only hashes are shuffled."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import KEYBOARD, KEYWORDS, RESERVED
from ..functions.names import seeded

_NOT_NEW = frozenset({*RESERVED, *KEYWORDS})
#: Characters of names whose typos are hashed together.
BLOCK_CHARS = 1 << 16


@functools.lru_cache(1024)
def _slips(c: str) -> list[str]:
    near = KEYBOARD.get(c.lower()[0], "")  # the lower case of İ has two characters
    return sorted(near if c == c.lower() else near.upper())


def edits(name: str) -> list[tuple[int, int, str]]:
    """(position, characters that go, what comes) of each result of functions.names.typo_rows, by operation, position and result."""
    n = len(name)
    plain = [i for i in range(1, n) if name[i] != "_"]
    out = [(i, 1, name[i].swapcase()) for i in plain if name[i].isascii() and name[i].isalpha()]
    if n >= 4:
        out += [(i, 1, "") for i in plain]
    if n >= 3:
        out += [(i, 0, name[i]) for i in plain]
        out += [(i, 1, k) for i in plain for k in _slips(name[i])]
    if n >= 4:
        out += [(i, 2, name[i + 1] + name[i]) for i in plain if i + 1 < n and name[i + 1] not in ("_", name[i])]
    return out


def is_name(text: str) -> bool:
    """functions.names.is_identifier and not is_reserved."""
    return text.isidentifier() and text.isascii() and text not in _NOT_NEW and not (text.startswith("__") and text.endswith("__"))


def chosen_typo(name: str, taken: list[str], draw: int) -> str | None:
    """One of a name's typos that are names and not taken.  A long name's typos are long, so they are made one at a time."""
    made = edits(name)
    if name.isidentifier() and name.isascii() and name[0] != "_":  # no typo changes the first character or brings in another kind
        known = _NOT_NEW.union(taken)
        good = [e for e in made if name[: e[0]] + e[2] + name[e[0] + e[1] :] not in known]
    else:
        good = [e for e in made if is_name(t := name[: e[0]] + e[2] + name[e[0] + e[1] :]) and t not in taken]
    if not good:
        return None
    i, skip, put = good[draw % len(good)]
    return name[:i] + put + name[i + skip :]


# --------------------------------------------------------------------------- hashes of names and of all their typos

#: A name's hash is the sum of its code points times powers of an odd number, modulo 2^64: a typo's follows by a few sums.
_P = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_P, -1, 1 << 64))
_P = np.uint64(_P)
_UNDERSCORE = np.uint64(ord("_"))
#: Neighbours of each ASCII character on the keyboard, filled up with 0.
_NEAR = np.array([[*map(ord, _slips(chr(c))), *[0] * (max(map(len, KEYBOARD.values())) - len(_slips(chr(c))))] for c in range(128)], np.uint64)
#: The only other characters with neighbours, İ and the Kelvin sign, by a letter with the same.
_LIKE = {0x130: ord("I"), 0x212A: ord("K")}


def _hashed(names: list[str | None]) -> tuple[np.ndarray, ...]:
    """(hash of each name, and of each character: its name's row and length, its position and code point, its power, the sum before it)."""
    size = np.fromiter((len(x or "") for x in names), np.int64, len(names))
    code = np.frombuffer("".join(x or "" for x in names).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(names)), size)
    at = np.arange(len(code)) - (ends - size)[row]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size.max(initial=0), _P)]))[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power)])
    before = sums[ends - size]
    return sums[ends] - before, row, size[row], at, code, power, sums[:-1] - before[row]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["name"], pa.array(_hashed(b["name"].to_pylist())[0].view(np.int64))], ["name", "key"])


def _blocks(names: list[str | None]) -> Iterator[list[str | None]]:
    first = chars = 0
    for i, x in enumerate(names):
        if chars > BLOCK_CHARS:
            yield names[first:i]
            first, chars = i, 0
        chars += len(x or "")
    yield names[first:]


def typo_hashes(names: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of a name, hash of a typo) for all results of edits(); once for a run of equal letters."""
    own, row, n, at, code, power, left = _hashed(names)
    whole, term = own[row], code * power
    right, after, prior = whole - left - term, np.append(code[1:], _UNDERSCORE), np.append(_UNDERSCORE, code[:-1])
    plain = (at > 0) & (code != _UNDERSCORE)
    first = plain & ((at == 1) | (code != prior))
    letter = ((code | np.uint64(32)) >= ord("a")) & ((code | np.uint64(32)) <= ord("z"))
    made = [
        (plain & letter, lambda m: whole[m] + ((code[m] ^ np.uint64(32)) - code[m]) * power[m]),
        (first & (n >= 4), lambda m: left[m] + right[m] * _BACK),
        (first & (n >= 3), lambda m: left[m] + term[m] + (term[m] + right[m]) * _P),
        (plain & (n >= 4) & (at < n - 1) & (after != _UNDERSCORE) & (after != code), lambda m: whole[m] + (after[m] - code[m]) * (power[m] - power[m] * _P)),
    ]
    keys = np.where(code < 128, code, 0).astype(np.int64)
    for c, same in _LIKE.items():
        keys[code == c] = same
    near = _NEAR[keys]
    for k in near.T:
        made.append((plain & (n >= 3) & (k > 0), lambda m, k=k: whole[m] + (k[m] - code[m]) * power[m]))
    return np.concatenate([whole[m] for m, _ in made]), np.concatenate([f(m) for m, f in made])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in _blocks(b["name"].to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in typo_hashes(block)], ["of", "key"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b["name"].to_pylist(), b["taken"].to_pylist(), b["draw"].to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([b["name"], pa.array([chosen_typo(name or "", taken or [], draw) for name, taken, draw in rows], pa.string())], ["name", "typo"])


def picked_typos(names: DataFrame, seed: int) -> DataFrame:
    """Distinct names (name) with a seeded choice among the valid typos of each that are no names themselves, or null.

    Which typos are names is asked by hashes.  Names with such a hash go back to the name that asked, which compares
    strings, so equal hashes of others change nothing.  All sides grow with the names, so no join may collect one for
    a broadcast.
    """
    n = names.select("name").mapInArrow(_keyed, "name string, key long")
    tasks = 4 * names.sparkSession.sparkContext.defaultParallelism  # names are few bytes, their typos many rows
    asked = n.repartition(tasks, "key").mapInArrow(_asked, "of long, key long")
    met = asked.join(n.hint("merge"), "key").select(F.col("of").alias("key"), "name")
    taken = met.groupBy("key").agg(F.collect_list("name").alias("taken"))
    rows = n.join(taken.hint("merge"), "key", "left").select("name", "taken", seeded(seed, F.col("name")).alias("draw"))
    return rows.mapInArrow(_chosen, "name string, typo string")
