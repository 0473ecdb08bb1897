"""Edit tags and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CASE, DEL, DELETE, EDIT_ALPHABET, INS, MAX_POSITION, REPLACE, SUB, SWAP


def _at(s: Column, i: Column) -> Column:
    return F.substr(s, i + 1, F.lit(1))


def normalised_distance(a: Column, b: Column, near: tuple[int, ...] = ()) -> Column:
    """Levenshtein distance over the longer length, in code points; 0 of two empty texts.

    With `near`, a distance of so much at most is looked for first, in turn, which takes a band of the table only.
    """
    within = [F.get(F.filter(F.array(F.levenshtein(a, b, most)), lambda x: x >= 0), F.lit(0)) for most in near]
    edits = F.coalesce(*within, F.levenshtein(a, b))
    far = F.coalesce(F.try_divide(edits.cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")), F.lit(0.0))
    return F.when(a == b, F.lit(0.0)).otherwise(far)  # equal texts, the most frequent case of long ones, cost no table


def _first_difference(a: Column, b: Column) -> Column:
    """The first position at which two texts differ (the shorter's length if one begins the other)."""
    n = F.least(F.length(a), F.length(b))
    where = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(where, lambda i: _at(a, i) != _at(b, i)), F.lit(0)), n)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's argument isn't inlined where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_before(text: Column, i: Column) -> Column:
    """How many characters just before position i equal the one at i."""
    same = F.regexp_extract(F.reverse(F.substr(text, F.lit(1), i + 1)), "^((.)\\2*)", 1)
    return F.greatest(F.length(same) - 1, F.lit(0))


def char_edit_tag(corrupted: Column, original: Column) -> Column:
    """The one edit that turns corrupted into original (SWAP, SUB or CASE, DEL, INS at the leftmost place), or null."""
    n, m = F.length(corrupted), F.length(original)
    rest = lambda s, k: F.substr(s, k + 1, F.length(s))
    known = lambda c: F.lit(EDIT_ALPHABET).contains(c) & (F.length(c) == 1)

    def tag(i: Column) -> Column:
        a, b = _at(corrupted, i), _at(original, i)
        near, place = i < MAX_POSITION, i.cast("string")
        swapped = (a == _at(original, i + 1)) & (_at(corrupted, i + 1) == b) & (rest(corrupted, i + 2) == rest(original, i + 2))
        one = rest(corrupted, i + 1) == rest(original, i + 1)
        longer = let(i - _run_before(corrupted, i), lambda p: F.when(p < MAX_POSITION, F.concat(F.lit(DEL), p.cast("string"))))
        shorter = let(i - _run_before(original, i), lambda p: F.when((p < MAX_POSITION) & known(b), F.concat(F.lit(INS), p.cast("string"), F.lit("_"), b)))
        return (
            F.when((n == m) & near & swapped, F.concat(F.lit(SWAP), place))
            .when((n == m) & near & one & (F.lower(a) == F.lower(b)), F.concat(F.lit(CASE), place))
            .when((n == m) & near & one & known(b), F.concat(F.lit(SUB), place, F.lit("_"), b))
            .when((n == m + 1) & (rest(corrupted, i + 1) == rest(original, i)), longer)
            .when((n + 1 == m) & (rest(corrupted, i) == rest(original, i + 1)), shorter)
        )

    return F.when((corrupted != original) & (F.abs(n - m) <= 1), let(_first_difference(corrupted, original), tag))


def apply_char_edit(token: Column, tag: Column) -> Column:
    """The token after an edit tag; null if the tag is malformed or out of range."""
    n = F.length(token)
    op = F.regexp_extract(tag, r"^(\$[A-Z]+_)", 1)
    pos = F.regexp_extract(tag, r"^\$[A-Z]+_([0-9]{1,6})(?:_|$)", 1).try_cast("int")
    char = F.regexp_extract(tag, r"^\$(?:INS|SUB)_[0-9]+_(.)$", 1)
    bare = tag.rlike(r"^\$(SWAP|DEL|CASE)_[0-9]{1,6}$")
    full = tag.rlike(r"(?s)^\$(INS|SUB)_[0-9]{1,6}_.$")
    cut = lambda skip, put: F.concat(F.substr(token, F.lit(1), pos), put, F.substr(token, pos + 1 + skip, n))
    c = _at(token, pos)
    flip = F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))
    return (
        F.when(bare & (op == SWAP) & (pos + 1 < n), cut(2, F.concat(_at(token, pos + 1), c)))
        .when(bare & (op == DEL) & (pos < n), cut(1, F.lit("")))
        .when(bare & (op == CASE) & (pos < n), cut(1, flip))
        .when(full & (op == INS) & (pos <= n), cut(0, char))
        .when(full & (op == SUB) & (pos < n), cut(1, char))
    )


def replace_tag(token: Column) -> Column:
    return F.concat(F.lit(REPLACE), token)


def is_replace_tag(tag: Column) -> Column:
    return tag.startswith(REPLACE)


def replacement(tag: Column) -> Column:
    return F.substr(tag, F.lit(len(REPLACE) + 1), F.length(tag))


def is_char_edit(tag: Column) -> Column:
    return tag.startswith(SWAP) | tag.startswith(DEL) | tag.startswith(INS) | tag.startswith(SUB) | tag.startswith(CASE)


def name_tag(corrupted: Column, original: Column) -> Column:
    """The edit tag of a pair, or its whole-word replacement."""
    return F.coalesce(char_edit_tag(corrupted, original), replace_tag(original))


def apply_tags(tokens: Column, tags: Column) -> Column:
    """Tokens after their tags, joined by spaces: $DELETE drops, replacements substitute, all else keeps.

    Arrays of different lengths are an error.
    """
    new = F.zip_with(tokens, tags, lambda t, g: F.when(g == DELETE, F.lit(None).cast("string")).when(is_replace_tag(g), replacement(g)).otherwise(t))
    joined = F.array_join(F.filter(new, lambda x: x.isNotNull()), " ")
    return F.when(F.size(tokens) == F.size(tags), joined).otherwise(F.raise_error(F.lit("tokens and tags differ in length")).cast("string"))


def gated_tag(tag: Column, p_detect: Column, threshold: float) -> Column:
    """Whole-word replacements below the detection threshold become keep; character edits are not gated."""
    return F.when(is_replace_tag(tag) & (p_detect < threshold), F.lit("$KEEP")).otherwise(tag)
