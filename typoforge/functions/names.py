"""Names as Column expressions: splitting, case, typo operations, validity, seeded choice.  All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import COMMENT_SKIP, KEYBOARD, KEYWORDS, RESERVED

#: Words of a name: runs of capitals, capitalised and lower-case words.
WORD_PIECE = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+"


def split_identifier(name: Column) -> Column:
    """Words of a name: one "_" for each leading underscore and each empty part, then camel-case pieces; digits
    fall away, and a part without any letter stays whole."""
    lead = F.length(F.regexp_extract(name, "^(_*)", 1))
    rest = F.substr(name, lead + 1, F.length(name))

    def pieces(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(WORD_PIECE), F.lit(0))
        return F.when(part == "", F.array(F.lit("_"))).when(F.size(found) == 0, F.array(part)).otherwise(found)

    parts = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.split(rest, "_"), pieces)))
    return F.concat(F.array_repeat(F.lit("_"), lead), parts)


def restore_case(original: Column, corrected: Column) -> Column:
    """corrected in the case pattern of original: upper, capitalised or lower; any other pattern gives original."""
    letters = original.rlike("[A-Za-z]")
    capital = F.concat(F.upper(F.substring(original, 1, 1)), F.lower(F.substr(original, F.lit(2), F.length(original))))
    return (
        F.when(letters & (original == F.upper(original)), F.upper(corrected))
        .when(letters & (original == capital) & original.rlike("^[A-Z]"), F.concat(F.upper(F.substring(corrected, 1, 1)), F.lower(F.substr(corrected, F.lit(2), F.length(corrected)))))
        .when(letters & (original == F.lower(original)), F.lower(corrected))
        .otherwise(original)
    )


def is_reserved(name: Column) -> Column:
    """Keywords, soft keywords, built-ins, self, cls, and anything of the form __x__."""
    return name.isin(*RESERVED) | (name.startswith("__") & name.endswith("__"))


def is_identifier(name: Column) -> Column:
    """ASCII identifiers that aren't keywords (Unicode names: plans.scopes.is_identifier)."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~name.isin(*KEYWORDS)


def is_comment_word(word: Column) -> Column:
    """Whether a comment word may be changed: three letters or more, letters only, not on the list."""
    return (F.length(word) >= 3) & word.rlike("^[A-Za-z]+$") & ~F.lower(word).isin(*COMMENT_SKIP)


def _at(name: Column, i: Column, n: int | Column = 1) -> Column:
    """n characters from position i (from 0)."""
    return F.substr(name, i + 1, F.lit(n) if isinstance(n, int) else n)


def _cut(name: Column, i: Column, skip: int, put: Column) -> Column:
    return F.concat(_at(name, F.lit(0), i), put, F.substr(name, i + 1 + skip, F.length(name)))


def _flip(c: Column) -> Column:
    return F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))


def _neighbours(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in KEYBOARD.items() for x in kv))
    low = F.coalesce(F.try_element_at(table, F.lower(c)), F.lit(""))
    letters = F.filter(F.split(low, ""), lambda x: x != "")
    return F.when(c.rlike("[A-Z]"), F.transform(letters, F.upper)).otherwise(letters)


def typo_candidates(name: Column) -> Column:
    """array<struct<op,pos,typo>>: every result of the five operations on a name.

    swap of neighbours that differ and delete need four characters, duplicate and keyboard slip three; none
    touches the first character or an underscore.  A case flip takes any later letter.
    """
    n = F.length(name)
    where = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    entry = lambda op, i, t: F.struct(F.lit(op).alias("op"), i.alias("pos"), t.alias("typo"))
    plain = lambda i: _at(name, i) != "_"
    swap = F.transform(
        F.filter(where, lambda i: (n >= 4) & (i < n - 1) & plain(i) & (_at(name, i + 1) != "_") & (_at(name, i) != _at(name, i + 1))),
        lambda i: entry("swap", i, _cut(name, i, 2, F.concat(_at(name, i + 1), _at(name, i)))),
    )
    double = F.transform(F.filter(where, lambda i: (n >= 3) & plain(i)), lambda i: entry("duplicate", i, _cut(name, i, 0, _at(name, i))))
    slip = F.flatten(F.transform(F.filter(where, lambda i: (n >= 3) & plain(i)), lambda i: F.transform(_neighbours(_at(name, i)), lambda c: entry("keyboard", i, _cut(name, i, 1, c)))))
    case = F.transform(F.filter(where, lambda i: _at(name, i).rlike("[A-Za-z]")), lambda i: entry("case", i, _cut(name, i, 1, _flip(_at(name, i)))))
    drop = F.transform(F.filter(where, lambda i: (n >= 4) & plain(i)), lambda i: entry("delete", i, _cut(name, i, 1, F.lit(""))))
    return F.concat(swap, double, slip, case, drop)


def typo_rows(rows: DataFrame, name: str = "name", *, once: bool = False) -> DataFrame:
    """rows with op, pos, typo: typo_candidates() as rows, for whole tables (no arrays of arrays, all in codegen).

    With `once`, a row's typo comes once: of equal letters in a row only the first is doubled or deleted.  No other two
    places or operations give the same.
    """
    n = F.length(name)
    places = rows.filter(n > 1).withColumn("pos", F.explode(F.sequence(F.lit(1), n - 1)))
    word, i = F.col(name), F.col("pos")
    here, after, plain = _at(word, i), _at(word, i + 1), _at(word, i) != "_"
    first = (i == 1) | (here != _at(word, i - 1)) if once else F.lit(True)
    entry = lambda op, fits, typo: F.when(fits, F.struct(F.lit(op).alias("op"), typo.alias("typo")))
    made = F.array(
        entry("swap", (n >= 4) & (i < n - 1) & plain & (after != "_") & (here != after), _cut(word, i, 2, F.concat(after, here))),
        entry("duplicate", (n >= 3) & plain & first, _cut(word, i, 0, here)),
        entry("case", here.rlike("[A-Za-z]"), _cut(word, i, 1, _flip(here))),
        entry("delete", (n >= 4) & plain & first, _cut(word, i, 1, F.lit(""))),
    )
    plain_ops = places.select("*", F.explode(made).alias("c")).filter("c is not null").select(*rows.columns, "pos", "c.op", "c.typo")
    slips = places.filter((n >= 3) & plain).select("*", F.explode(_neighbours(here)).alias("k"))
    return plain_ops.unionByName(slips.select(*rows.columns, "pos", F.lit("keyboard").alias("op"), _cut(word, i, 1, F.col("k")).alias("typo")))


def seeded(*parts: Column | str | int) -> Column:
    """A number in 0 .. 2^32 - 1 that depends on the parts only, never on partitions or order."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pick(choices: Column, *parts: Column | str | int) -> Column:
    """One of an array, by seeded(); null of an empty one."""
    return F.when(F.size(choices) > 0, F.get(choices, (seeded(*parts) % F.size(choices)).cast("int")))


def make_typos(names: DataFrame, seed: int, *, name: str = "name", by: tuple[str, ...] | None = None, into: str = "typo") -> DataFrame:
    """names with a typo of each, or null: a seeded choice of operation, then of place, among valid, new, unreserved results.

    Candidates are rows, so none is worked out more than once.
    With `by`, a typo is none of the names in the same group of these columns (an empty tuple: in the whole table).
    Rows that repeat a name (of a group) get the same typo; a null group has none.
    """
    keys = [*(by or ()), name]
    rows = typo_rows(names.select(*keys).distinct(), name)
    good = rows.filter((F.col("typo") != F.col(name)) & is_identifier(F.col("typo")) & ~is_reserved(F.col("typo")))
    if by is not None:
        good = good.join(names.select(*by, F.col(name).alias("typo")).distinct(), [*by, "typo"], "left_anti")
    places = good.groupBy(*keys, "op").agg(F.array_sort(F.collect_list(F.struct("pos", "typo"))).alias("places"))
    ops = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("op", "places"))).alias("ops"))
    picked = ops.select(*keys, pick(F.col("ops"), seed, F.col(name), "op")["places"].alias("places"))
    typos = picked.select(*keys, pick(F.col("places"), seed, F.col(name), "place")["typo"].alias(into))
    return names.join(typos, keys, "left").select(*names.columns, into)


def choose_names(names: DataFrame, *, seed: int, max_edits: int = 2, p_edit: float = 0.8, by: str = "sample_index", name: str = "name") -> DataFrame:
    """Up to max_edits names of each sample: each kept with probability p_edit, in seeded order."""
    from pyspark.sql import Window

    kept = names.filter(seeded(seed, F.col(by), F.col(name), "keep") < F.lit(int(p_edit * 2**32)))
    order = Window.partitionBy(by).orderBy(seeded(seed, F.col(by), F.col(name), "order"), name)
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_edits)


def model_slug(key: Column, preset: Column) -> Column:
    """The file-name key of a model."""
    return F.when(key == "llm_api", F.concat(F.lit("llm_"), F.coalesce(preset, F.lit("unknown")))).otherwise(key)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
