"""Sources that differ in names only are parsed once, typos are counted instead of made, lines are compared once: the same results."""

import ast
import difflib
import random

import pytest

from typoforge import queries
from typoforge.fixed import KEYBOARD
from typoforge.plans import inject, scopes
from typoforge.plans.analyze import differing_spans

SHAPES = [
    "def {a}({b}, {c}_x):\n    {a}_w = {b} + {c}_x  # adds {b}\n    return [{a}_w for {c} in {b}]\n",
    "import os as {a}, {b}.path\n{c} = {a}.join(path)\n",
    "class {a}:\n    def {b}(self, k{c}):\n        return f'{{{b}!r:>{{k{c}}}}} {{{c}=}} {a}' '\\x41{c}' rb'a{c}'\n",
    "match {a}:\n    case {{'k': {b}, **{c}}}: print({b}, {c})\n    case [{b}, *{c}] | {a}: pass\n",
    "def {a}[T](x: T):\n    global {b}; {b} = 1.e5 + 0x1F + 1_0\n    try: pass\n    except OSError as {c}: raise {c}\n",
    "größe = {a}\r\n", "def broken(:\n",
]
NAMES = ["alpha", "beta", "_", "a", "b", "r", "e5", "x", "type", "print", "self", "__x__", "__y", "path", "mathc", "prin", "é"]


def read(source):
    try:
        return scopes.analyse(source), scopes.renameable_names(source), scopes.rename(source, {"alpha": "omega", "beta": "if", "x": "é"})
    except scopes.UnparseableCodeError:
        return None


def test_sources_of_one_shape_read_as_alone():
    draw = random.Random(4)
    for _ in range(1500):
        source = draw.choice(SHAPES).format(a=draw.choice(NAMES), b=draw.choice(NAMES), c=draw.choice(NAMES))
        with scopes.shapes_remembered():
            for _ in range(2):  # from another source of its shape at the second time at least
                got, known = read(source.replace("alpha", "gamma")) and read(source), inject.known(source)
        assert got == (read(source.replace("alpha", "gamma")) and read(source))
        if known:
            assert got[1] == sorted(known.names) and known.places == scopes._parsed(source)
            assert (sorted(known.counts.elements()), known.comments) == (sorted(n for _, _, n in known._tokens[0]), known._tokens[1])


def test_a_shape_is_parsed_once(monkeypatch):
    parsed, plain = [], ast.parse
    monkeypatch.setattr(scopes.ast, "parse", lambda *a, **k: parsed.append(1) or plain(*a, **k))
    with scopes.shapes_remembered():
        assert [scopes.renameable_names(f"def f{i}(x{i}):\n    return x{i}\n") for i in range(9)] == [[f"f{i}", f"x{i}"] for i in range(9)]
    assert len(parsed) == 1


@pytest.mark.parametrize("word", ["alpha_12", "whole", "prrint", "Mixed_Case9", "aab__bb_", "abcd", "mathc", "x1", "_ab", "é12"])
def test_counted_typos_are_those_that_are_made(word):
    good = {op: t for op, t in inject._valid_typos(word, True).items() if t}
    tally = inject._tally(word)
    if tally is not None:
        assert tally == sorted((op, len(t)) for op, t in good.items())
        assert {op: [inject._result(word, op, k) for k in range(n)] for op, n in tally} == good
    assert tally is not None or word not in ("alpha_12", "Mixed_Case9", "aab__bb_")
    assert all(c not in near for c, near in KEYBOARD.items())


def test_spans_are_those_of_difflib():
    draw = random.Random(2)
    for _ in range(4000):
        letters = draw.choice(["ab", "abc_ ", "abcdefghij", "éa\U0001f600"])
        p = [draw.choice(letters) for _ in range(draw.randint(0, 20))]
        q = [x for x in p for _ in range(draw.choice([0, 1, 1, 1, 1, 2]))] if draw.random() < 0.7 else [draw.choice(letters) for _ in range(draw.randint(0, 20))]
        a, b = "".join(p), "".join(q)
        assert list(differing_spans(a, b)) == [x[1:] for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]


def test_lines_are_compared_once(spark, data):
    plan = queries.line_diffs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the filter that Spark infers of an explode() compared them twice
