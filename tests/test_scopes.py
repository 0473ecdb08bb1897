"""The scope resolver and the injector, without Spark."""

import ast
import random

import pytest

from typoforge.plans import inject, scopes
from typoforge.plans.fixers import first_json_object, reassembled
from typoforge.sources.readers import DEMO

SNIPPETS = [
    *DEMO,
    "", "# only a comment\n", '"""text"""\n', "pass\n",
    "@wrap\ndef f(x):\n    return x\n", "def g():\n    yield 1\n", "try:\n    a = 1\nexcept ValueError as err:\n    print(err)\n",
    "count = 0\ndef bump():\n    global count\n    count += 1\n", "def o():\n    n = 0\n    def i():\n        nonlocal n\n        n += 1\n    return i\n",
    "def f(*args, **kw):\n    return args, kw\n", "name = 'x'\nprint(f'{name!r:>{len(name)}} {name}')\n", "é = ü = 1\nprint(é + ü)\n",
    "match [1]:\n    case [first, *rest]:\n        print(first, rest)\n    case {'a': one, **more}:\n        print(one, more)\n", "v = [y := 1, y ** 2]\nq = lambda z=v: [z for z in z]\n",
]


@pytest.mark.parametrize("source", SNIPPETS)
def test_renames_parse_and_invert(source):
    names = scopes.renameable(source)
    there = scopes.rename(source, {n: f"{n}_q" for n in names})
    ast.parse(there)
    assert scopes.rename(there, {f"{n}_q": n for n in names}) == source
    assert ast.dump(ast.parse(there)).replace("_q'", "'") == ast.dump(ast.parse(source))


def test_bindings():
    s = "import os as o\ndef outer(a):\n    r = a\n    def inner(r):\n        return r\n    return inner(r), o\nclass K:\n    size = 1\n    def m(self):\n        return self.size\n"
    assert scopes.renameable(s) == {"outer": [(2, 4)], "a": [(2, 10)], "r": [(3, 4), (4, 14)], "inner": [(4, 8)], "K": [(7, 6)], "size": [(8, 4)], "m": [(9, 8)]}
    assert scopes.rename_at(s, 4, 14, "zq").count("zq") == 2 and scopes.rename_at(s, 1, 0, "z") == s
    assert "self.size" in scopes.rename(s, {"size": "siez"}) and scopes.rename(s, {"a": "1x"}) == s
    with pytest.raises(scopes.UnparseableCodeError):
        scopes.analyse("def (:\n")


def test_tokens():
    assert [t.text for t in scopes.code_tokens("x = 1 # hi\n")] == ["x", "=", "1", "# hi"]
    assert [(t.text, t.row, t.col) for t in scopes.code_tokens("f(a b")] == [("f(a", 1, 0), ("b", 1, 10)]
    assert scopes.substituted("a = b\n", [(1, 4, "b", "c"), (1, 0, "z", "q"), (9, 0, "a", "b")]) == "a = c\n"


@pytest.mark.parametrize("seed", range(25))
def test_injection(seed):
    for i, source in enumerate(SNIPPETS):
        plan = inject.Plan(seed=seed, comments=False)
        r = inject.inject(source, plan, "train", i, 1)
        assert r == inject.inject(source, plan, "train", i, 1)
        ast.parse(r["code"])
        back = scopes.rename(r["code"], {e["corrupted_name"]: e["original_name"] for e in r["edits"]})
        assert back == source and r["has_errors"] == (r["code"] != source)
        assert all(e["num_occurrences"] >= 1 and e["corrupted_name"].count("_") >= 0 for e in r["edits"])


def test_comments_and_operations():
    text, new = inject.corrupt_comments("s = '# no'  # average value of numbers TODO\n", inject.Draw(1), 1.0)
    assert new and text.startswith("s = '# no'  # ") and "TODO" in text
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("ab_C") for _ in range(rng.randint(1, 8)))
        for op, made in inject.typos(w).items():
            assert all(t[0] == w[0] and t.count("_") == w.count("_") for t in made), (op, w, made)


def test_json_and_reassembly():
    assert first_json_object('Sure: ```{"a": "b"}```') == {"a": "b"} and first_json_object("{}") == {}
    assert all(first_json_object(t) is None for t in ('{"a": 1}', "[1]", "none", '{"a": "b"', '{"a": {"b": "c"}}'))
    cases = [("my_variable", ["my", "var"], "my_var"), ("myVariable", ["my", "Var"], "myVar"), ("HTTP_ERROR", ["http", "error"], "HTTP_ERROR"), ("a_b", ["x"], "a_b"), ("__private", ["_", "_", "secret"], "__secret"), ("a__b", ["a", "_", "bb"], "a__bb"), ("fiel2", ["file"], "file2")]
    assert [reassembled(o, w) for o, w, _ in cases] == [e for _, _, e in cases]
