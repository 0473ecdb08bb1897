"""Names, scopes and tokens of Python source: a scope resolver over the standard syntax tree, without Spark.

analyse(source) gives every binding and every reference with the scope it resolves to.  Positions are
(line from 1, column from 0) in characters; the tree's own columns are UTF-8 bytes and are converted.
"""

from __future__ import annotations

import ast
import contextlib
import functools
import io
import keyword
import re
import tokenize
import warnings
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

from ..fixed import RESERVED

_RESERVED = frozenset(RESERVED)
#: Kinds of bindings whose names can be renamed.
RENAMEABLE = ("function", "class", "variable", "parameter")
_NO_TEXT = {tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.ERRORTOKEN}


class UnparseableCodeError(ValueError):
    """The source is not Python, or nested too deeply."""


def is_reserved(name: str) -> bool:
    """Keywords, built-in names, self, cls and anything of the form __x__ are never changed."""
    return name in _RESERVED or (name.startswith("__") and name.endswith("__"))


def is_identifier(name: str) -> bool:
    """Whether a name can be bound: an identifier that isn't a keyword."""
    return name.isidentifier() and not keyword.iskeyword(name)


@dataclass
class Scope:
    kind: str  # module, class, function, comprehension
    up: Scope | None
    number: int
    bound: set[str] = field(default_factory=set)
    outer: set[str] = field(default_factory=set)  # declared global
    free: set[str] = field(default_factory=set)  # declared nonlocal


class Place(NamedTuple):
    """One occurrence of a name: a definition (kind says of what) or a reference (kind is "reference")."""

    name: str
    scope: int
    kind: str
    line: int
    col: int


#: What stands before the name of a function or a class, where the tree says that it begins.
_HEAD = re.compile(r"(?:async[ \t]+def|def|class)[ \t]+(\w+)", re.ASCII)


class _Words:
    """Where the name tokens of a source are, for the names that the tree gives no position."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.lines = source.split("\n")
        self.ascii = source.isascii()

    @functools.cached_property
    def names(self) -> list[tuple[int, int, str]]:
        """Read when they are first asked for: most sources do without."""
        out: list[tuple[int, int, str]] = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.source).readline):
                if t.type == tokenize.NAME:
                    out.append((*t.start, t.string))
        except (tokenize.TokenError, SyntaxError):
            pass
        return out

    def column(self, line: int, byte: int) -> int:
        if self.ascii:
            return byte
        text = self.lines[line - 1] if line <= len(self.lines) else ""
        return byte if text.isascii() else len(text.encode()[:byte].decode(errors="ignore"))

    def headed(self, name: str, line: int, col: int) -> tuple[int, int]:
        """Where the name of a function or class stands that begins at a position."""
        m = _HEAD.match(self.lines[line - 1], col) if self.ascii and line <= len(self.lines) else None
        return (line, m.start(1)) if m and m[1] == name else self.after(name, line, col)

    def after(self, name: str, line: int, col: int) -> tuple[int, int]:
        """The first token of this name at or after a position; (0, 0) if there is none."""
        return next(((r, c) for r, c, s in self.names if s == name and (r, c) >= (line, col)), (0, 0))

    def last_before(self, name: str, line: int, col: int) -> tuple[int, int]:
        return next(((r, c) for r, c, s in reversed(self.names) if s == name and (r, c) < (line, col)), (0, 0))


class _Walker:
    """One pass that opens scopes and notes occurrences; names are resolved when all bindings are known."""

    def __init__(self, source: str) -> None:
        self.words = _Words(source)
        self.scopes: list[Scope] = []
        self.found: list[tuple[Scope, str, str, int, int]] = []
        self.now = self.open("module", None)

    def open(self, kind: str, up: Scope | None) -> Scope:
        s = Scope(kind, up, len(self.scopes))
        self.scopes.append(s)
        return s

    def start(self, node: ast.AST) -> tuple[int, int]:
        return node.lineno, self.words.column(node.lineno, node.col_offset)

    def end(self, node: ast.AST) -> tuple[int, int]:
        return node.end_lineno, self.words.column(node.end_lineno, node.end_col_offset)

    def note(self, scope: Scope, name: str, kind: str, at: tuple[int, int]) -> None:
        if kind != "reference":
            scope.bound.add(name)
        self.found.append((scope, name, kind, *at))

    def inside(self, scope: Scope, nodes: Iterable[ast.AST | None]) -> None:
        held, self.now = self.now, scope
        for n in nodes:
            if n is not None:
                self.visit(n)
        self.now = held

    def visit(self, node: ast.AST) -> None:
        special = _special(type(node))
        if special:
            special(self, node)
            return
        for field_name in node._fields:
            value = getattr(node, field_name, None)
            if isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.AST):
                        self.visit(x)
            elif isinstance(value, ast.AST) and not isinstance(value, _PLAIN):
                self.visit(value)

    def on_Name(self, node: ast.Name) -> None:
        self.note(self.now, node.id, "reference" if isinstance(node.ctx, ast.Load) else "variable", self.start(node))

    def on_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.visit(node.value)
        home = self.now
        while home.kind == "comprehension":
            home = home.up
        self.note(home, node.target.id, "variable", self.start(node.target))

    def _function(self, node, name: str | None) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        for n in (*getattr(node, "decorator_list", ()), *a.defaults, *(d for d in a.kw_defaults if d)):
            self.visit(n)
        if name is not None:
            self.note(self.now, name, "function", self.words.headed(name, *self.start(node)))
        own = self.open("function", self.now)
        held = own if getattr(node, "type_params", None) else self.now
        self.inside(own, getattr(node, "type_params", ()))
        self.inside(held, [x.annotation for x in every] + [getattr(node, "returns", None)])
        for x in every:
            self.note(own, x.arg, "parameter", self.start(x))
        self.inside(own, node.body if isinstance(node.body, list) else [node.body])

    def on_FunctionDef(self, node) -> None:
        self._function(node, node.name)

    on_AsyncFunctionDef = on_FunctionDef

    def on_Lambda(self, node: ast.Lambda) -> None:
        self._function(node, None)

    def on_ClassDef(self, node: ast.ClassDef) -> None:
        for n in node.decorator_list:
            self.visit(n)
        self.note(self.now, node.name, "class", self.words.headed(node.name, *self.start(node)))
        own = self.open("class", self.now)
        self.inside(own, node.type_params)
        self.inside(own if node.type_params else self.now, [*node.bases, *node.keywords])
        self.inside(own, node.body)

    def _comprehension(self, node) -> None:
        own = self.open("comprehension", self.now)
        for i, g in enumerate(node.generators):
            self.inside(self.now if i == 0 else own, [g.iter])
            self.inside(own, [g.target, *g.ifs])
        self.inside(own, [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])

    on_ListComp = on_SetComp = on_GeneratorExp = on_DictComp = _comprehension

    def on_Import(self, node: ast.Import | ast.ImportFrom) -> None:
        for x in node.names:
            if x.name != "*":
                self.note(self.now, x.asname or x.name.split(".")[0], "import", self.start(x))

    on_ImportFrom = on_Import

    def _declared(self, node, names: set[str]) -> None:
        at = self.start(node)
        for name in node.names:
            names.add(name)
            at = self.words.after(name, *at)
            self.found.append((self.now, name, "reference", *at))

    def on_Global(self, node: ast.Global) -> None:
        self._declared(node, self.now.outer)

    def on_Nonlocal(self, node: ast.Nonlocal) -> None:
        self._declared(node, self.now.free)

    def on_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.type:
            self.visit(node.type)
        if node.name:
            self.note(self.now, node.name, "variable", self.words.after(node.name, *self.end(node.type)))
        for n in node.body:
            self.visit(n)

    def on_MatchAs(self, node: ast.MatchAs) -> None:
        if node.pattern:
            self.visit(node.pattern)
        if node.name:
            line, col = self.end(node)
            self.note(self.now, node.name, "variable", (line, col - len(node.name)))

    def on_MatchStar(self, node: ast.MatchStar) -> None:
        if node.name:
            line, col = self.end(node)
            self.note(self.now, node.name, "variable", (line, col - len(node.name)))

    def on_MatchMapping(self, node: ast.MatchMapping) -> None:
        for n in (*node.keys, *node.patterns):
            self.visit(n)
        if node.rest:
            self.note(self.now, node.rest, "variable", self.words.last_before(node.rest, *self.end(node)))

    def _type_parameter(self, node) -> None:
        self.note(self.now, node.name, "variable", self.words.after(node.name, *self.start(node)))
        for child in ast.iter_child_nodes(node):
            self.visit(child)

    on_TypeVar = on_TypeVarTuple = on_ParamSpec = _type_parameter

    def home(self, scope: Scope, name: str) -> Scope | None:
        """The scope whose binding a name in `scope` means."""
        if name in scope.outer:
            return self.scopes[0]
        if name in scope.bound and name not in scope.free:
            return scope
        s = scope.up
        while s is not None:
            if s.kind != "class" and name in s.bound and name not in s.free and name not in s.outer:
                return s
            if s.kind != "class" and name in s.outer:
                return self.scopes[0]
            s = s.up
        return None


#: Nodes without names in them.
_PLAIN = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Constant)


@functools.cache
def _special(kind: type):
    return getattr(_Walker, f"on_{kind.__name__}", None)


#: Sources up to this many characters are remembered by shape, and how many shapes are held.
SHAPE_CHARS, SHAPES = 4_000, 256
#: Words that mean something to the parser or to this module; they stay in a shape.
_FIXED = _RESERVED | {"barry_as_FLUFL"}
_PIECE = re.compile(r"(\w+)", re.ASCII)


class _Shape(NamedTuple):
    """What all sources have in common that differ in names only, each name in all its places.

    Positions are pieces of the source (gaps at even, words at odd numbers) and the line they are on, with the piece and
    the character of it where that line begins.
    """

    places: list[tuple[int, int, str, int, int, int, int]]  # name's piece, scope, kind, piece, line, line's piece, character
    names: dict[int, list[list[int]]]  # of each name that can be renamed, by definition in order: the pieces that a rename takes
    homes: dict[int, list[int]]  # of each name with a binding: the pieces that a rename in every scope takes
    words: list[int]  # pieces that are name tokens
    comments: bool
    steady: bool


_shapes: dict[tuple, _Shape] | None = None


@contextlib.contextmanager
def shapes_remembered() -> Iterator[None]:
    """Within it, sources of one shape are parsed once, while no more than SHAPES others came after it."""
    global _shapes
    held, _shapes = _shapes, {} if _shapes is None else _shapes
    try:
        yield
    finally:
        _shapes = held


def _pieces(source: str) -> list[str] | None:
    """Gaps and words in turn; None of a source that has no shape."""
    plain = len(source) <= SHAPE_CHARS and source.isascii() and "\r" not in source and "\\N" not in source
    return _PIECE.split(source) if plain else None


def _shape_key(pieces: list[str]) -> tuple:
    """The pieces, with the number of its first piece for every word that could be any other name.

    Numbers, prefixes of strings, escapes and conversions (!r) are no names.
    """
    key, first = pieces.copy(), {}
    for i in range(1, len(pieces), 2):
        word, gap = pieces[i], pieces[i - 1]
        if word in _FIXED or word[0] <= "9" or word[:2] == "__" or gap[-1:] in ("\\", "!") or pieces[i + 1][:1] in ("'", '"') or (gap == "." and i > 2 and pieces[i - 2][0] <= "9"):
            continue
        key[i] = first.setdefault(word, i)
    return tuple(key)


def _shaped(source: str, pieces: list[str], places: list[Place]) -> _Shape | None:
    """The shape of a source that was read; None if a place is no word of it."""
    counted = _counted(source)
    if counted is None:
        return None
    names, remarks = counted
    starts = list(accumulate(map(len, pieces), initial=0))
    lines = [0, *(m.end() for m in re.finditer("\n", source))]

    def piece(offset: int) -> tuple[int, int]:
        i = bisect_right(starts, offset, hi=len(pieces)) - 1
        return i, offset - starts[i]

    def word(line: int, col: int, text: str | None) -> tuple[int, int, int, int] | None:
        i, inside = piece(lines[line - 1] + col)
        return (i, line, *piece(lines[line - 1])) if i % 2 and not inside and text in (None, pieces[i]) else None

    first = {w: i for i, w in reversed([*enumerate(pieces)][1::2])}
    at = [word(p.line, p.col, None if p.kind == "import" else p.name) for p in places]
    tokens = [word(*n) for n in names]
    if None in at or None in tokens or any(p.name not in first for p in places):
        return None
    taken, names, homes = {}, {}, {}
    for p, a in zip(places, at, strict=True):
        if p.kind != "import":
            taken.setdefault((p.name, p.scope), []).append(a[0])
    for p in sorted(places, key=lambda p: (p.line, p.col)):
        if p.kind in RENAMEABLE and not is_reserved(p.name):
            names.setdefault(first[p.name], []).append(taken[p.name, p.scope])
    for name, scope in {(p.name, p.scope) for p in places if p.kind != "reference"}:
        homes.setdefault(first[name], []).extend(taken.get((name, scope), ()))
    return _Shape([(first[p.name], p.scope, p.kind, *a) for p, a in zip(places, at, strict=True)], names, homes, [t[0] for t in tokens], bool(remarks), bool(tokens))


def _counted(source: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]] | None:
    """(name tokens, comments) of a source, each with line and column; None if it has no tokens."""
    names, remarks = [], []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.NAME:
                names.append((*t.start, t.string))
            elif t.type == tokenize.COMMENT:
                remarks.append((*t.start, t.string))
    except (tokenize.TokenError, SyntaxError):
        return None
    return names, remarks


def _known_shape(source: str) -> tuple[list[str] | None, _Shape | None]:
    """(pieces, shape) of a source, if shapes are remembered; without a shape, no error need have been met."""
    pieces = None if _shapes is None else _pieces(source)
    if pieces is None:
        return None, None
    key = _shape_key(pieces)
    shape = _shapes.get(key)
    if shape is None:
        shape = _shaped(source, pieces, _parsed(source))
        if shape is not None:
            if len(_shapes) >= SHAPES:
                del _shapes[next(iter(_shapes))]
            _shapes[key] = shape
    return pieces, shape


def _placed(pieces: list[str], shape: _Shape) -> list[Place]:
    starts = list(accumulate(map(len, pieces), initial=0))
    return [Place(pieces[n], scope, kind, line, starts[i] - starts[j] - k) for n, scope, kind, i, line, j, k in shape.places]


def analyse(source: str) -> list[Place]:
    """Every definition and resolved reference of a source, in order of position."""
    pieces, shape = _known_shape(source)
    return _parsed(source) if shape is None else _placed(pieces, shape)


def renameable_names(source: str) -> list[str]:
    """The names of renameable(), sorted."""
    pieces, shape = _known_shape(source)
    return sorted(renameable(source) if shape is None else (pieces[i] for i in shape.names))


def _parsed(source: str) -> list[Place]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        w = _Walker(source)
        w.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise UnparseableCodeError(str(e)) from None
    out = []
    for scope, name, kind, line, col in w.found:
        home = w.home(scope, name)
        if home is not None and (line, col) != (0, 0):
            out.append(Place(name, home.number, kind, line, col))
    return sorted(out, key=lambda p: (p.line, p.col, p.kind == "reference"))


def definitions(source: str) -> list[Place]:
    """The bindings that can be renamed: of functions, classes, variables and parameters, not reserved, not imported."""
    return [p for p in analyse(source) if p.kind in RENAMEABLE and not is_reserved(p.name)]


def renameable(source: str) -> dict[str, list[tuple[int, int]]]:
    """Name to the positions of its definitions."""
    return _by_name(definitions(source))


def _by_name(places: Iterable[Place]) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for p in places:
        out.setdefault(p.name, []).append((p.line, p.col))
    return out


class Known:
    """A source read once, for several sets of renames: its places, its name tokens and its comments."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.pieces, self.shape = _known_shape(source)
        if self.shape is None:
            self.places = _parsed(source)

    @functools.cached_property
    def places(self) -> list[Place]:
        return _placed(self.pieces, self.shape)

    @functools.cached_property
    def names(self) -> dict[str, list[tuple[int, int]]]:
        return _by_name(p for p in self.places if p.kind in RENAMEABLE and not is_reserved(p.name))

    @functools.cached_property
    def bindings(self) -> dict[str, list[list[int]]] | None:
        """Of each name, by definition in order: the pieces that a rename takes; None without a shape."""
        return {self.pieces[i]: x for i, x in self.shape.names.items()} if self.shape else None

    @functools.cached_property
    def _tokens(self) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        return _counted(self.source) or ([], [])

    @functools.cached_property
    def counts(self) -> Counter[str]:
        return Counter([self.pieces[i] for i in self.shape.words] if self.shape else [n for _, _, n in self._tokens[0]])

    @functools.cached_property
    def comments(self) -> list[tuple[int, int, str]]:
        return [] if self.shape and not self.shape.comments else self._tokens[1]

    @functools.cached_property
    def steady(self) -> bool:
        """Where every place shows its name, renaming to a name that occurs nowhere moves places and changes nothing else."""
        if self.shape:
            return self.shape.steady
        lines = self.source.split("\n")
        return self.source.isascii() and "\r" not in self.source and bool(self.counts) and all(p.kind == "import" or lines[p.line - 1].startswith(p.name, p.col) for p in self.places)

    def renamed(self, at: tuple[int, int], new: str) -> list[tuple[int, int, str, str]] | None:
        """Edits (line, column, old, new) that rename the binding defined at a position, all in the source as it is.

        None where a fresh look at the renamed source is needed, as its names might then mean something else.
        """
        if not self.steady or not new.isascii() or new in self.counts or not is_identifier(new):
            return None
        it = next(p for p in self.places if (p.line, p.col) == at and p.kind != "reference")
        return [(p.line, p.col, p.name, new) for p in self.places if p.name == it.name and p.scope == it.scope and p.kind != "import"]


def _replaced(source: str, edits: Iterable[tuple[int, int, str, str]]) -> str:
    """source with (line, column, old, new) edits where the old text really stands there."""
    lines = source.split("\n")
    for line, col, old, new in sorted(set(edits), reverse=True):
        text = lines[line - 1]
        if text[col : col + len(old)] == old:
            lines[line - 1] = text[:col] + new + text[col + len(old) :]
    return "\n".join(lines)


def rename(source: str, names: dict[str, str]) -> str:
    """Rename in every scope that binds a mapped name, definitions and references alike, in one pass."""
    names = {k: v for k, v in names.items() if is_identifier(v)}
    if not names:
        return source
    pieces, shape = _known_shape(source)
    if shape is not None:
        out = pieces.copy()
        for i, taken in shape.homes.items():
            if pieces[i] in names:
                for k in taken:
                    out[k] = names[pieces[i]]
        return "".join(out)
    places = analyse(source)
    homes = {(p.name, p.scope) for p in places if p.kind != "reference" and p.name in names}
    return _replaced(source, ((p.line, p.col, p.name, names[p.name]) for p in places if (p.name, p.scope) in homes and p.kind != "import"))


def rename_at(source: str, line: int, col: int, new: str) -> str:
    """Rename the binding that is defined at a position, in its scope only; unchanged if there is none."""
    places = analyse(source)
    it = next((p for p in places if (p.line, p.col) == (line, col) and p.kind != "reference"), None)
    if it is None or not is_identifier(new):
        return source
    return _replaced(source, ((p.line, p.col, p.name, new) for p in places if (p.name, p.scope) == (it.name, it.scope) and p.kind != "import"))


def count_name(source: str, name: str) -> int:
    """Name tokens equal to a name, wherever they stand."""
    return count_names(source, [name])[0]


def count_names(source: str, names: Iterable[str]) -> list[int]:
    """count_name() of several names, by one reading of the source."""
    try:
        found = Counter(t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.NAME)
    except (tokenize.TokenError, SyntaxError):
        found = Counter()
    return [found[name] for name in names]


class Token(NamedTuple):
    text: str
    row: int
    col: int
    kind: str

    @property
    def is_name(self) -> bool:
        return self.kind == "NAME"


def code_tokens(source: str) -> list[Token]:
    """Tokens that have text; of a source that can't be tokenised its words, as names on row 1 at columns 0, 10, 20."""
    try:
        return [
            Token(t.string, t.start[0], t.start[1], tokenize.tok_name[t.type])
            for t in tokenize.generate_tokens(io.StringIO(source).readline)
            if t.type not in _NO_TEXT and t.string
        ]
    except (tokenize.TokenError, SyntaxError):
        return [Token(w, 1, 10 * i, "NAME") for i, w in enumerate(source.split())]


def substituted(source: str, edits: Iterable[tuple[int, int, str, str]]) -> str:
    """Token substitutions (row, column, old, new), from the right; those whose text isn't there are skipped."""
    last = source.count("\n") + 1
    return _replaced(source, (e for e in edits if 1 <= e[0] <= last))


def comments(source: str) -> list[tuple[int, int, str]]:
    """(line, column, text) of every comment."""
    try:
        return [(*t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return []
