"""The expression language: tokens, a precedence-climbing parser, and a printer.

parse(print_expr(tree)) gives the tree again.  What the language rejects but
foreign forms contain (``==``, ``/`` paths, ``position(..)``) is read into the
tree too, so that rewrites and diagnostics can work on it; see
:mod:`.analysis`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class ExpressionError(ValueError):
    """The text is no expression."""


@dataclass(frozen=True)
class Literal:
    value: str | float


@dataclass(frozen=True)
class Ref:
    """${name}: another field."""

    name: str


@dataclass(frozen=True)
class Dot:
    """The candidate value, in constraints."""


@dataclass(frozen=True)
class Name:
    """A bare name (a column of a choice row) or a foreign path."""

    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Unary:
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


Expr = Literal | Ref | Dot | Name | Call | Unary | Binary

#: Binding strength, weakest first; operators of one level associate to the left.
LEVELS = (("or",), ("and",), ("=", "!=", "=="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))
STRENGTH = {op: n for n, level in enumerate(LEVELS) for op in level}
_TOKENS = re.compile(
    r"""\s*(?:
      (?P<ref>\$\{\s*[^}]*\})
    | (?P<string>'[^']*'|"[^"]*")
    | (?P<number>\d+(?:\.\d+)?|\.\d+)
    | (?P<path>/[A-Za-z_][\w.:-]*(?:/[\w.:-]+)*|\.\./[\w./-]+|\.\.)
    | (?P<name>[A-Za-z_][\w-]*(?::[A-Za-z_][\w-]*)?)
    | (?P<op>==|!=|<=|>=|[=<>+*(),-])
    | (?P<dot>\.)
    )""",
    re.VERBOSE,
)
_WORDS = {"and", "or", "div", "mod"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if m is None:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Expr:
    queue = tokens(text)
    at = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return queue[at + k] if at + k < len(queue) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        got = peek()
        if value is not None and got[1] != value or got[0] == "end":
            raise ExpressionError(f"expected {value or 'more'}, found {got[1] or 'the end'} in {text!r}")
        at += 1
        return got

    def level(n: int) -> Expr:
        if n == len(LEVELS):
            return prefix()
        left = level(n + 1)
        while peek()[1] in LEVELS[n] and (peek()[0] == "op" or peek()[0] == "name"):
            op = take()[1]
            left = Binary(op, left, level(n + 1))
        return left

    def prefix() -> Expr:
        if peek() == ("op", "-"):
            take()
            return Unary(prefix())
        kind, value = take()
        if kind == "ref":
            return Ref(value[2:-1].strip())
        if kind == "string":
            return Literal(value[1:-1])
        if kind == "number":
            return Literal(float(value))
        if kind == "dot":
            return Dot()
        if kind == "path":
            return Name(value)
        if kind == "name":
            if peek() == ("op", "("):
                take()
                args = []
                while peek()[1] != ")" or peek()[0] != "op":
                    args.append(level(0))
                    if peek() != ("op", ","):
                        break
                    take()
                take(")")
                return Call(value, tuple(args))
            if value in _WORDS:
                raise ExpressionError(f"{value} needs a left side in {text!r}")
            return Name(value)
        if value == "(":
            inner = level(0)
            take(")")
            return inner
        raise ExpressionError(f"unexpected {value!r} in {text!r}")

    if not queue:
        raise ExpressionError("empty expression")
    tree = level(0)
    if at < len(queue):
        raise ExpressionError(f"unexpected {peek()[1]!r} in {text!r}")
    return tree


def number_text(value: float) -> str:
    """3.0 is written 3."""
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def print_expr(e: Expr, strength: int = -1) -> str:
    match e:
        case Literal(value=str() as v):
            if "'" in v and '"' in v:
                raise ExpressionError("a literal cannot hold both kinds of quote")
            return f'"{v}"' if "'" in v else f"'{v}'"
        case Literal(value=v):
            return number_text(v)
        case Ref(name=n):
            return "${" + n + "}"
        case Dot():
            return "."
        case Name(name=n):
            return n
        case Call(name=n, args=args):
            return f"{n}({', '.join(print_expr(a) for a in args)})"
        case Unary(arg=a):
            return "-" + print_expr(a, len(LEVELS))
        case Binary(op=op, left=a, right=b):
            own = STRENGTH[op]
            text = f"{print_expr(a, own)} {op} {print_expr(b, own + 1)}"
            return f"({text})" if own < strength else text
    raise TypeError(e)


def walk(e: Expr):
    """Every node, outside first."""
    yield e
    for c in children(e):
        yield from walk(c)


def children(e: Expr) -> tuple:
    match e:
        case Call(args=args):
            return args
        case Unary(arg=a):
            return (a,)
        case Binary(left=a, right=b):
            return (a, b)
    return ()


def transform(e: Expr, change) -> Expr:
    """The tree with ``change`` applied to every node, inside first."""
    match e:
        case Call(name=n, args=args):
            e = Call(n, tuple(transform(a, change) for a in args))
        case Unary(arg=a):
            e = Unary(transform(a, change))
        case Binary(op=op, left=a, right=b):
            e = Binary(op, transform(a, change), transform(b, change))
    return change(e)


def references(e: Expr) -> list[str]:
    """Names of the fields it refers to, once each, in order."""
    return list(dict.fromkeys(n.name for n in walk(e) if isinstance(n, Ref)))
