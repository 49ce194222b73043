"""Repeat aggregates over long rows, without building arrays.

sum, count, min, max and join (each also with -if) of a repeat become one
grouped aggregation over its instances, combined before the shuffle, and one
join to the submissions; a repeat of any size takes no more room than its
aggregates (joined texts excepted).  The rest of each expression is then
compiled over the results.

indexed-repeat and rank-index(-if) with a written number n are aggregates too.
The first n instances of a submission are found by a window that keeps n rows a
submission and task before its shuffle; the rank of the n-th is then one more
than the count of instances that come before it, which combines like any count.
index() inside an expression numbers all instances, by ranges of (submission,
order), so one submission may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions.compiler import NUMBER, STRING, Scope, Value, compile_expr
from ..expressions.syntax import Call, Expr, ExpressionError, Literal, Ref, children, parse, references, transform
from ..functions.text import empty_text
from .positions import numbers_within

_OF_FIELD = {"sum", "min", "max", "sum-if", "min-if", "max-if"}
_BY_NUMBER = {"indexed-repeat", "rank-index", "rank-index-if"}
_INDEX = "__index"


def aggregate(parents: DataFrame, instances: DataFrame, key: str, foreign: str, repeat: str, members: dict[str, str], scope: Scope, expressions: dict[str, str | Expr], order: list[str] | None = None) -> DataFrame:
    """key and each expression's value, for every parent; ``members``: member (a column of instances): kind."""
    trees = {n: parse(e) if isinstance(e, str) else e for n, e in expressions.items()}
    wanted: dict[Expr, int] = {}

    def found(e: Expr) -> Expr:
        if isinstance(e, Call) and _is_aggregate(e, repeat, members):
            return Ref(f"__a{wanted.setdefault(e, len(wanted))}")
        return e

    trees = {n: transform(t, found) for n, t in trees.items()}
    inner = {**{m: Value(F.col(m), k) for m, k in members.items()}}
    outer = {r for e in wanted for r in references(e)} - members.keys() - {repeat}
    rows = instances
    if outer:  # predicates that look at the submission: its fields beside each instance
        rows = rows.join(parents.select(F.col(key).alias("__parent"), *[scope.fields[o].col.alias(f"__f_{o}") for o in sorted(outer)]), rows[foreign] == F.col("__parent"))
        inner |= {o: Value(F.col(f"__f_{o}"), scope.fields[o].kind) for o in outer}
    inside = Scope(**{**scope.__dict__, "fields": inner, "repeats": {}, "within": repeat, "index": F.col(_INDEX).cast("double")})
    calls = [x for e in wanted for x in _all(e) if isinstance(x, Call)]
    if any(x.name in _BY_NUMBER or x.name == "index" for x in calls) and not order:
        raise ExpressionError("instances by number need their order")
    if any(x.name == "index" for x in calls):
        rows = numbers_within(rows, [foreign], order, _INDEX)
    by_number = {k: e for e, k in wanted.items() if e.name in _BY_NUMBER}
    joined, rows = _nth(parents, rows, key, foreign, by_number, inside, order) if by_number else (parents, rows)
    made = [(k, *_aggregate(e, inside, order, k)) for e, k in wanted.items() if e.name != "indexed-repeat"]
    if made:
        grouped = rows.groupBy(F.col(foreign).alias("__key")).agg(*[c.alias(f"__a{k}") for k, c, _, _ in made])
        joined = joined.join(grouped, joined[key] == F.col("__key"), "left")
    fetched = {f"__a{k}": Value(F.col(f"__p{k}"), compile_expr(e.args[0], inside).kind) for k, e in by_number.items() if e.name == "indexed-repeat"}
    fields = {**scope.fields, **fetched, **{f"__a{k}": Value(F.col(f"__a{k}") if empty is None else F.coalesce(F.col(f"__a{k}"), empty), kind) for k, _, kind, empty in made}}
    final = Scope(**{**scope.__dict__, "fields": fields})
    return joined.select(parents[key], *[compile_expr(t, final).col.alias(n) for n, t in trees.items()])


def _is_aggregate(e: Call, repeat: str, members: dict[str, str]) -> bool:
    if e.name in _BY_NUMBER:
        field, at = (e.args[0], e.args[2]) if e.name == "indexed-repeat" and len(e.args) == 3 else (e.args[1], e.args[0]) if e.name != "indexed-repeat" and len(e.args) > 1 else (None, None)
        if not (isinstance(field, Ref) and field.name in members):
            return False
        if not (isinstance(at, Literal) and isinstance(at.value, float)):
            raise ExpressionError(f"{e.name}() over long rows needs its number written out")
        return True
    of = e.args[1] if e.name in ("join", "join-if") and len(e.args) > 1 else e.args[0] if e.args else None
    if not isinstance(of, Ref):
        return False
    if e.name in ("count", "count-if"):
        return of.name == repeat
    if of.name not in members or not (e.name in _OF_FIELD and (e.name.endswith("-if") or len(e.args) == 1) or e.name in ("join", "join-if")):
        return False
    return True


def _all(e: Expr):
    yield e
    for c in children(e):
        yield from _all(c)


def _number(e: Call) -> int:
    return int((e.args[2] if e.name == "indexed-repeat" else e.args[0]).value)


def _ranked(e: Call, inside: Scope) -> tuple[Column, Column]:
    """An instance's value in a ranking, and whether it has a rank."""
    value = compile_expr(e.args[1], inside).number()
    ok = value.isNotNull()
    return value, ok & compile_expr(e.args[2], inside).truth() if e.name.endswith("-if") else ok


def _nth(parents: DataFrame, rows: DataFrame, key: str, foreign: str, calls: dict[int, Call], inside: Scope, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """parents, and the instances, with what the n-th instance of each submission holds (__n0, __n1, ...)."""
    most = max(map(_number, calls.values()))
    place = F.row_number().over(Window.partitionBy(foreign).orderBy(*order))
    first = rows.withColumn("__place", place).where(F.col("__place") <= most)
    at = lambda n, c: F.max(F.when(F.col("__place") == n, F.struct(c.alias("v"))))
    kept = []
    for k, e in calls.items():
        if e.name == "indexed-repeat":
            value = compile_expr(e.args[0], inside).col
            kept.append(F.coalesce(at(_number(e), value), at(1, value)))  # an instance that is not there falls back to the first
        else:
            value, ok = _ranked(e, inside)
            kept.append(at(_number(e), F.when(ok, F.struct(value.alias("value"), F.struct(*order).alias("order")))))
    nth = first.groupBy(F.col(foreign).alias("__of")).agg(*[c["v"].alias(f"__n{k}") for k, c in zip(calls, kept)])
    if any(e.name != "indexed-repeat" for e in calls.values()):
        ranks = nth.select("__of", *[f"__n{k}" for k, e in calls.items() if e.name != "indexed-repeat"])
        rows = rows.join(ranks, rows[foreign] == F.col("__of")).drop("__of")
    found = nth.select(F.col("__of").alias("__parent_of"), *[F.col(f"__n{k}").alias(f"__p{k}") for k in calls])
    return parents.join(found, parents[key] == F.col("__parent_of"), "left"), rows


def _aggregate(e: Call, inside: Scope, order: list[str] | None, k: int) -> tuple[Column, str, Column | None]:
    """The aggregate, its kind, and its value over no instances (None: blank)."""
    if e.name.startswith("rank-index"):
        value, ok = _ranked(e, inside)
        nth = F.col(f"__n{k}")
        before = ok & ((value > nth["value"]) | ((value == nth["value"]) & (F.struct(*order) < nth["order"])))
        return F.when(F.max(nth["value"]).isNull(), 999.0).otherwise((F.count_if(before) + 1).cast("double")), NUMBER, F.lit(999.0)
    name, where = e.name.removesuffix("-if"), None
    if e.name.endswith("-if"):
        where = compile_expr(e.args[-1], inside).truth()
    if name == "count":
        return (F.count_if(where) if where is not None else F.count(F.lit(1))).cast("double"), NUMBER, F.lit(0.0)
    value = compile_expr(e.args[1 if name == "join" else 0], inside)
    only = lambda c: c if where is None else F.when(where, c)
    if name == "sum":
        return F.sum(only(value.number())), NUMBER, F.lit(0.0)
    if name in ("min", "max"):
        return getattr(F, name)(only(value.col)), value.kind, None
    if not order:
        raise ExpressionError("join() over long rows needs their order")
    if not isinstance(e.args[0], Literal):
        raise ExpressionError("the delimiter must be written out")
    listed = F.array_sort(F.collect_list(only(F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], empty_text(value.string()).alias("v")))))
    return F.array_join(F.transform(listed, lambda x: x["v"]), str(e.args[0].value)), STRING, F.lit("")
