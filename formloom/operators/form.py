"""Forms: definitions and the evaluation of submissions.

A definition is three small tables (survey, choices, settings) whose row order
counts; it is read on the driver, where it is metadata.  Submissions are a
DataFrame with a column for each field and an array of structs for each repeat.
Evaluation compiles the whole form to a few projections: relevance of groups
and fields, defaults, then calculations by levels of their dependencies (all
fields of a level in one projection, so that plans stay flat).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions.compiler import BOOLEAN, DATE, DATETIME, KINDS, NUMBER, Repeat, Scope, Value, compile_expr
from ..expressions.syntax import Call, ExpressionError, Ref, parse, references
from ..functions import text
from .repeats import counted

_ALIASES = {"constraint_message": "constraint message", "required_message": "required message", "read_only": "read only", "relevant": "relevance"}
_NO_DATA = {"note", "begin group", "end group", "begin repeat", "end repeat"}


def canonical_header(name: str) -> str:
    """Column names of sheets: aliases and double-colon languages in the form the engine uses."""
    name = re.sub(r"\s*::\s*", ":", name.strip())
    return _ALIASES.get(name, name)


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    row: int
    groups: tuple[str, ...]
    repeat: str | None
    cells: dict[str, str]

    @property
    def kind(self) -> str:
        return KINDS.get(self.type, "string")

    @property
    def list_name(self) -> str | None:
        m = re.match(r"select_(?:one|multiple)\s+(\S+)", self.type)
        return m[1] if m else None


@dataclass
class Form:
    survey: list[dict]
    choices: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        clean = lambda rows: [{canonical_header(k): v for k, v in r.items()} for r in rows]
        self.survey, self.choices = clean(self.survey), clean(self.choices)
        for k, r in enumerate(self.survey):
            r.setdefault("excel_row", k + 2)
        self.fields: dict[str, Field] = {}
        self.groups: dict[str, dict] = {}
        self.repeats: dict[str, str | None] = {}
        open_: list[tuple[str, str]] = []
        for r in self.survey:
            kind = (r.get("type") or "").strip().replace("_group", " group").replace("_repeat", " repeat")
            if (r.get("disabled") or "").lower() == "yes":
                continue
            if kind in ("begin group", "begin repeat"):
                open_.append((kind[6:], r["name"]))
                self.groups[r["name"]] = r
                if kind == "begin repeat":
                    self.repeats[r["name"]] = next((n for k, n in reversed(open_[:-1]) if k == "repeat"), None)
            elif kind in ("end group", "end repeat"):
                if not open_ or open_[-1][0] != kind[4:]:
                    raise ValueError(f"row {r['excel_row']}: {kind} closes nothing")
                open_.pop()
            elif kind:
                inner = next((n for k, n in reversed(open_) if k == "repeat"), None)
                self.fields[r["name"]] = Field(r["name"], kind, r["excel_row"], tuple(n for _, n in open_), inner, r)
        if open_:
            raise ValueError(f"{open_[-1][1]} is not closed")

    @classmethod
    def of(cls, survey: DataFrame, choices: DataFrame | None = None, settings: DataFrame | None = None) -> Form:
        """From sheets as DataFrames (a form has hundreds of rows, so this is metadata)."""
        rows = lambda df: [r.asDict() for r in df.orderBy("excel_row").collect()] if df is not None else []
        return cls(rows(survey), rows(choices), (rows(settings) or [{}])[0])

    def choice_values(self, list_name: str, language: str | None = None) -> dict[str, str]:
        label = f"label:{language}" if language else "label"
        return {c.get("value", c.get("name")): c.get(label) or "" for c in self.choices if c["list_name"] == list_name}

    def kinds(self) -> dict[str, str]:
        return {f.name: f.kind for f in self.fields.values() if f.type not in _NO_DATA}

    def relevance(self, f: Field) -> list[str]:
        """Expressions that must all hold: the enclosing groups' and the field's own."""
        own = [self.groups[g].get("relevance") for g in f.groups] + [f.cells.get("relevance")]
        return [x for x in own if x]

    def scope(self, **more) -> Scope:
        fields = {f.name: Value(F.col(f.name), f.kind) for f in self.fields.values() if f.type not in _NO_DATA and not f.repeat}
        repeats = {}
        for r, parent in self.repeats.items():
            members = {f.name: f.kind for f in self.fields.values() if f.repeat == r and f.type not in _NO_DATA}
            repeats[r] = Repeat(r, F.col(r), members, parent)
        labels = {f.name: self.choice_values(f.list_name) for f in self.fields.values() if f.list_name}
        return Scope(fields=fields, repeats=repeats, labels=labels, **more)


def levels(wanted: dict[str, set[str]]) -> list[list[str]]:
    """Names in layers, each depending on earlier layers only; a cycle is an error."""
    left, done, out = dict(wanted), set(), []
    while left:
        now = sorted(n for n, d in left.items() if not (d & left.keys()) - {n})
        if not now:
            raise ExpressionError(f"these fields depend on each other: {', '.join(sorted(left))}")
        out.append(now)
        done |= set(now)
        for n in now:
            del left[n]
    return out


_SQL = {NUMBER: "double", BOOLEAN: "boolean", DATE: "date", DATETIME: "timestamp"}


def _all_hold(conditions: list[str], scope: Scope) -> Column:
    shown = compile_expr(conditions[0], scope).truth()
    for c in conditions[1:]:
        shown = shown & compile_expr(c, scope).truth()
    return shown


def _answer(f: Field, value: Column, kind: str, scope: Scope) -> Value:
    """A field's value with its default and calculation, before relevance."""
    if f.cells.get("default"):
        value = F.coalesce(value, F.lit(f.cells["default"]).cast(_SQL.get(kind, "string")))
    if not f.cells.get("calculation"):
        return Value(value, kind)
    made = compile_expr(f.cells["calculation"], replace(scope, stored=value.cast("string"), of=f.name))
    if f.type in ("calculate", "calculate_here"):
        return Value(made.date(), DATE) if parse(f.cells["calculation"]) == Call("now") else made  # now() stored alone is a date
    typed = {NUMBER: made.number, DATE: made.date, DATETIME: made.datetime}.get(kind, made.string)()
    return Value(F.coalesce(value, typed), kind)


def evaluate(form: Form, submissions: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Submissions as the form leaves them: hidden fields empty, defaults filled, calculations done.

    A field's relevance is in the column __rel_<field>, where it can be false.
    A repeat is evaluated as one value: its number of instances, then its
    members and inner repeats in each instance, level by level, to any depth.
    ``scope`` learns the kinds of calculated fields on the way.
    """
    scope = scope or form.scope()
    plain = {f.name: f for f in form.fields.values() if not f.repeat and f.type not in _NO_DATA}
    tops = [r for r, parent in form.repeats.items() if parent is None]
    missing = {f.name: F.lit(None).cast(_SQL.get(f.kind, "string")) for f in plain.values() if f.name not in submissions.columns}
    df = submissions.withColumns(missing) if missing else submissions
    at_top = {f.name: _top(form, f.repeat) for f in form.fields.values() if f.repeat} | {r: _top(form, r) for r in form.repeats}
    node = lambda name: at_top.get(name, name)
    sources = {n: form.relevance(f) + [f.cells.get("calculation")] for n, f in plain.items()}
    for r in tops:
        inner = [f for f in form.fields.values() if f.repeat and _top(form, f.repeat) == r]
        sources[r] = [form.groups[g].get("relevance") for g in _around(form, r)] + [form.groups[r].get("repeat_count")] + [x for f in inner for x in (*form.relevance(f), f.cells.get("calculation"))]
    needs = {n: {node(x) for s in texts if s for x in references(parse(s))} & sources.keys() - {n} for n, texts in sources.items()}
    for layer in levels(needs):
        new: dict[str, Column] = {}
        for name in layer:
            if name in tops:
                if name in df.columns:
                    new[name] = _repeat(form, name, df, scope)
                continue
            f = plain[name]
            made = _answer(f, F.col(name), f.kind, scope)
            if f.type in ("calculate", "calculate_here"):
                scope.fields[name] = Value(F.col(name), made.kind)
            value = made.col
            if conditions := form.relevance(f):
                new[f"__rel_{name}"] = shown = _all_hold(conditions, scope)
                value = F.when(shown, value)
                scope.relevant[name] = F.col(f"__rel_{name}")
            new[name] = value
        df = df.withColumns(new)
    return df


def _top(form: Form, repeat: str) -> str:
    while form.repeats[repeat] is not None:
        repeat = form.repeats[repeat]
    return repeat


def _around(form: Form, repeat: str) -> list[str]:
    """The blocks around a repeat, itself last."""
    held = next((f.groups for f in form.fields.values() if repeat in f.groups), (repeat,))
    return list(held[: held.index(repeat) + 1])


def _members(form: Form, repeat: str) -> dict[str, Field]:
    return {f.name: f for f in form.fields.values() if f.repeat == repeat and f.type not in _NO_DATA}


def _own_conditions(form: Form, f: Field) -> list[str]:
    """What must hold in an instance for a member to show: the groups within the repeat, and its own."""
    inside = f.groups[f.groups.index(f.repeat) + 1 :]
    return [x for x in [*(form.groups[g].get("relevance") for g in inside), f.cells.get("relevance")] if x]


def _repeat(form: Form, name: str, df: DataFrame, scope: Scope) -> Column:
    """A top-level repeat as the form leaves it; ``scope`` learns the kinds of its members."""
    rows, kinds = _rows(form, name, F.col(name), df.schema[name].dataType.elementType, scope)
    scope.repeats[name] = Repeat(name, F.col(name), kinds, None)
    shown = [c for c in (form.groups[g].get("relevance") for g in _around(form, name)) if c]
    return F.when(_all_hold(shown, scope), rows).otherwise(F.slice(rows, 1, 0)) if shown else rows


def _inner(form: Form, name: str) -> list[str]:
    return [r for r, parent in form.repeats.items() if parent == name]


def _inner_conditions(form: Form, name: str, inner: str) -> list[str]:
    """What must hold for an inner repeat to be there: it and the groups between it and the repeat around it."""
    around = _around(form, inner)
    return [c for c in (form.groups[g].get("relevance") for g in around[around.index(name) + 1 :]) if c]


def _rows(form: Form, name: str, rows: Column, instance, scope: Scope) -> tuple[Column, dict[str, str]]:
    """The instances of a repeat, its inner repeats included, evaluated layer by layer; and the members' kinds."""
    members = _members(form, name)
    inner = [r for r in _inner(form, name) if r in instance.names]
    if form.groups[name].get("repeat_count"):
        rows = counted(rows, compile_expr(form.groups[name]["repeat_count"], scope).number())
    kinds = {f.name: f.kind for f in members.values()}
    texts = {n: [*_own_conditions(form, f), f.cells.get("calculation")] for n, f in members.items()}
    for r in inner:
        below = [f for f in form.fields.values() if f.repeat and r in f.groups]
        texts[r] = [*_inner_conditions(form, name, r), form.groups[r].get("repeat_count"), *(x for f in below for x in (*form.relevance(f), f.cells.get("calculation")))]
    at = {f.name: next((r for r in inner if f.repeat and r in f.groups), f.name) for f in form.fields.values()}
    needs = {n: {at.get(x, x) for s in found if s for x in references(parse(s))} & texts.keys() - {n} for n, found in texts.items()}
    held = list(dict.fromkeys([*instance.names, *members]))
    known = set(instance.names)
    for layer in levels(needs):
        idle = lambda n: n not in inner and n in known and not (form.fields[n].cells.get("calculation") or form.fields[n].cells.get("default") or _own_conditions(form, form.fields[n]))
        if all(map(idle, layer)):
            continue
        rows = F.transform(rows, _instance(form, name, layer, held, frozenset(known), kinds, instance, scope))
        known |= set(held)
    return rows, kinds


def _inner_scope(form: Form, name: str, x: Column, inside: Scope, instance=None) -> Scope:
    """The scope of an instance, with its inner repeats as its own arrays."""
    own = {r: Repeat(r, x[r], {f.name: f.kind for f in _members(form, r).values()}, name) for r in _inner(form, name) if instance is None or r in instance.names}
    return replace(inside, repeats={**inside.repeats, **own})


def _instance(form: Form, name: str, layer: list[str], held: list[str], known: frozenset, kinds: dict[str, str], instance, scope: Scope):
    """The function that evaluates one layer of members in an instance."""

    def each(x: Column, i: Column) -> Column:
        inside = scope.inside(Repeat(name, F.col(name), {n: k for n, k in kinds.items() if n in known}), x, (i + 1).cast("double"))
        inside = _inner_scope(form, name, x, inside, instance)
        out = []
        for n in held:
            kind = kinds.get(n, "string")
            value = x[n] if n in known else F.lit(None).cast(_SQL.get(kind, "string"))
            if n in layer and n in form.repeats:
                value, _ = _rows(form, n, value, instance[n].dataType.elementType, inside)
                value = F.when(_all_hold(c, inside), value).otherwise(F.slice(value, 1, 0)) if (c := _inner_conditions(form, name, n)) else value
            elif n in layer:
                f = form.fields[n]
                made = _answer(f, value, kind, inside)
                if f.type in ("calculate", "calculate_here"):
                    kinds[n] = made.kind
                value = F.when(_all_hold(c, inside), made.col) if (c := _own_conditions(form, f)) else made.col
            out.append(value.alias(n))
        return F.struct(*out)

    return each


def _tests(form: Form, f: Field, value: Value, shown: Column, scope: Scope) -> list[tuple[str, str | None, Column]]:
    """(rule, message, whether it is broken) of a field."""
    blank = value.string().isNull() | (value.string() == "")
    out = []
    if f.cells.get("constraint"):
        holds = compile_expr(f.cells["constraint"], replace(scope, current=value, of=f.name)).truth()
        out.append(("constraint", f.cells.get("constraint message"), ~blank & ~holds))
    if (f.cells.get("required") or "").lower() == "yes":
        out.append(("required", f.cells.get("required message"), shown & blank))
    if f.type == "integer":
        out.append(("nine_digits", None, F.coalesce(F.abs(value.number()) >= 1e9, F.lit(False))))
    return out


def _flags(name: str, tests: list, index: Column) -> list[Column]:
    return [F.when(bad, F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule"), F.lit(message).cast("string").alias("message"), index.cast("int").alias("index"))) for rule, message, bad in tests]


def violations(form: Form, evaluated: DataFrame, key: str, scope: Scope | None = None) -> DataFrame:
    """(key, field, rule, message, index) of every constraint that fails and every required blank; index is the (innermost) instance's, in repeats. One pass, no join."""
    scope = scope or form.scope()
    found: list[Column] = []
    for f in form.fields.values():
        if f.repeat or f.type in _NO_DATA:
            continue
        shown = F.col(f"__rel_{f.name}") if f"__rel_{f.name}" in evaluated.columns else F.lit(True)
        found += _flags(f.name, _tests(form, f, Value(F.col(f.name), f.kind), shown, scope), F.lit(None))
    kind = "array<struct<field:string,rule:string,message:string,index:int>>"
    parts = [F.array(*found) if found else F.array().cast(kind)]
    for r, parent in form.repeats.items():
        if parent is None and r in evaluated.columns:
            parts.append(_repeat_flags(form, r, F.col(r), evaluated.schema[r].dataType.elementType, scope, kind))
    listed = F.filter(F.concat(*parts), lambda x: x.isNotNull())
    return evaluated.select(key, F.explode(listed).alias("v")).select(key, "v.*")


def _repeat_flags(form: Form, name: str, rows: Column, instance, scope: Scope, kind: str) -> Column:
    def each(x: Column, i: Column) -> Column:
        inside = _inner_scope(form, name, x, scope.inside(Repeat(name, rows, {f.name: f.kind for f in _members(form, name).values() if f.name in instance.names}), x, (i + 1).cast("double")), instance)
        flags = []
        for n, f in _members(form, name).items():
            if n in instance.names:
                shown = _all_hold(c, inside) if (c := _own_conditions(form, f)) else F.lit(True)
                flags += _flags(n, _tests(form, f, Value(x[n], f.kind), shown, inside), i + 1)
        own = F.array(*flags) if flags else F.array().cast(kind)
        deeper = [_repeat_flags(form, r, x[r], instance[r].dataType.elementType, inside, kind) for r in _inner(form, name) if r in instance.names]
        return F.concat(own, *deeper) if deeper else own

    return F.flatten(F.transform(F.coalesce(rows, F.array()), each))


def interpolate(label: str, scope: Scope, group_labels: dict[str, str] | None = None) -> Column:
    """A label with ${...} filled in: a field's value, a group's label, or all instances of a repeated field."""
    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\$\{([^}]+)\}", label)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif group_labels and piece in group_labels:
            parts.append(F.lit(group_labels[piece]))
        elif scope.repeat_of(piece):
            r = scope.repeat_of(piece)
            parts.append(_all_instances(r, piece))
        else:
            parts.append(compile_expr(Ref(piece), scope).string())
    return text.concat(*parts)


def _all_instances(r: Repeat, member: str) -> Column:
    return F.array_join(F.transform(r.array, lambda x: Value(x[member], r.members[member]).string()), ", ")


def instance_name(form: Form, scope: Scope | None = None) -> Column:
    return compile_expr(form.settings["instance_name"], scope or form.scope()).string()


def speed_violations(timings: DataFrame, form: Form, key: str = "KEY") -> DataFrame:
    """Per submission, from (key, field, seconds, seq): how many fields took less than their minimum, and which, in order."""
    least = {f.name: float(f.cells["minimum_seconds"]) for f in form.fields.values() if f.cells.get("minimum_seconds")}
    pairs = [F.lit(x) for p in least.items() for x in p]
    bound = F.try_element_at(F.create_map(*pairs), F.col("field")) if pairs else F.lit(None).cast("double")
    fast = F.coalesce(F.col("seconds") < bound, F.lit(False))
    listed = F.array_sort(F.collect_list(F.when(fast, F.struct("seq", "field"))))
    return timings.groupBy(key).agg(F.count_if(fast).alias("n_fast"), F.array_join(F.transform(listed, lambda x: x["field"]), ",").alias("fast_fields"))
