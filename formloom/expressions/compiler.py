"""Expressions to Spark columns.

A field's value is typed: number, string, boolean, date, datetime.  Blank is
NULL in storage; comparisons with text see it as '', predicates read an unknown
as false.  Coercions and divisions never raise.

A field of a repeat is a member of an array of structs.  Within the repeat (in
a predicate "per instance", or in a calculation of the repeat) it is the
current instance's; outside it must be aggregated or indexed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, geo, lists, text
from .syntax import Binary, Call, Dot, Expr, ExpressionError, Literal, Name, Ref, Unary, number_text, parse, print_expr

NUMBER, STRING, BOOLEAN, DATE, DATETIME = "number", "string", "boolean", "date", "datetime"
#: Kinds of a form's field types; the rest are strings.
KINDS = {"integer": NUMBER, "decimal": NUMBER, "date": DATE, "datetime": DATETIME, "start": DATETIME, "end": DATETIME, "speed violations count": NUMBER, "sensor_statistic": NUMBER}


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str = STRING
    literal: object = None

    def number(self) -> Column:
        if self.kind == NUMBER:
            return self.col
        if self.kind == BOOLEAN:
            return self.col.cast("double")
        if self.kind == DATE:
            return F.datediff(self.col, F.lit("1970-01-01").cast("date")).cast("double")
        if self.kind == DATETIME:
            return dates.decimal_date_time(self.datetime())
        return self.col.try_cast("double")

    def string(self) -> Column:
        if self.kind == NUMBER:
            return text.number_text(self.col)
        return self.col if self.kind == STRING else self.col.cast("string")

    def truth(self) -> Column:
        """Unknown is false; a number is true unless 0, a text unless blank."""
        if self.kind == BOOLEAN:
            return F.coalesce(self.col, F.lit(False))
        if self.kind == NUMBER:
            return F.coalesce(self.col != 0, F.lit(False))
        return F.coalesce(self.string() != "", F.lit(False))

    def date(self) -> Column:
        return self.col if self.kind == DATE else dates.to_date(self.string()) if self.kind == STRING else self.col.try_cast("date")

    def datetime(self) -> Column:
        return dates.to_timestamp(self.string()) if self.kind == STRING else self.col.try_cast("timestamp")


@dataclass(frozen=True)
class Repeat:
    """A repeat group: its name, the array column, and the kinds of its members."""

    name: str
    array: Column
    members: dict[str, str]
    parent: str | None = None


@dataclass(frozen=True)
class Scope:
    """What names mean where an expression is evaluated."""

    fields: dict[str, Value] = field(default_factory=dict)
    repeats: dict[str, Repeat] = field(default_factory=dict)
    current: Value | None = None
    columns: dict[str, Value] = field(default_factory=dict)  # of the choice row under test
    relevant: dict[str, Column] = field(default_factory=dict)
    labels: dict[str, dict[str, str]] = field(default_factory=dict)  # field: value: label
    key: Column | None = None
    of: str = ""  # the field whose expression this is
    stored: Column | None = None  # what once() has already given
    today: Column = field(default_factory=F.current_date)
    now: Column = field(default_factory=F.current_timestamp)
    inputs: dict[str, Column] = field(default_factory=dict)  # device and session values
    pulled: object = None  # resolves pulldata(): (source, column, lookup column, value) -> Column
    within: str | None = None
    index: Column | None = None

    def inside(self, repeat: Repeat, row: Column, index: Column) -> Scope:
        members = {n: Value(row[n], k) for n, k in repeat.members.items()}
        return replace(self, fields={**self.fields, **members}, within=repeat.name, index=index)

    def repeat_of(self, name: str) -> Repeat | None:
        """The repeat that holds the field, if we are not inside it."""
        for r in self.repeats.values():
            if name in r.members and self.within != r.name:
                return r
        return None


def scope_of(kinds: dict[str, str], repeats: dict[str, dict[str, str]] | None = None, **more) -> Scope:
    """A scope over columns of the same names; repeats: array column: member: kind."""
    fields = {n: Value(F.col(n), k) for n, k in kinds.items()}
    return Scope(fields=fields, repeats={r: Repeat(r, F.col(r), m) for r, m in (repeats or {}).items()}, **more)


def compile_expr(source: str | Expr, scope: Scope) -> Value:
    return _Compiler(scope).value(parse(source) if isinstance(source, str) else source)


def predicate(source: str | Expr, scope: Scope) -> Column:
    return compile_expr(source, scope).truth()


def where(source: str | Expr, scope: Scope) -> Column:
    """The expression as a filter: rows kept are those of ``predicate``, in a form that reaches the scan.

    In a filter unknown is false already, so conjunctions, disjunctions and
    comparisons need no wrapping; everything else is wrapped as elsewhere.
    """
    c = _Compiler(scope)

    def plain(e: Expr) -> Column:
        if isinstance(e, Binary) and e.op in ("and", "or"):
            return plain(e.left) & plain(e.right) if e.op == "and" else plain(e.left) | plain(e.right)
        v = c.value(e)
        return v.col if isinstance(e, Binary) and v.kind == BOOLEAN else v.truth()

    return plain(parse(source) if isinstance(source, str) else source)


class _Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope
        self.drawn = 0  # calls of chance so far

    def value(self, e: Expr) -> Value:
        match e:
            case Literal(value=str() as v):
                return Value(F.lit(v), STRING, v)
            case Literal(value=v):
                return Value(F.lit(float(v)), NUMBER, v)
            case Ref(name=n):
                if n not in self.scope.fields and self.scope.repeat_of(n):
                    raise ExpressionError(f"REPEAT_REF_WITHOUT_AGGREGATE: ${{{n}}} is repeated; aggregate it or choose an instance")
                return self._known(self.scope.fields, n, "field")
            case Dot():
                if self.scope.current is None:
                    raise ExpressionError("'.' has a meaning in constraints only")
                return self.scope.current
            case Name(name=n):
                return self._known(self.scope.columns, n, "choice column")
            case Unary(arg=a):
                return Value(-self.value(a).number(), NUMBER)
            case Binary():
                return self._binary(e)
            case Call():
                return self._call(e)
        raise TypeError(e)

    @staticmethod
    def _known(of: dict, name: str, what: str) -> Value:
        if name not in of:
            raise ExpressionError(f"unknown {what} {name}")
        return of[name]

    def _binary(self, e: Binary) -> Value:
        a, b = self.value(e.left), self.value(e.right)
        if e.op == "and":
            return Value(a.truth() & b.truth(), BOOLEAN)
        if e.op == "or":
            return Value(a.truth() | b.truth(), BOOLEAN)
        if e.op == "+":
            if DATE in (a.kind, b.kind):
                day, n = (a, b) if a.kind == DATE else (b, a)
                return Value(F.date_add(day.col, n.number().cast("int")), DATE)
            return Value(a.number() + b.number(), NUMBER)
        if e.op == "-":
            if a.kind == DATE and b.kind == DATE:
                return Value(F.datediff(a.col, b.col).cast("double"), NUMBER)
            if a.kind == DATE:
                return Value(F.date_sub(a.col, b.number().cast("int")), DATE)
            return Value(a.number() - b.number(), NUMBER)
        if e.op == "*":
            return Value(a.number() * b.number(), NUMBER)
        if e.op == "div":
            return Value(F.try_divide(a.number(), b.number()), NUMBER)
        if e.op == "mod":
            return Value(F.try_mod(a.number(), b.number()), NUMBER)
        return self._compare(e.op, a, b)

    @staticmethod
    def _compare(op: str, a: Value, b: Value) -> Value:
        kinds = {a.kind, b.kind}
        if "" in (a.literal, b.literal):  # a comparison with '' asks for blankness
            left, right = text.empty_text(a.string()), text.empty_text(b.string())
        elif NUMBER in kinds:
            left, right = a.number(), b.number()
        elif DATETIME in kinds:
            left, right = a.datetime(), b.datetime()
        elif DATE in kinds:
            left, right = a.date(), b.date()
        elif kinds == {BOOLEAN}:
            left, right = a.truth(), b.truth()
        else:
            left, right = text.empty_text(a.string()), text.empty_text(b.string())
        if op in ("=", "=="):
            return Value(left == right, BOOLEAN)
        return Value({"!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], BOOLEAN)

    # ---- functions
    def _call(self, e: Call) -> Value:
        handler = getattr(self, "f_" + e.name.replace("-", "_").replace(":", "_"), None)
        if handler is None:
            raise ExpressionError(f"unknown function {e.name}()")
        try:
            return handler(*e.args)
        except TypeError as err:
            if "positional argument" in str(err):
                raise ExpressionError(f"{e.name}() takes other arguments: {print_expr(e)}") from err
            raise

    def num(self, e: Expr) -> Column:
        return self.value(e).number()

    def str(self, e: Expr) -> Column:
        return self.value(e).string()

    def const(self, e: Expr, what: str = "a text") -> str:
        got = self.value(e).literal
        if not isinstance(got, str):
            raise ExpressionError(f"{what} must be written out: {print_expr(e)}")
        return got

    # strings
    def f_string(self, a):
        return Value(self.str(a))

    def f_string_length(self, a):
        return Value(F.length(text.empty_text(self.str(a))).cast("double"), NUMBER)

    def f_substr(self, a, start, end):
        return Value(text.substr(self.str(a), self.num(start), self.num(end)))

    def f_concat(self, *args):
        return Value(text.concat(*[self.str(a) for a in args]))

    def f_linebreak(self):
        return Value(F.lit("\n"), STRING, "\n")

    def f_lower(self, a):
        return Value(F.lower(self.str(a)))

    def f_upper(self, a):
        return Value(F.upper(self.str(a)))

    def f_contains(self, a, b):
        return Value(F.contains(text.empty_text(self.str(a)), text.empty_text(self.str(b))), BOOLEAN)

    def f_starts_with(self, a, b):
        return Value(F.startswith(text.empty_text(self.str(a)), text.empty_text(self.str(b))), BOOLEAN)

    def f_ends_with(self, a, b):
        return Value(F.endswith(text.empty_text(self.str(a)), text.empty_text(self.str(b))), BOOLEAN)

    def f_regex(self, a, pattern):
        return Value(F.rlike(text.empty_text(self.str(a)), F.lit(self.const(pattern, "a pattern"))), BOOLEAN)

    def f_hash(self, *args):
        return Value(text.keyed_hash(*[self.str(a) for a in args]))

    # selects
    def f_count_selected(self, a):
        return Value(lists.count_selected(self.str(a)), NUMBER)

    def f_selected(self, a, value):
        return Value(lists.selected(self.str(a), self.str(value)), BOOLEAN)

    def f_selected_at(self, a, n):
        return Value(lists.selected_at(self.str(a), self.num(n)))

    def f_choice_label(self, a, value):
        if not isinstance(a, Ref) or a.name not in self.scope.labels:
            raise ExpressionError("choice-label() needs a field with static choices")
        pairs = [F.lit(x) for p in self.scope.labels[a.name].items() for x in p]
        return Value(F.try_element_at(F.create_map(*pairs), self.str(value)) if pairs else F.lit(None).cast("string"))

    def f_jr_choice_name(self, value, name):
        return self.f_choice_label(Ref(self.const(name).removeprefix("${").removesuffix("}")), value)

    # lists
    def f_count_items(self, d, a):
        return Value(lists.count_items(self.const(d), self.str(a)), NUMBER)

    def f_item_at(self, d, a, n):
        return Value(lists.item_at(self.const(d), self.str(a), self.num(n)))

    def f_item_index(self, d, a, v):
        return Value(lists.item_index(self.const(d), self.str(a), self.str(v)), NUMBER)

    def f_item_present(self, d, a, v):
        return Value(lists.item_present(self.const(d), self.str(a), self.str(v)), BOOLEAN)

    def f_de_duplicate(self, d, a):
        return Value(lists.de_duplicate(self.const(d), self.str(a)))

    def f_rank_value(self, v, numbers):
        return Value(lists.rank_value(self.num(v), self.str(numbers)), NUMBER)

    # repeats
    def _repeated(self, e: Expr) -> tuple[Repeat, str]:
        if isinstance(e, Ref) and (r := self.scope.repeat_of(e.name)):
            return r, e.name
        raise ExpressionError(f"{print_expr(e)} is no repeated field")

    def _group(self, e: Expr) -> Repeat:
        if isinstance(e, Ref) and e.name in self.scope.repeats:
            return self.scope.repeats[e.name]
        raise ExpressionError(f"{print_expr(e)} is no repeat group")

    def _rows(self, r: Repeat, where: Expr | None) -> Column:
        rows = F.coalesce(r.array, F.array())
        if where is None:
            return rows
        return F.filter(rows, lambda x, i: _Compiler(self.scope.inside(r, x, (i + 1).cast("double"))).value(where).truth())

    def _members(self, e: Expr, where: Expr | None) -> tuple[Column, str]:
        r, name = self._repeated(e)
        return F.transform(self._rows(r, where), lambda x: x[name]), r.members[name]

    def _numbers(self, e: Expr, where: Expr | None) -> Column:
        col, kind = self._members(e, where)
        return F.transform(col, lambda x: Value(x, kind).number())

    def _joined(self, d, e, where):
        col, kind = self._members(e, where)
        return Value(F.array_join(F.transform(col, lambda x: text.empty_text(Value(x, kind).string())), self.const(d)))

    def f_join(self, d, e):
        return self._joined(d, e, None)

    def f_join_if(self, d, e, where):
        return self._joined(d, e, where)

    def f_count(self, e):
        return Value(F.size(self._rows(self._group(e), None)).cast("double"), NUMBER)

    def f_count_if(self, e, where):
        return Value(F.size(self._rows(self._group(e), where)).cast("double"), NUMBER)

    def f_sum(self, e):
        return self.f_sum_if(e, None)

    def f_sum_if(self, e, where):
        return Value(F.aggregate(self._numbers(e, where), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), NUMBER)

    def _extreme(self, pick, e, where):
        col, kind = self._members(e, where)
        return Value(pick(col), kind)

    def f_min(self, *args):
        return self._least(F.array_min, F.least, args)

    def f_max(self, *args):
        return self._least(F.array_max, F.greatest, args)

    def _least(self, of_array, of_args, args):
        if len(args) == 1 and isinstance(args[0], Ref) and self.scope.repeat_of(args[0].name):
            return self._extreme(of_array, args[0], None)
        values = [self.value(a) for a in args]
        kinds = {v.kind for v in values}
        kind = next(iter(kinds)) if len(kinds) == 1 else NUMBER
        cols = [v.col if kind != NUMBER else v.number() for v in values]
        return Value(of_args(*cols) if len(cols) > 1 else cols[0], kind)

    def f_min_if(self, e, where):
        return self._extreme(F.array_min, e, where)

    def f_max_if(self, e, where):
        return self._extreme(F.array_max, e, where)

    def f_index(self):
        if self.scope.index is None:
            raise ExpressionError("index() has a meaning in a repeat only")
        return Value(self.scope.index, NUMBER)

    def f_indexed_repeat(self, e, *pairs):
        if not isinstance(e, Ref) or len(pairs) < 2 or len(pairs) % 2:
            raise ExpressionError("indexed-repeat() needs a field and pairs of group and index")
        rows = row = None
        for group, at in zip(pairs[::2], pairs[1::2]):
            r = self._group(group)
            rows = F.coalesce(r.array if row is None else row[r.name], F.array())
            n = self.num(at).cast("int")
            # an instance that is not there falls back to the first
            row = F.when(n.between(1, F.size(rows)), F.get(rows, n - 1)).otherwise(F.get(rows, F.lit(0)))
        return Value(row[e.name], r.members[e.name])

    def _rank(self, at, e, where):
        r, name = self._repeated(e)
        kind = r.members[name]
        n = self.num(at).cast("int")
        ranked = F.transform(F.coalesce(r.array, F.array()), lambda x, i: F.struct(
            Value(x[name], kind).number().alias("v"), (i + 1).alias("i"),
            (F.lit(True) if where is None else _Compiler(self.scope.inside(r, x, (i + 1).cast("double"))).value(where).truth()).alias("p")))
        own = F.get(F.filter(ranked, lambda x: x["i"] == n), F.lit(0))
        ahead = F.filter(ranked, lambda x: x["p"] & ((x["v"] > own["v"]) | ((x["v"] == own["v"]) & (x["i"] < n))))
        return Value(F.when(own["v"].isNotNull() & own["p"], (F.size(ahead) + 1).cast("double")).otherwise(F.lit(999.0)), NUMBER)

    def f_rank_index(self, at, e):
        return self._rank(at, e, None)

    def f_rank_index_if(self, at, e, where):
        return self._rank(at, e, where)

    # geography
    def f_distance_between(self, a, b):
        return Value(geo.distance(geo.point(self.str(a)), geo.point(self.str(b))), NUMBER)

    def f_area(self, a):
        if isinstance(a, Ref) and self.scope.repeat_of(a.name):
            col, _ = self._members(a, None)
            return Value(geo.area(F.filter(F.transform(col, geo.point), lambda p: p.isNotNull())), NUMBER)
        return Value(geo.area(geo.points(self.str(a))), NUMBER)

    def f_geo_scatter(self, a, metres):
        return Value(geo.scatter(self.str(a), self.num(metres), *self._draw()))

    def f_short_geopoint(self, a):
        return Value(geo.short(self.str(a)))

    # numbers
    def f_number(self, a):
        return Value(self.num(a), NUMBER)

    def f_int(self, a):
        return Value(self.num(a).try_cast("bigint").cast("double"), NUMBER)

    def f_format_number(self, a):
        return Value(text.format_number(self.num(a)))

    def f_round(self, a, digits=Literal(0.0)):
        d = self.value(digits).literal
        if d is None:
            raise ExpressionError("round() needs its digits written out")
        return Value(F.round(self.num(a), int(float(d))), NUMBER)

    def f_pow(self, a, b):
        return Value(F.pow(self.num(a), self.num(b)), NUMBER)

    def f_atan2(self, x, y):
        return Value(F.atan2(self.num(y), self.num(x)), NUMBER)

    def f_pi(self):
        return Value(F.lit(3.141592653589793), NUMBER)

    # dates
    def f_today(self):
        return Value(self.scope.today, DATE)

    def f_now(self):
        return Value(self.scope.now, DATETIME)

    def f_date(self, a):
        return Value(self.value(a).date(), DATE)

    def f_date_time(self, a):
        return Value(self.value(a).datetime(), DATETIME)

    def f_decimal_date_time(self, a):
        return Value(dates.decimal_date_time(self.value(a).datetime()), NUMBER)

    def f_decimal_time(self, a):
        return Value(dates.decimal_time(self.str(a)), NUMBER)

    def f_format_date_time(self, a, fmt):
        return Value(dates.format_date_time(self.value(a).datetime(), self.const(fmt, "a format")))

    def f_format_date(self, a, fmt):
        return Value(dates.format_date_time(self.value(a).date(), self.const(fmt, "a format")))

    # session and device: values that come with the data
    def _input(self, name: str, kind: str = STRING) -> Value:
        if name not in self.scope.inputs:
            raise ExpressionError(f"no input column stands for {name}()")
        return Value(self.scope.inputs[name], kind)

    def f_duration(self):
        return self._input("duration", NUMBER)

    def f_enumerator_name(self):
        return self._input("enumerator-name")

    def f_enumerator_id(self):
        return self._input("enumerator-id")

    def f_username(self):
        return self._input("username")

    def f_version(self):
        return self._input("version")

    def f_device_info(self):
        return self._input("device-info")

    def f_phone_call_log(self):
        return self._input("phone-call-log")

    def f_phone_call_duration(self):
        return self._input("phone-call-duration", NUMBER)

    def f_collect_is_phone_app(self):
        return self._input("collect-is-phone-app", BOOLEAN)

    def f_plug_in_metadata(self, a):
        if not isinstance(a, Ref):
            raise ExpressionError("plug-in-metadata() needs a field")
        return Value(F.coalesce(self.scope.inputs.get(f"{a.name}__metadata", F.lit(None).cast("string")), F.lit("")))

    # conditions
    def f_not(self, a):
        return Value(~self.value(a).truth(), BOOLEAN)

    def f_true(self):
        return Value(F.lit(True), BOOLEAN)

    def f_false(self):
        return Value(F.lit(False), BOOLEAN)

    def f_relevant(self, a):
        if not isinstance(a, Ref):
            raise ExpressionError("relevant() needs a field")
        return Value(self.scope.relevant.get(a.name, F.lit(True)), BOOLEAN)

    def f_empty(self, a):
        return Value(F.coalesce(self.str(a), F.lit("")) == "", BOOLEAN)

    def f_if(self, test, yes, no):
        a, b = self.value(yes), self.value(no)
        kind = a.kind if a.kind == b.kind or b.literal == "" else b.kind if a.literal == "" else STRING
        pick = {NUMBER: Value.number, STRING: Value.string, DATE: Value.date, DATETIME: Value.datetime, BOOLEAN: Value.truth}[kind]
        of = lambda v: F.lit(None) if v.literal == "" and kind != STRING else pick(v)
        return Value(F.when(self.value(test).truth(), of(a)).otherwise(of(b)), kind)

    def f_coalesce(self, *args):
        values = [self.value(a) for a in args]
        if len({v.kind for v in values}) == 1 and values[0].kind != STRING:
            return Value(F.coalesce(*[v.col for v in values]), values[0].kind)
        return Value(F.coalesce(*[F.nullif(v.string(), F.lit("")) for v in values]))

    # chance: the same in every run, another for each submission, field, instance and place in the expression
    def _draw(self) -> list[Column]:
        if self.scope.key is None:
            raise ExpressionError("chance needs the submission's key")
        self.drawn += 1
        place = [self.scope.key.cast("string"), F.lit(self.scope.of), F.lit(str(self.drawn))]
        return place if self.scope.index is None else [*place, self.scope.index.cast("int").cast("string")]

    def f_random(self):
        return Value(text.keyed_random(*self._draw()), NUMBER)

    def f_uuid(self):
        return Value(text.keyed_uuid(*self._draw()))

    def f_once(self, e):
        v = self.value(e)
        if self.scope.stored is None:
            return v
        kept = Value(self.scope.stored, STRING)
        kept = {NUMBER: kept.number, DATE: kept.date, DATETIME: kept.datetime}.get(v.kind, kept.string)()
        return Value(F.coalesce(kept, v.col), v.kind)

    # lookups
    def f_pulldata(self, source, column, lookup, value):
        if self.scope.pulled is None:
            raise ExpressionError("pulldata() needs its sources joined first (operators.lookup)")
        return Value(self.scope.pulled(self.const(source), self.const(column), self.const(lookup), value))


def _simple(name: str):
    f = getattr(F, name)
    return lambda self, a: Value(f(self.num(a)), NUMBER)


for _name in ("abs", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "sqrt", "exp"):
    setattr(_Compiler, f"f_{_name}", _simple(_name))

FUNCTIONS = sorted(n[2:].replace("jr_", "jr:").replace("_", "-") for n in dir(_Compiler) if n.startswith("f_"))
__all__ = ["FUNCTIONS", "KINDS", "Repeat", "Scope", "Value", "compile_expr", "number_text", "predicate", "scope_of", "where"]
