"""Filters with one output as Catalyst columns.

Only what gives the interpreter's results on every row is translated; anything else raises NotTyped and is
left to the interpreter. Null is an ordinary value here, the least one. Where the language raises an
error, the column does so too, with the same message, and the job fails as a program with an uncaught error does.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotTyped(Exception):
    """The filter has no translation to columns."""


@dataclass(frozen=True)
class Typed:
    """A column and its type; a row of a table, whose fields are columns, has no column of its own."""

    column: Column | None
    type: T.DataType
    #: Names of a row's columns, where fields have other names than the table's.
    names: Mapping[str, str] | None = None

    @property
    def kind(self) -> str:
        return kind(self.type)


Scope = Mapping[str, Typed]
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
SPACES = " \t\n\r\f\x0b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that mean the same in all regular expression engines: no classes by name, no end of line.
PLAIN_PATTERN = re.compile(r"\^?(?:[\w /:@#%&=<>!'\"~`,;-]|\[\^?[\w /:.,@#-]+\]|\.|\(\?:|[()|*+?]|\{\d+(?:,\d*)?\})*", re.ASCII)


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (*INTEGERS, *FLOATS)):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.StructType) or isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        return "object"
    return "other"  # dates, decimals, bytes: they can be carried and put in order


def fail(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def literal(x: object) -> Typed:
    if x is None:
        return Typed(F.lit(None), T.NullType())
    for python, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
        if isinstance(x, python):
            if python is int and not -(2**63) <= x < 2**63:
                raise NotTyped(x)
            return Typed(F.lit(float(x) if python is float else x).cast(t), t)
    if isinstance(x, list):
        items = [literal(y) for y in x]
        return collected(items)
    raise NotTyped(x)


def whole(v: Typed) -> Column:
    """The column of a value; a row becomes a struct."""
    if v.column is not None:
        return v.column
    return F.struct(*(F.col(f"`{(v.names or {}).get(f.name, f.name)}`").alias(f.name) for f in v.type.fields))


def field(v: Typed, name: str) -> Typed:
    if isinstance(v.type, T.StructType):
        if name not in v.type.fieldNames():
            return literal(None)
        c = F.col(f"`{(v.names or {}).get(name, name)}`") if v.column is None else v.column[name]
        return Typed(c, v.type[name].dataType)
    if isinstance(v.type, T.MapType) and v.kind == "object":
        return Typed(F.try_element_at(v.column, F.lit(name)), v.type.valueType)
    if v.kind == "null":
        return literal(None)
    raise NotTyped(name)


def element(v: Typed, k: int) -> Typed:
    if isinstance(v.type, T.ArrayType):
        return Typed(F.get(v.column, F.lit(k)) if k >= 0 else F.try_element_at(v.column, F.lit(k)), v.type.elementType)
    raise NotTyped(k)


def common(values: list[Typed]) -> tuple[list[Column], T.DataType]:
    """The values' columns in one type: integers with integers, numbers with numbers, nulls with anything."""
    known = [v for v in values if v.kind != "null"]
    if not known:
        return [whole(v) for v in values], T.NullType()
    kinds = {v.kind for v in known}
    if len(kinds) > 1:
        raise NotTyped(kinds)
    if kinds == {"number"}:
        t: T.DataType = T.LongType() if all(isinstance(v.type, INTEGERS) for v in known) else T.DoubleType()
    else:
        t = known[0].type
        if any(v.type != t for v in known):
            raise NotTyped([v.type for v in known])
    return [whole(v).cast(t) if v.kind in ("null", "number") else whole(v) for v in values], t


def collected(items: list[Typed]) -> Typed:
    if not items:
        raise NotTyped("an array without a type")
    columns, t = common(items)
    return Typed(F.array(*columns), T.ArrayType(t, True))


def truth(v: Typed) -> Column:
    """True or false, never null."""
    if v.kind == "boolean":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "null":
        return F.lit(False)
    return F.lit(True) if v.column is None else v.column.isNotNull()


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Null is below all, and NaN below all numbers, itself included."""
    if a.kind == "null" or b.kind == "null":
        x, y = a.column if a.column is not None else F.lit(True), b.column if b.column is not None else F.lit(True)
        low, high = x.isNull(), y.isNull()
        return {"==": low == high, "!=": low != high, "<": low & ~high, "<=": low | ~high if b.kind != "null" else low, ">": ~low & high, ">=": high | ~low if a.kind != "null" else high}[op]
    if a.kind != b.kind or a.kind in ("array", "object") or a.kind == "other" and a.type != b.type:
        raise NotTyped(op)
    (x, y), _ = common([a, b]) if a.kind != "other" else ([a.column, b.column], None)
    nan = [F.isnan(v.column) if isinstance(v.type, FLOATS) else F.lit(False) for v in (a, b)]
    some = [isinstance(v.type, FLOATS) for v in (a, b)]
    if op in ("==", "!="):
        same = x.eqNullSafe(y)
        if all(some):
            same = same & ~F.coalesce(nan[0], F.lit(False))
        return same if op == "==" else ~same
    if op in (">", ">="):
        # NaN is the greatest number in Spark, so where it may occur it is ruled out.
        out = (x > y) if op == ">" else (x >= y)
        if some[0]:
            out = out & ~nan[0]
        if some[1]:
            out = out | x.isNotNull() & ~nan[0] & nan[1]
        return out | x.isNotNull() & y.isNull() if op == ">" else out | y.isNull()
    out = (x < y) if op == "<" else (x <= y)
    if some[1]:
        out = out & ~nan[1]
    if some[0]:
        out = out | y.isNotNull() & nan[0]
    return out | x.isNull() & y.isNotNull() if op == "<" else out | x.isNull()


WORDS = {"+": "added", "-": "subtracted", "*": "multiplied", "/": "divided", "%": "divided"}


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and "null" in (a.kind, b.kind):
        return b if a.kind == "null" else a
    if a.kind != b.kind:
        raise NotTyped(op)
    (x, y), t = common([a, b])
    if op == "+" and a.kind in ("number", "string", "array"):
        return Typed(F.coalesce(x + y if a.kind == "number" else F.concat(x, y), x, y), t)
    missing = x.isNull() | y.isNull()
    message = f"null (null) and {b.kind} cannot be {WORDS[op]}"
    if a.kind == "number":
        if op in ("-", "*"):
            return Typed(fail(missing, message, x - y if op == "-" else x * y), t)
        rest = " (remainder)" if op == "%" else ""
        zero = f"number and number (0) cannot be divided{rest} because the divisor is zero"
        if op == "/":
            x, y = x.cast("double"), y.cast("double")
            return Typed(fail(missing, message, fail(y == 0, zero, F.try_divide(x, y))), T.DoubleType())
        if op == "%" and isinstance(t, T.LongType):
            return Typed(fail(missing, message, fail(y == 0, zero, F.try_mod(x, F.abs(y)))), t)
    if op == "-" and a.kind == "array" and kind(t.elementType) in ("string", "boolean") or op == "-" and a.kind == "array" and isinstance(t.elementType, INTEGERS):
        return Typed(fail(missing, message, F.filter(x, lambda e: ~F.exists(y, lambda o: o.eqNullSafe(e)))), t)
    if op == "/" and a.kind == "string":
        return split(Typed(fail(missing, message, x), t), Typed(y, t))
    raise NotTyped(op)


def split(v: Typed, separator: Typed) -> Typed:
    parts = F.split(v.column, F.concat(F.lit("\\Q"), separator.column, F.lit("\\E")), -1)
    letters = F.filter(F.split(v.column, ""), lambda c: c != "")
    empty = F.array().cast("array<string>")
    return Typed(F.when(v.column == "", empty).when(separator.column == "", letters).otherwise(parts), T.ArrayType(T.StringType(), True))


def text(v: Typed) -> Column:
    """A value as tostring gives it; doubles have another spelling in Spark."""
    if v.kind == "null":
        return F.lit("null")
    if v.kind in ("string", "boolean") or isinstance(v.type, INTEGERS):
        return F.coalesce(v.column.cast("string"), F.lit("null"))
    raise NotTyped("text")


def given(v: Typed, message: str, of: tuple[str, ...]) -> Column:
    """The column of a value that must be of a kind and not null."""
    if v.kind not in of or v.column is None:
        raise NotTyped(message)
    return fail(v.column.isNull(), message, v.column)


def ordered(v: Typed) -> T.ArrayType:
    """The type of an array that Spark sorts as the language does, nulls apart."""
    if isinstance(v.type, T.ArrayType) and (isinstance(v.type.elementType, INTEGERS) or kind(v.type.elementType) in ("string", "boolean")):
        return v.type
    raise NotTyped("order")


def in_order(c: Column) -> Column:
    return F.concat(F.filter(c, lambda x: x.isNull()), F.array_sort(F.filter(c, lambda x: x.isNotNull())))


def number_function(f: Callable[[Column], Column], t: T.DataType | None = None) -> Callable[[Typed], Typed]:
    def call(v: Typed) -> Typed:
        if isinstance(v.type, INTEGERS) and t is None:
            return Typed(given(v, "null (null) number required", ("number",)), v.type)
        c = given(v, "null (null) number required", ("number",)).cast("double")
        if t is None:  # a whole number, which must fit 64 bits
            c = fail(F.isnan(c) | (F.abs(c) >= 2.0**63), "number out of range", c)
            return Typed(f(c).cast("long"), T.LongType())
        return Typed(f(c), t)

    return call


def _length(v: Typed) -> Typed:
    if v.kind == "null":
        return literal(0)
    if v.column is None:
        return literal(len(v.type.fields))
    if v.kind == "string":
        return Typed(F.coalesce(F.length(v.column), F.lit(0)).cast("long"), T.LongType())
    if isinstance(v.type, T.ArrayType) or isinstance(v.type, T.MapType):
        return Typed(F.when(v.column.isNull(), 0).otherwise(F.size(v.column)).cast("long"), T.LongType())
    if isinstance(v.type, T.StructType):
        return Typed(F.when(v.column.isNull(), 0).otherwise(len(v.type.fields)).cast("long"), T.LongType())
    if v.kind == "number":
        t = T.LongType() if isinstance(v.type, INTEGERS) else T.DoubleType()
        return Typed(F.coalesce(F.abs(v.column.cast(t)), F.lit(0).cast(t)), t)
    raise NotTyped("length")


def _add(v: Typed) -> Typed:
    if not isinstance(v.type, T.ArrayType) or v.column is None:
        raise NotTyped("add")
    e = v.type.elementType
    if isinstance(e, INTEGERS):
        return Typed(F.aggregate(v.column, F.lit(None).cast("long"), lambda a, x: F.coalesce(a + x, a, x.cast("long"))), T.LongType())
    if isinstance(e, FLOATS):
        return Typed(F.aggregate(v.column, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x.cast("double"))), T.DoubleType())
    if kind(e) == "string":
        return Typed(F.when(F.exists(v.column, lambda x: x.isNotNull()), F.array_join(v.column, "")), e)
    raise NotTyped("add")


def _flatten(v: Typed) -> Typed:
    if isinstance(v.type, T.ArrayType) and v.column is not None:
        e = v.type.elementType
        if kind(e) in ("array", "object", "other"):
            if not isinstance(e, T.ArrayType) or kind(e.elementType) == "array":
                raise NotTyped("flatten")
            one = F.array(F.lit(None).cast(e.elementType))
            return Typed(F.flatten(F.transform(fail(v.column.isNull(), "Cannot iterate over null (null)", v.column), lambda x: F.coalesce(x, one))), T.ArrayType(e.elementType, True))
        return Typed(fail(v.column.isNull(), "Cannot iterate over null (null)", v.column), v.type)
    raise NotTyped("flatten")


def _keys(v: Typed) -> Typed:
    t = T.ArrayType(T.StringType(), True)
    if isinstance(v.type, T.MapType) and v.kind == "object":
        return Typed(F.array_sort(F.map_keys(fail(v.column.isNull(), "null (null) has no keys", v.column))), t)
    if v.column is None:
        return Typed(F.array(*(F.lit(n) for n in sorted(v.type.fieldNames()))), t)
    raise NotTyped("keys")


def _to_entries(v: Typed) -> Typed:
    if isinstance(v.type, T.MapType) and v.kind == "object":
        t = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", v.type.valueType)]))
        return Typed(F.transform(F.map_entries(fail(v.column.isNull(), "Cannot iterate over null (null)", v.column)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), t)
    raise NotTyped("to_entries")


def _string(f: Callable[[Column], Column], message: str, t: T.DataType = T.StringType()) -> Callable[[Typed], Typed]:
    return lambda v: Typed(f(given(v, message, ("string",))), t)


def _of_array(f: Callable[[Column, T.DataType], Column], message: str) -> Callable[[Typed], Typed]:
    return lambda v: Typed(f(given(v, message, ("array",)), ordered(v).elementType), v.type)


def _item(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda v: Typed(f(v.column), ordered(v).elementType)


def _is(name: str) -> Callable[[Typed], Typed]:
    def call(v: Typed) -> Typed:
        if v.kind == "other":
            raise NotTyped(name)
        there = F.lit(v.kind == name)
        if v.column is None or v.kind == "null":
            return Typed(there, T.BooleanType())
        return Typed(v.column.isNull() if name == "null" else there & v.column.isNotNull(), T.BooleanType())

    return call


def _type(v: Typed) -> Typed:
    if v.kind == "other":
        raise NotTyped("type")
    return Typed(F.lit(v.kind) if v.column is None or v.kind == "null" else F.when(v.column.isNull(), "null").otherwise(v.kind), T.StringType())


def _json(v: Typed) -> Typed:
    """JSON text of what tostring spells as JSON does, strings apart, and of arrays of it."""
    if isinstance(v.type, T.ArrayType):
        e = v.type.elementType
        if kind(e) == "string":
            raise NotTyped("tojson")
        cells = F.array_join(F.transform(v.column, lambda x: text(Typed(x, e))), ",")
        return Typed(F.coalesce(F.concat(F.lit("["), cells, F.lit("]")), F.lit("null")), T.StringType())
    if v.kind == "string":
        raise NotTyped("tojson")
    return Typed(text(v), T.StringType())


#: The seconds of the years 1 to 9999, which dates have.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799
EPOCH = "date'1970-01-01'"


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, where f names it many times: written out, such expressions nested in each other would grow without end."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _fits(name: str, v: Typed, bad: Column, c: Column) -> Column:
    """c, or the error of a function that its input does not suit, which is shown as errors show values."""
    shown = _json(v).column
    shown = F.when(F.length(shown) < 15, shown).otherwise(F.concat(F.substring(shown, 1, 11), F.lit("...")))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} cannot be applied to {v.kind} ("), shown, F.lit(")")))).otherwise(c)


def _seconds(v: Typed) -> Column:
    if not isinstance(v.type, INTEGERS):
        raise NotTyped("seconds")
    return given(v, "null (null) number required", ("number",)).cast("long")


def _date(s: Column) -> Column:
    """The day of a second, in UTC whatever the session's zone is."""
    return F.date_add(F.expr(EPOCH), ((s - F.pmod(s, F.lit(86400))) / 86400).cast("int"))


def _broken_down(name: str, v: Typed, s: Column) -> Typed:
    def parts(s: Column) -> Column:
        day, left = _date(s), F.pmod(s, F.lit(86400))
        found = [F.year(day), F.month(day) - 1, F.dayofmonth(day), F.floor(left / 3600), F.floor(F.pmod(left, F.lit(3600)) / 60), F.pmod(left, F.lit(60)), F.dayofweek(day) - 1, F.dayofyear(day) - 1]
        return F.array(*(p.cast("long") for p in found))

    return Typed(_bound(s, lambda s: _fits(name, v, ~s.between(FIRST_SECOND, LAST_SECOND), parts(s))), T.ArrayType(T.LongType(), False))


def _localtime(v: Typed) -> Typed:
    """In the zone that TZ names where the task runs, as in the interpreter."""
    zone = F.ltrim(F.coalesce(F.reflect(F.lit("java.lang.System"), F.lit("getenv"), F.lit("TZ")), F.lit("")), F.lit(":"))
    known = F.lit("\n".join(["", *sorted(zoneinfo.available_timezones() - {"Factory"}), ""]))  # one literal: hundreds would cost seconds of planning

    def shifted(s: Column) -> Column:
        there = _bound(zone, lambda z: F.when((z != "") & F.contains(known, F.concat(F.lit("\n"), z, F.lit("\n"))), F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), z))).otherwise(s))
        return F.when(s.between(FIRST_SECOND, LAST_SECOND), there).otherwise(s)

    return _broken_down("localtime", v, _bound(_seconds(v), shifted))


def _mktime(v: Typed) -> Typed:
    message = "mktime requires array of 6 numbers"
    if not isinstance(v.type, T.ArrayType) or not isinstance(v.type.elementType, INTEGERS):
        raise NotTyped("mktime")

    def seconds(c: Column) -> Column:
        bad = c.isNull() | (F.size(c) < 6)
        if v.type.containsNull:
            bad = bad | F.exists(c, lambda x: x.isNull())
        y, m, d, h, mi, s = (F.get(c, F.lit(k)).cast("long") for k in range(6))
        month = F.pmod(m, F.lit(12))
        year = y + ((m - month) / 12).cast("long")
        first = F.datediff(F.make_date(year.cast("int"), (month + 1).cast("int"), F.lit(1)), F.expr(EPOCH)).cast("long")
        return fail(bad, message, _fits("mktime", Typed(c, v.type), ~year.between(1, 9999), (first + d - 1) * 86400 + h * 3600 + mi * 60 + s))

    return Typed(_bound(v.column, seconds), T.LongType())


def _some(f: Callable[[Column, Callable[[Column], Column]], Column]) -> Callable[[Typed], Typed]:
    def call(v: Typed) -> Typed:
        c = given(v, "Cannot iterate over null (null)", ("array",))
        return Typed(f(c, lambda x: truth(Typed(x, v.type.elementType))), T.BooleanType())

    return call


def _reverse(v: Typed) -> Typed:
    if not isinstance(v.type, T.ArrayType):
        raise NotTyped("reverse")
    return Typed(F.coalesce(F.reverse(v.column), F.array().cast(v.type)), v.type)


#: Functions of the input alone.
UNARY: dict[str, Callable[[Typed], Typed]] = {
    "length": _length,
    "not": lambda v: Typed(~truth(v), T.BooleanType()),
    "type": _type,
    "floor": number_function(F.floor),
    "ceil": number_function(F.ceil),
    "round": number_function(lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)),
    "trunc": number_function(lambda c: F.signum(c) * F.floor(F.abs(c))),
    "sqrt": number_function(F.sqrt, T.DoubleType()),
    "fabs": number_function(F.abs, T.DoubleType()),
    "exp": number_function(F.exp, T.DoubleType()),
    "sin": number_function(F.sin, T.DoubleType()),
    "cos": number_function(F.cos, T.DoubleType()),
    "tan": number_function(F.tan, T.DoubleType()),
    "atan": number_function(F.atan, T.DoubleType()),
    "sinh": number_function(F.sinh, T.DoubleType()),
    "cosh": number_function(F.cosh, T.DoubleType()),
    "tanh": number_function(F.tanh, T.DoubleType()),
    "tostring": lambda v: Typed(text(v), T.StringType()),
    "utf8bytelength": lambda v: Typed(F.octet_length(given(v, "null (null) only strings have UTF-8 byte length", ("string",))).cast("long"), T.LongType()),
    "ascii_downcase": _string(lambda c: F.translate(c, UPPER, LOWER), "explode input must be a string"),
    "ascii_upcase": _string(lambda c: F.translate(c, LOWER, UPPER), "explode input must be a string"),
    "trim": _string(lambda c: F.trim(c, F.lit(SPACES)), "null (null) cannot be trimmed"),
    "ltrim": _string(lambda c: F.ltrim(c, F.lit(SPACES)), "null (null) cannot be trimmed"),
    "rtrim": _string(lambda c: F.rtrim(c, F.lit(SPACES)), "null (null) cannot be trimmed"),
    "explode": _string(lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")), "explode input must be a string", T.ArrayType(T.LongType(), True)),
    "reverse": _reverse,
    "sort": _of_array(lambda c, _: in_order(c), "null (null) cannot be sorted, as it is not an array"),
    "unique": _of_array(lambda c, _: in_order(F.array_distinct(c)), "null (null) cannot be sorted, as it is not an array"),
    "min": _item(lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.array_min(c))),
    "max": _item(F.array_max),
    "add": _add,
    "flatten": _flatten,
    "first": lambda v: element(v, 0),
    "last": lambda v: element(v, -1),
    "keys": _keys,
    "to_entries": _to_entries,
    "any": _some(F.exists),
    "all": _some(F.forall),
    "tojson": _json,
    "gmtime": lambda v: _broken_down("gmtime", v, _seconds(v)),
    "localtime": _localtime,
    "mktime": _mktime,
    "todate": lambda v: Typed(F.date_format(F.timestamp_seconds(given(v, "strftime/1 requires parsed datetime inputs", ("number",)).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), T.StringType()) if isinstance(v.type, INTEGERS) else _refuse("todate"),
} | {f"is{k}": _is(k) for k in ("null", "boolean", "number", "string", "array", "object")}


def _refuse(why: str) -> Typed:
    raise NotTyped(why)


def _on_strings(f: Callable[[Column, Column], Column], message: str, t: T.DataType) -> Callable[[Typed, Typed], Typed]:
    return lambda v, x: Typed(f(given(v, message, ("string",)), given(x, message, ("string",))), t)


def _join(v: Typed, separator: Typed) -> Typed:
    if not isinstance(v.type, T.ArrayType) or separator.kind != "string":
        raise NotTyped("join")
    e = v.type.elementType
    cells = F.transform(given(v, "Cannot iterate over null (null)", ("array",)), lambda x: F.when(x.isNull(), "").otherwise(text(Typed(x, e))))
    return Typed(F.aggregate(cells, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, separator.column, x)), lambda a: F.coalesce(a, F.lit(""))), T.StringType())


def _has(v: Typed, k: Typed) -> Typed:
    if isinstance(v.type, T.MapType) and v.kind == "object" and k.kind == "string":
        return Typed(F.map_contains_key(fail(v.column.isNull(), "Cannot check whether null has a string key", v.column), k.column), T.BooleanType())
    if isinstance(v.type, T.ArrayType) and isinstance(k.type, INTEGERS):
        return Typed((k.column >= 0) & (k.column < F.size(fail(v.column.isNull(), "Cannot check whether null has a number key", v.column))), T.BooleanType())
    raise NotTyped("has")


def _trimmed(starts: bool) -> Callable[[Typed, Typed], Typed]:
    def call(v: Typed, x: Typed) -> Typed:
        if v.kind != "string" or x.kind != "string":
            raise NotTyped("trimstr")
        c, s = v.column, x.column
        fits = F.startswith(c, s) if starts else F.endswith(c, s)
        rest = F.substring(c, F.length(s) + 1, F.length(c)) if starts else F.substring(c, F.lit(1), F.length(c) - F.length(s))
        return Typed(F.when(fits & (s != ""), rest).otherwise(c), T.StringType())

    return call


#: Functions of the input and one argument.
BINARY: dict[str, Callable[[Typed, Typed], Typed]] = {
    "startswith": _on_strings(F.startswith, "startswith() requires string inputs", T.BooleanType()),
    "endswith": _on_strings(F.endswith, "endswith() requires string inputs", T.BooleanType()),
    "contains": _on_strings(F.contains, "null (null) and string cannot have their containment checked", T.BooleanType()),
    "split": lambda v, x: split(Typed(given(v, "split input and separator must be strings", ("string",)), v.type), Typed(given(x, "split input and separator must be strings", ("string",)), x.type)),
    "join": _join,
    "has": _has,
    "ltrimstr": _trimmed(True),
    "rtrimstr": _trimmed(False),
}


def _pattern(e: tuple) -> str:
    if e[0] == "literal" and isinstance(e[1], str) and PLAIN_PATTERN.fullmatch(e[1]):
        return e[1]
    raise NotTyped("pattern")


def value(e: tuple, here: Typed, scope: Scope) -> Typed:  # noqa: C901, PLR0911, PLR0912
    """The only output of a filter."""
    match e:
        case ("identity",):
            return here
        case ("literal", x):
            return literal(x)
        case ("var", name) if name in scope:
            return scope[name]
        case ("pipe", a, b):
            return value(b, value(a, here, scope), scope)
        case ("as", a, [("var", name)], body):
            return value(body, here, {**scope, name: value(a, here, scope)})
        case ("index", a, ("literal", str(k))):
            return field(value(a, here, scope), k)
        case ("index", a, ("literal", int(k))) if not isinstance(k, bool):
            return element(value(a, here, scope), k)
        case ("index", a, ("negate", ("literal", int(k)))):
            return element(value(a, here, scope), -k)
        case ("slice", a, lo, hi):
            return sliced(value(a, here, scope), *(None if x is None else _integer(x) for x in (lo, hi)))
        case ("negate", a):
            v = value(a, here, scope)
            t = T.LongType() if isinstance(v.type, INTEGERS) else T.DoubleType()
            return Typed(-given(v, "null (null) cannot be negated", ("number",)).cast(t), t)
        case ("binary", op, a, b):
            x, y = value(a, here, scope), value(b, here, scope)
            return arithmetic(op, x, y) if op in WORDS else Typed(F.coalesce(compare(op, x, y), F.lit(False)), T.BooleanType())
        case ("and" | "or" as op, a, b):
            x, y = truth(value(a, here, scope)), truth(value(b, here, scope))
            return Typed(x & y if op == "and" else x | y, T.BooleanType())
        case ("//", a, b):
            x = value(a, here, scope)
            (p, q), t = common([x, value(b, here, scope)])
            return Typed(F.when(truth(x), p).otherwise(q), t)
        case ("if", c, a, b):
            (p, q), t = common([value(a, here, scope), value(b, here, scope)])
            return Typed(F.when(truth(value(c, here, scope)), p).otherwise(q), t)
        case ("object", items):
            return built(items, here, scope)
        case ("collect", ("comma", _, _) as many):
            return collected([value(x, here, scope) for x in listed(many)])
        case ("collect", ("pipe", ("iterate", a), body)):
            return value(("call", "map", [body]), value(a, here, scope), scope)
        case ("collect", ("iterate", a)):
            v = value(a, here, scope)
            return Typed(given(v, "Cannot iterate over null (null)", ("array",)), v.type)
        case ("string", parts, None):
            return Typed(F.concat(*(F.lit(p) if isinstance(p, str) else text(value(p, here, scope)) for p in parts)), T.StringType())
        case ("call", name, []) if name in UNARY:
            return UNARY[name](here)
        case ("call", "test", [p]):
            return Typed(F.regexp_like(given(here, "null (null) cannot be matched, as it is not a string", ("string",)), F.lit(_pattern(p))), T.BooleanType())
        case ("call", name, [arg]) if name in BINARY:
            return BINARY[name](here, value(arg, here, scope))
        case ("call", "map", [("call", "select", [c])]):
            return mapped(here, True, c, scope)
        case ("call", "map", [("pipe", ("call", "select", [_]) as first, rest)]):
            return value(("call", "map", [rest]), value(("call", "map", [first]), here, scope), scope)
        case ("call", "map", [f]):
            return mapped(here, False, f, scope)
        case ("call", "any" | "all" as name, [f]):
            return UNARY[name](mapped(here, False, f, scope))
        case ("call", "pow", [a, b]):
            x, y = (given(value(v, here, scope), "null (null) number required", ("number",)).cast("double") for v in (a, b))
            return Typed(F.pow(x, y), T.DoubleType())
        case ("call", "atan2", [a, b]):
            x, y = (given(value(v, here, scope), "null (null) number required", ("number",)).cast("double") for v in (a, b))
            return Typed(F.atan2(x, y), T.DoubleType())
    raise NotTyped(e)


def listed(e: tuple) -> list[tuple]:
    """The parts of a comma."""
    return [*listed(e[1]), *listed(e[2])] if e[0] == "comma" else [e]


def _integer(e: tuple) -> int:
    match e:
        case ("literal", int(k)) if not isinstance(k, bool):
            return k
        case ("negate", ("literal", int(k))):
            return -k
    raise NotTyped(e)


def mapped(v: Typed, take: bool, f: tuple, scope: Scope) -> Typed:
    if not isinstance(v.type, T.ArrayType):
        raise NotTyped("map")
    c, kinds = given(v, "Cannot iterate over null (null)", ("array",)), []

    def inner(x: Column) -> Column:
        out = value(f, Typed(x, v.type.elementType), scope)
        kinds.append(out.type)
        return truth(out) if take else whole(out)

    out = F.filter(c, inner) if take else F.transform(c, inner)
    return Typed(out, v.type if take else T.ArrayType(kinds[-1], True))


def sliced(v: Typed, lo: int | None, hi: int | None) -> Typed:
    if v.kind not in ("array", "string") or v.column is None:
        raise NotTyped("slice")
    size = F.size(v.column) if v.kind == "array" else F.length(v.column)

    def bound(k: int | None, default: Column) -> Column:
        return default if k is None else F.least(F.lit(k), size) if k >= 0 else F.greatest(size + k, F.lit(0))

    start, stop = bound(lo, F.lit(0)), bound(hi, size)
    n = F.greatest(stop - start, F.lit(0))
    c = F.slice(v.column, start + 1, n) if v.kind == "array" else F.substring(v.column, start + 1, n)
    return Typed(F.when(v.column.isNotNull(), c), v.type)


def built(items: list[tuple], here: Typed, scope: Scope) -> Typed:
    """An object with known keys; a key that comes again keeps its place and takes the last value."""
    fields: dict[str, Typed] = {}
    for k, e in items:
        if k[0] != "literal" or not isinstance(k[1], str):
            raise NotTyped(k)
        fields[k[1]] = value(e, here, scope)
    if not fields:
        raise NotTyped("{}")
    return Typed(F.struct(*(whole(v).alias(k) for k, v in fields.items())), T.StructType([T.StructField(k, v.type, True) for k, v in fields.items()]))


def predicate(e: tuple, here: Typed, scope: Scope) -> Column:
    """A condition for a filter, where null counts as false: in this form it reaches the scan."""
    match e:
        case ("and", a, b):
            return predicate(a, here, scope) & predicate(b, here, scope)
        case ("or", a, b):
            return predicate(a, here, scope) | predicate(b, here, scope)
        case ("binary", "==" | "!=" | "<" | "<=" | ">" | ">=" as op, a, b):
            return compare(op, value(a, here, scope), value(b, here, scope))
    return truth(value(e, here, scope))
