"""Filters over whole tables as plans: a table is the array of its rows.

`.[]`, map and select become projections and filters, group_by an aggregation, sort_by with a slice a top-k, foreach over sorted rows
a window, `.[] as $x | $t[] | select(p)` a join, IN(s) a semi join, INDEX a lookup join and last($t[] | select(...)) an
as-of join. A table has no order of its own: what depends on it needs sort_by first, and ties
are broken by the remaining columns. What has no such form raises NotTyped.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational as R
from .parser import parse
from .typed import FLOATS, INTEGERS, NotTyped, Scope, Typed, collected, kind, listed, literal, predicate, truth, value, whole

IDENTITY = ("identity",)


@dataclass
class State:
    """What a stage works on: rows of df, each a struct or a single column `value`; as the array of them, or one by one."""

    df: DataFrame
    here: Typed
    array: bool
    tables: Mapping[str, DataFrame]
    scope: Scope = field(default_factory=dict)
    order: list[Order] = field(default_factory=list)
    #: Keys, if rows are in groups: name in df, filter, type.
    groups: list[tuple[str, tuple, T.DataType]] | None = None
    indexes: Mapping[str, tuple[DataFrame, tuple]] = field(default_factory=dict)
    #: Whether the value is one row of all, and so not an array.
    single: bool = False


def rows_of(df: DataFrame, names: Mapping[str, str] | None = None) -> Typed:
    return Typed(None, T.StructType([T.StructField(k, df.schema[v].dataType) for k, v in names.items()]) if names else df.schema, names)


def stages(e: tuple) -> list[tuple]:
    return [*stages(e[1]), *stages(e[2])] if e[0] == "pipe" else [e]


def compile_filter(df: DataFrame, program: str, **tables: DataFrame) -> DataFrame:
    """The plan of a filter whose input is the array of df's rows; `.[]` may be left out before what only rows can be the input of.

    Each output is a row: an object's fields as columns, any other value as the column `value`. $name is the array of the rows of tables[name].
    """
    state = State(df, rows_of(df), True, tables)
    for s in stages(parse(program)):
        state = stage(s, state)
    return result(state)


def result(state: State) -> DataFrame:
    if state.groups is not None:
        raise NotTyped("groups as a result")
    df = state.df.orderBy(*spark(state.order)) if state.order else state.df
    if state.here.column is not None:
        return df.select(state.here.column.alias("value"))
    return df.select(*(F.col(f"`{(state.here.names or {}).get(f.name, f.name)}`").alias(f.name) for f in state.here.type.fields))


def stage(e: tuple, s: State) -> State:  # noqa: C901, PLR0911, PLR0912
    if s.groups is not None:
        return grouped_stage(e, s)
    if not s.array:
        return row_stage(e, s)
    match e:
        case ("identity",):
            return s
        case ("iterate", ("identity",)):
            return replace(s, array=False)
        case ("collect", inner):
            for x in stages(inner):
                s = stage(x, s)
            return replace(s, array=True)
        case ("call", "map", [f]):
            s = replace(s, array=False)
            for x in stages(f):
                s = stage(x, s)
            return replace(s, array=True)
        case ("call", "sort_by", [keys]):
            return replace(s, order=[*orders(keys, s), *s.order])
        case ("call", "sort", []) if s.here.column is not None:
            return replace(s, order=[Order(s.here.column)])
        case ("call", "group_by", [keys]):
            return grouped(keys, s)
        case ("call", "unique_by", [keys]):
            return first_of(grouped(keys, s), ties(s))
        case ("call", "unique", []):
            return replace(s, df=result(replace(s, order=[])).distinct(), here=kept(s.here), order=[])
        case ("call", "min_by" | "max_by" as name, [key]):
            down = name == "max_by"
            return replace(first_of(replace(s, groups=[]), [Order(c, down) for c in key_columns(key, s)] + ties(s, down)), array=False, single=True)
        case ("slice", ("identity",), lo, hi):
            return limited(s, literal_int(lo) or 0, literal_int(hi))
        case ("index", ("identity",), ("literal", int(k))):
            return replace(limited(s, k, k + 1), array=False, single=True)
        case ("call", "first", []):
            return stage(("index", IDENTITY, ("literal", 0)), s)
        case ("call", "last", []):
            return stage(("index", IDENTITY, ("literal", 0)), replace(s, order=[o.flipped() for o in needed(s)]))
        case ("call", "first" | "last" as name, [("iterate", ("identity",))]):
            return stage(("call", name, []), s)
        case ("call", "limit", [n, inner]) | ("call", "nth" | "skip", [n, inner]):
            k = literal_int(n)
            s = stage(inner, s) if inner[0] != "pipe" else stage(("collect", inner), s)
            return replace(limited(s, *{"limit": (0, k), "skip": (k, None), "nth": (k, k + 1)}[e[1]]), array=False)
        case ("call", "length" | "add" | "min" | "max" | "any" | "all", []) | ("call", "any" | "all" | "add", [_]) | ("call", "any" | "all", [_, _]) | ("reduce", ("iterate", ("identity",)), [("var", _)], _, _, _):
            aggregates: dict[str, tuple[Column, T.DataType]] = {}
            f = rewritten(e, s, aggregates)
            df = s.df.agg(*(c.alias(n) for n, (c, _) in aggregates.items()))
            return finished(df, value(f, literal(None), {**s.scope, **bound(aggregates)}), s)
        case ("foreach", ("iterate", ("identity",)), [("var", name)], init, update, extract):
            return running(s, name, init, update, extract, [])
        case ("call", "to_entries", []):
            spot = F.row_number().over(Window.orderBy(*spark(needed(s)))).cast("long") - 1
            df = s.df.select(spot.alias("key"), whole(s.here).alias("value"))
            return replace(s, df=df, here=rows_of(df), order=[])
        case ("binary", "+" | "-" as op, left, right):
            return algebra(op, left, right, s)
        case ("as", ("pipe", ("var", t), ("call", "INDEX", [key])), [("var", name)], body) if t in s.tables:
            s = replace(s, indexes={**s.indexes, name: (s.tables[t], key)})
            for x in stages(body):
                s = stage(x, s)
            return s
        case ("as", ("iterate", ("identity",)), [("var", name)], body):
            return bind(name, body, replace(s, array=False))
        case ("iterate", inner) if inner[0] in ("call", "slice", "collect"):
            return stage(("iterate", IDENTITY), stage(inner, s))
        case ("var", t) if t in s.tables:
            return replace(s, df=s.tables[t], here=rows_of(s.tables[t]), order=[])
    return row_stage(e, replace(s, array=False))


def kept(here: Typed) -> Typed:
    """The row after result() has given columns their names."""
    return Typed(None, here.type) if here.column is None else Typed(F.col("value"), here.type)


def finished(df: DataFrame, v: Typed, s: State) -> State:
    """A single value."""
    if isinstance(v.type, T.StructType):
        df = df.select(whole(v).alias("_v")).select("_v.*")
        return replace(s, df=df, here=rows_of(df), order=[], array=False, single=True)
    df = df.select(whole(v).alias("value"))
    return replace(s, df=df, here=Typed(F.col("value"), v.type), order=[], array=False, single=True)


def projected(s: State, v: Typed) -> State:
    """Rows with a new value each; the order's columns go along under names of their own."""
    extra = [o.column.alias(f"_o{k}") for k, o in enumerate(s.order)]
    order = [Order(F.col(f"_o{k}"), o.down) for k, o in enumerate(s.order)]
    if isinstance(v.type, T.StructType):
        inner = v.column
        if inner is None:
            return s
        df = s.df.select(inner.alias("_v"), *extra).select(*(F.col(f"_v.`{f.name}`").alias(f.name) for f in v.type.fields), *(f"_o{k}" for k in range(len(extra))))
        return replace(s, df=df, here=Typed(None, v.type), order=order)
    df = s.df.select(whole(v).alias("value"), *extra)
    return replace(s, df=df, here=Typed(F.col("value"), v.type), order=order)


@dataclass(frozen=True)
class Order:
    """A sort key; null is least."""

    column: Column
    down: bool = False

    def flipped(self) -> Order:
        return Order(self.column, not self.down)


def spark(order: list[Order]) -> list[Column]:
    return [o.column.desc_nulls_last() if o.down else o.column.asc_nulls_first() for o in order]


def orders(keys: tuple, s: State) -> list[Order]:
    out = []
    for k in listed(keys):
        down = k[0] == "negate"
        v = value(k[1] if down else k, s.here, s.scope)
        if down and v.kind != "number":
            raise NotTyped("descending")
        out.append(Order(whole(v), down))
    return out


def key_columns(keys: tuple, s: State) -> list[Column]:
    return [-o.column if o.down else o.column for o in orders(keys, s)]


def ties(s: State, down: bool = False) -> list[Order]:
    """The order that decides between rows with equal keys: sort_by's, or that of all columns that have one."""
    if s.order:
        return [o.flipped() if down else o for o in s.order]
    names = [(s.here.names or {}).get(f.name, f.name) for f in s.here.type.fields if not isinstance(f.dataType, T.MapType)] if s.here.column is None else []
    return [Order(F.col(f"`{n}`"), down) for n in names]


def needed(s: State) -> list[Order]:
    if not s.order:
        raise NotTyped("a table has no order")
    return s.order


def literal_int(e: tuple | None) -> int | None:
    if e is None:
        return None
    if e[0] == "literal" and isinstance(e[1], int) and e[1] >= 0:
        return e[1]
    raise NotTyped(e)


def limited(s: State, start: int, stop: int | None) -> State:
    df = s.df.orderBy(*spark(needed(s)))
    df = df.offset(start) if start else df
    return replace(s, df=df if stop is None else df.limit(max(0, stop - start)))


def row_stage(e: tuple, s: State) -> State:  # noqa: C901, PLR0911
    match e:
        case ("identity",):
            return s
        case ("call", "select", [c]):
            return selected(c, s)
        case ("as", ("identity",), [("var", name)], body):
            return bind(name, body, s)
        case ("as", f, [("var", name)], body) if f[0] != "iterate":
            scope = {**s.scope, name: value(f, s.here, s.scope)}
            s = replace(s, scope=scope)
            for x in stages(body):
                s = stage(x, s)
            return s
        case ("assign", op, ("index", ("identity",), ("literal", str(name))), f):
            return assigned(op, name, f, s)
        case ("call", "del", [targets]) if s.here.column is None:
            names = [t[2][1] for t in listed(targets) if t[0] == "index" and t[1] == IDENTITY and t[2][0] == "literal"]
            if len(names) != len(listed(targets)):
                raise NotTyped(e)
            return projected(s, struct_of({f.name: value(("index", IDENTITY, ("literal", f.name)), s.here, {}) for f in s.here.type.fields if f.name not in names}))
        case ("call", "empty", []):
            return replace(s, df=s.df.filter(F.lit(False)))
        case ("iterate", inner):
            v = value(inner, s.here, s.scope)
            if not isinstance(v.type, T.ArrayType):
                raise NotTyped(e)
            error = F.when(v.column.isNull(), F.raise_error(F.lit("Cannot iterate over null (null)"))).otherwise(v.column)
            df = s.df.select(*s.df.columns, F.explode(error).alias("_item"))
            item = Typed(F.col("_item"), v.type.elementType)
            return projected(replace(s, df=df), item) if not s.scope else replace(s, df=df, here=item)
        case ("comma", _, _):
            vs = [value(x, s.here, s.scope) for x in listed(e)]
            many = collected(vs) if all(v.kind != "object" for v in vs) else Typed(F.array(*(whole(v) for v in vs)), T.ArrayType(vs[0].type))
            return row_stage(("iterate", ("var", "*many")), replace(s, scope={**s.scope, "*many": many}))
        case ("object", items) if any(v[0] == "iterate" for _, v in items):
            (k, many), *more = [(k, v) for k, v in items if v[0] == "iterate"]
            if more:
                raise NotTyped(e)
            v = value(many[1], s.here, s.scope)
            df = s.df.select(*s.df.columns, F.explode(v.column).alias("_item"))
            scope = {**s.scope, "*item": Typed(F.col("_item"), v.type.elementType)}
            return row_stage(("object", [(n, ("var", "*item") if x is many else x) for n, x in items]), replace(s, df=df, scope=scope))
    e, s = looked_up(e, s)
    return projected(s, value(e, s.here, s.scope))


def struct_of(fields: dict[str, Typed]) -> Typed:
    return Typed(F.struct(*(whole(v).alias(k) for k, v in fields.items())), T.StructType([T.StructField(k, v.type, True) for k, v in fields.items()]))


def assigned(op: str, name: str, f: tuple, s: State) -> State:
    if s.here.column is not None:
        raise NotTyped("assignment")
    target = ("index", IDENTITY, ("literal", name))
    match op:
        case "=":
            new = value(f, s.here, s.scope)
        case "|=":
            new = value(f, value(target, s.here, s.scope), s.scope)
        case "//=":
            new = value(("//", target, f), s.here, s.scope)
        case _:
            new = value(("binary", op[0], target, f), s.here, s.scope)
    fields = {x.name: value(("index", IDENTITY, ("literal", x.name)), s.here, {}) for x in s.here.type.fields}
    return projected(s, struct_of(fields | {name: new}))


def selected(c: tuple, s: State) -> State:
    match c:
        case ("call", "IN", [source]):
            return member(IDENTITY, source, s, "left_semi")
        case ("call", "IN", [f, source]):
            return member(f, source, s, "left_semi")
        case ("pipe", ("call", "IN", [f, source]), ("call", "not", [])):
            return member(f, source, s, "left_anti")
    c, s = looked_up(c, s)
    return replace(s, df=s.df.filter(predicate(c, s.here, s.scope)))


def member(f: tuple, source: tuple, s: State, how: str) -> State:
    """IN(f; source) as a semi or anti join, where null equals null."""
    parts = stages(source)
    if parts[0][0] != "iterate" or parts[0][1][0] != "var" or parts[0][1][1] not in s.tables:
        raise NotTyped(source)
    t = s.tables[parts[0][1][1]]
    other = State(t, rows_of(t), False, s.tables)
    for x in parts[1:]:
        other = stage(x, other)
    known = result(other).toDF("_known")
    v = value(f, s.here, s.scope)
    if v.kind != kind(known.schema[0].dataType):
        raise NotTyped("IN")
    return replace(s, df=s.df.join(known, whole(v).eqNullSafe(F.col("_known")), how))


def bind(name: str, body: tuple, s: State) -> State:
    """`. as $name | ...`; followed by `$t[] | select(p)`, a join."""
    parts = stages(body)
    if parts[0][0] == "iterate" and parts[0][1][0] == "var" and parts[0][1][1] in s.tables:
        return joined(name, s.tables[parts[0][1][1]], parts[1:], s)
    s = replace(s, scope={**s.scope, name: s.here})
    for x in parts:
        s = stage(x, s)
    return s


def prefixed(df: DataFrame, here: Typed, prefix: str, carried: list[str]) -> tuple[DataFrame, Typed, dict[str, str]]:
    renamed = {c: f"{prefix}{k}" for k, c in enumerate(df.columns) if c not in carried}
    names = {f.name: renamed.get((here.names or {}).get(f.name, f.name), (here.names or {}).get(f.name, f.name)) for f in here.type.fields}
    return df.withColumnsRenamed(renamed), replace(here, names=names), renamed


def joined(name: str, right: DataFrame, rest: list[tuple], s: State) -> State:
    if s.here.column is not None or s.scope and any(v.column is not None for v in s.scope.values()):
        raise NotTyped("join")
    n = len(s.scope)
    carried = [c for c in s.df.columns if c.startswith("_j")]
    df, here, _ = prefixed(s.df, s.here, f"_j{n}l", carried)
    other, there, _ = prefixed(right, rows_of(right), f"_j{n}r", [])
    scope = {**s.scope, name: here}
    if rest and rest[0][0] == "call" and rest[0][1] == "select":
        df = df.join(other, predicate(rest[0][2][0], there, scope), "inner")
        rest = rest[1:]
    else:
        df = df.crossJoin(other)
    s = replace(s, df=df, here=there, scope=scope, order=[])
    if rest and rest[0][0] == "as" and rest[0][1] == IDENTITY:
        return bind(rest[0][2][0][1], rest[0][3], s)
    for x in rest:
        s = stage(x, s)
    return s


def parts_of(e: object) -> Iterator[tuple]:
    """All filters within a filter, itself first."""
    if isinstance(e, tuple) and e and isinstance(e[0], str):
        yield e
    if isinstance(e, (tuple, list)):
        for x in e:
            yield from parts_of(x)


def replaced(e: object, what: tuple, by: tuple) -> object:
    if e == what:
        return by
    if isinstance(e, tuple):
        return tuple(replaced(x, what, by) for x in e)
    return [replaced(x, what, by) for x in e] if isinstance(e, list) else e


def looked_up(e: tuple, s: State) -> tuple[tuple, State]:
    """Lookups in an index and last($t[] | select(...)) within a row's filter become joins, whose rows are variables of the filter that is left."""
    for x in list(parts_of(e)):
        match x:
            case ("index", ("var", name), key) if name in s.indexes:
                table, by = s.indexes[name]
                k = f"_i{len(s.scope)}"
                there = rows_of(table)
                last = table.select(whole(text_key(value(by, there, {}))).alias(f"{k}k"), whole(there).alias(f"{k}v")).groupBy(f"{k}k").agg(F.max(f"{k}v").alias(f"{k}v"))
                df = s.df.join(last, whole(value(key, s.here, s.scope)) == F.col(f"{k}k"), "left").drop(f"{k}k")
                s = replace(s, df=df, scope={**s.scope, k: Typed(F.col(f"{k}v"), there.type)})
                e = replaced(e, x, ("var", k))
            case ("call", "last", [("pipe", ("iterate", ("var", t)), more)]) if t in s.tables:
                k = f"_i{len(s.scope)}"
                found, s = last_before(s.tables[t], stages(more), k, s)
                s = replace(s, scope={**s.scope, k: found})
                e = replaced(e, x, ("var", k))
    return e, s


def text_key(v: Typed) -> Typed:
    return value(("call", "tostring", []), v, {})


def last_before(right: DataFrame, rest: list[tuple], k: str, s: State) -> tuple[Typed, State]:
    """The last row of another table with equal keys and a time not after this row's, as one sort of both."""
    if not rest or rest[0][:2] != ("call", "select"):
        raise NotTyped("last")
    terms, todo = [], [rest[0][2][0]]
    while todo:
        c = todo.pop()
        if c[0] == "and":
            todo += [c[2], c[1]]
        else:
            terms.append(c)
    there = rows_of(right)
    keys, at = [], []
    for c in terms:
        if c[0] != "binary" or c[1] not in ("==", "<="):
            raise NotTyped(c)
        (at if c[1] == "<=" else keys).append((whole(value(c[2], there, {})), whole(value(c[3], s.here, s.scope))))
    if len(at) != 1:
        raise NotTyped("last")
    own = s.df.withColumns({f"{k}q{n}": b for n, (_, b) in enumerate([*keys, at[0]])})
    other = right.select(*(a.alias(f"{k}q{n}") for n, (a, _) in enumerate([*keys, at[0]])), whole(there).alias(f"{k}v"))
    names = [f"{k}q{n}" for n in range(len(keys))]
    df = R.as_of(own, other, names, f"{k}q{len(keys)}", [f"{k}v"]).withColumnRenamed(f"right_{k}v", f"{k}v").drop(*names, f"{k}q{len(keys)}")
    found = Typed(F.col(f"{k}v"), there.type)
    for x in rest[1:]:
        found = value(x, found, {})
    return found, replace(s, df=df)


def algebra(op: str, left: tuple, right: tuple, s: State) -> State:
    """Arrays of tables: + puts one after the other, - leaves out every row that the other has, . - (. - $b) what both have."""

    def rows(e: tuple) -> State:
        out = s
        for x in stages(e):
            out = stage(x, out)
        return replace(out, array=True)

    a = rows(left)
    match right:
        case ("binary", "-", same, other) if op == "-" and same == left:
            how, b = "left_semi", rows(other)
        case _:
            how, b = "left_anti", rows(right)
    x, y = result(replace(a, order=[])), result(replace(b, order=[]))
    if [f.name for f in x.schema] != [f.name for f in y.schema] or [kind(f.dataType) for f in x.schema] != [kind(f.dataType) for f in y.schema]:
        raise NotTyped("rows of two kinds")
    if op == "+":
        df = x.unionAll(y)
    else:
        y = y.toDF(*(f"_r{k}" for k in range(len(y.columns))))
        same = F.lit(True)
        for k, c in enumerate(x.columns):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_r{k}"))
        df = x.join(y, same, how)
    return replace(s, df=df, here=kept(a.here), order=[], array=True)


# Groups.


def grouped(keys: tuple, s: State) -> State:
    """The keys as columns of their own; equal NaN are one group in Spark, so floating point keys are left to the interpreter."""
    names = []
    df = s.df
    for k, e in enumerate(listed(keys[1] if keys[0] == "collect" else keys)):
        v = value(e, s.here, s.scope)
        if isinstance(v.type, FLOATS) or v.kind in ("array", "object"):
            raise NotTyped("key")
        df = df.withColumn(f"_k{k}", whole(v))
        names.append((f"_k{k}", e, v.type))
    return replace(s, df=df, groups=names)


def first_of(s: State, order: list[Order]) -> State:
    """The first row of each group."""
    keys = [n for n, _, _ in s.groups or []]
    columns = [c for c in s.df.columns if c not in keys]
    out = [Order(F.col(n)) for n in keys]
    if not keys:
        df = s.df.orderBy(*spark(order)).limit(1)
    elif len({o.down for o in order}) == 1:
        # A minimum or maximum: tasks combine before they send. A struct's order puts nulls first, as the language does.
        best = F.max_by if order[0].down else F.min_by
        df = s.df.groupBy(*keys).agg(best(F.struct(*columns), F.struct(*(o.column for o in order))).alias("_row")).select(*keys, "_row.*")
    else:
        df = R.top_k(s.df, keys, spark(order), 1)
    return replace(s, df=df, groups=None, order=out, array=True)


def grouped_stage(e: tuple, s: State) -> State:  # noqa: C901, PLR0911
    keys = [n for n, _, _ in s.groups]
    by_keys = [Order(F.col(n)) for n in keys]
    match e:
        case ("iterate", ("identity",)) | ("identity",):
            return s
        case ("call", "length", []):
            return stage(e, replace(s, df=s.df.select(*keys).distinct(), groups=None))
        case ("call", "map", [f]) | ("collect", ("pipe", ("iterate", ("identity",)), f)):
            pass
        case ("foreach", ("iterate", ("identity",)), [("var", name)], init, update, extract):
            return running(replace(s, groups=None), name, init, update, extract, keys)
        case ("call", "sort_by", [k]):
            return replace(s, order=orders(k, s))
        case ("call", "add" | "flatten", []) | ("iterate", ("iterate", ("identity",))):
            return replace(s, groups=None, array=e[0] == "call")
        case f:
            pass
    inner = stages(f)
    match inner:
        case [("call", "sort_by", [k]), ("slice", ("identity",), None, ("literal", int(n)))]:
            # Spark's group limit keeps n rows of a key in each task before the shuffle.
            df = R.top_k(s.df, keys, spark([*orders(k, s), *s.order]), n)
            return replace(s, df=df)
        case [("call", "sort_by", [k]), ("index", ("identity",), ("literal", 0))]:
            return first_of(s, [*orders(k, s), *s.order])
        case [("call", "min_by", [k])]:
            return first_of(s, [*(Order(c) for c in key_columns(k, s)), *ties(s)])
        case [("call", "max_by", [k])]:
            return first_of(s, [*(Order(c, True) for c in key_columns(k, s)), *ties(s, True)])
        case [("index", ("identity",), ("literal", 0))] | [("call", "first", [])]:
            return first_of(s, ties(s))
        case [("call", "sort_by", [k]), ("foreach", ("iterate", ("identity",)), [("var", name)], init, update, extract)]:
            return running(replace(s, groups=None, order=orders(k, s)), name, init, update, extract, keys)
        case [("call", "select", [c])]:
            aggregates: dict[str, tuple[Column, T.DataType]] = {}
            c = rewritten(c, s, aggregates)
            df = s.df.groupBy(*keys).agg(*(x.alias(n) for n, (x, _) in aggregates.items()))
            some = df.filter(predicate(c, literal(None), {**s.scope, **bound(aggregates), **key_values(s)})).select(*(F.col(k).alias(f"{k}g") for k in keys))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"{k}g"))
            return replace(s, df=s.df.join(some, same, "left_semi"))
    aggregates = {}
    f = rewritten(f, s, aggregates)
    df = s.df.groupBy(*keys).agg(*(x.alias(n) for n, (x, _) in aggregates.items())) if aggregates else s.df.select(*keys).distinct()
    return projected(replace(s, df=df, groups=None, array=True, order=by_keys), value(f, literal(None), {**s.scope, **bound(aggregates), **key_values(s)}))


def bound(aggregates: dict[str, tuple[Column, T.DataType]]) -> dict[str, Typed]:
    return {n: Typed(F.col(n), t) for n, (_, t) in aggregates.items()}


def key_values(s: State) -> dict[str, Typed]:
    return {n: Typed(F.col(n), t) for n, _, t in s.groups or []}


@dataclass
class Bag:
    """The values that a group's rows have for a filter, of the rows that fit a condition."""

    value: Typed
    condition: Column | None = None
    distinct: bool = False
    sorted: bool = False

    def column(self) -> Column:
        c = whole(self.value)
        return c if self.condition is None else F.when(self.condition, c)

    def only(self, c: Column) -> Column:
        return c if self.condition is None else F.when(self.condition, c)


def rewritten(e: tuple, s: State, aggregates: dict[str, tuple[Column, T.DataType]]) -> tuple:
    """A filter on a group with what it aggregates as variables; keys are variables too."""
    for name, key, _ in s.groups or []:
        if e == keyed(key):
            return ("var", name)
    if (found := aggregate(e, s)) is not None:
        name = f"_a{len(aggregates)}"
        aggregates[name] = found
        return ("var", name)
    if e[0] == "object":
        return ("object", [(k, rewritten(v, s, aggregates)) for k, v in e[1]])
    parts = stages(e)
    for n in range(len(parts) - 1, 0, -1):
        if (found := aggregate(join_stages(parts[:n]), s)) is not None:
            name = f"_a{len(aggregates)}"
            aggregates[name] = found
            return ("pipe", ("var", name), join_stages(parts[n:]))
    if e[0] == "pipe":
        return ("pipe", rewritten(parts[0], s, aggregates), join_stages(parts[1:]))
    if e[0] in ("literal", "var"):
        return e
    if e[0] in ("binary", "and", "or", "//", "if", "negate", "collect", "comma", "string"):
        return tuple([rewritten(y, s, aggregates) if isinstance(y, tuple) else y for y in x] if isinstance(x, list) else rewritten(x, s, aggregates) if isinstance(x, tuple) else x for x in e)
    raise NotTyped(e)


def keyed(key: tuple) -> tuple:
    """How a filter on a group spells its key: `.[0].a` for `.a`."""
    if key[0] == "index":
        return ("index", keyed(key[1]), key[2])
    if key == IDENTITY:
        return ("index", IDENTITY, ("literal", 0))
    return ("pipe", ("index", IDENTITY, ("literal", 0)), key)


def aggregate(e: tuple, s: State) -> tuple[Column, T.DataType] | None:  # noqa: C901, PLR0911
    """The aggregate of a group's rows that a filter stands for, if it is one."""
    match e:
        case ("call", "length", []):
            return F.count(F.lit(1)), T.LongType()
        case ("call", "any" | "all" as name, [c]) | ("call", "any" | "all" as name, [("iterate", ("identity",)), c]):
            t = truth(value(c, s.here, s.scope))
            return F.coalesce((F.bool_or if name == "any" else F.bool_and)(t), F.lit(name == "all")), T.BooleanType()
        case ("call", "add", [f]):
            return aggregate(("pipe", ("call", "map", [f[2] if f[0] == "pipe" and f[1] == ("iterate", IDENTITY) else f]), ("call", "add", [])), s)
        case ("call", "add" | "min" | "max" | "any" | "all", []) if s.here.column is not None:
            return of_bag(Bag(s.here), e[1])
        case ("reduce", ("iterate", ("identity",)), [("var", x)], ("literal", init), ("binary", "+", ("identity",), f), None) if isinstance(init, (int, float)):
            v = value(f, literal(None), {**s.scope, x: s.here})
            c, t = of_bag(Bag(v), "add")
            return F.coalesce(c, F.lit(0).cast(t)) + F.lit(init).cast(t), t
        case ("pipe", _, _):
            parts = stages(e)
        case _:
            return None
    match parts:
        case [("call", "min_by" | "max_by" as name, [k]), *rest]:
            row = value(join_stages(rest), s.here, s.scope)
            down = name == "max_by"
            keys = [whole(value(x, s.here, s.scope)) for x in listed(k)] + [o.column for o in ties(s)]
            return (F.max_by if down else F.min_by)(whole(row), F.struct(*keys)), row.type
        case [("call", "sort_by", [k]), ("index", ("identity",), ("literal", 0)) | ("call", "first", []), *rest]:
            row = value(join_stages(rest), s.here, s.scope)
            return F.min_by(whole(row), F.struct(*key_columns(k, s), *(o.column for o in ties(s)))), row.type
        case [("call", "sort_by", [k]), ("call", "map", [f]), ("call", "join", [("literal", str(sep))])]:
            v = value(f, s.here, s.scope)
            if v.kind != "string":
                raise NotTyped(e)
            pairs = F.array_sort(F.collect_list(F.struct(F.struct(*key_columns(k, s)).alias("k"), whole(v).alias("v"))))
            return F.array_join(F.transform(pairs, lambda p: F.coalesce(p["v"], F.lit(""))), sep), T.StringType()
        case [("call", "sort_by", [k]), ("call", "map", [f])]:
            v = value(f, s.here, s.scope)
            pairs = F.array_sort(F.collect_list(F.struct(F.struct(*key_columns(k, s)).alias("k"), whole(v).alias("v"))))
            return F.transform(pairs, lambda p: p["v"]), T.ArrayType(v.type)
        case [*steps, ("call", name, args)]:
            bag = Bag(s.here)
            for x in steps:
                match x:
                    case ("call", "map", [f]) if not bag.sorted:
                        for y in stages(f):
                            if y[:2] == ("call", "select"):
                                c = truth(value(y[2][0], bag.value, s.scope))
                                bag = replace(bag, condition=c if bag.condition is None else bag.condition & c)
                            else:
                                bag = replace(bag, value=value(y, bag.value, s.scope))
                    case ("call", "unique", []):
                        bag = replace(bag, distinct=True, sorted=True)
                    case ("call", "sort", []):
                        bag = replace(bag, sorted=True)
                    case _:
                        return None
            if name in ("length", "add", "min", "max", "any", "all", "unique", "sort") and not args:
                return of_bag(bag, name)
    return None


def join_stages(parts: list[tuple]) -> tuple:
    if not parts:
        return IDENTITY
    return parts[0] if len(parts) == 1 else ("pipe", parts[0], join_stages(parts[1:]))


def of_bag(b: Bag, name: str) -> tuple[Column, T.DataType]:
    c, t = b.column(), b.value.type
    match name:
        case "length":
            if b.distinct:  # null is a value like any other
                return F.count_distinct(c) + F.coalesce(F.max(b.only(c.isNull()).cast("int")), F.lit(0)), T.LongType()
            return (F.count(F.lit(1)) if b.condition is None else F.count_if(b.condition)), T.LongType()
        case "add" if isinstance(t, (*INTEGERS, *FLOATS)):
            return (F.sum_distinct(c) if b.distinct else F.sum(c)), T.LongType() if isinstance(t, INTEGERS) else T.DoubleType()
        case "min":
            missing = F.bool_or(b.only(whole(b.value).isNull()))
            return F.when(~F.coalesce(missing, F.lit(False)), F.min(c)), t
        case "max":
            return F.max(c), t
        case "any" | "all":
            x = b.only(truth(b.value))
            return F.coalesce((F.bool_or if name == "any" else F.bool_and)(x), F.lit(name == "all")), T.BooleanType()
        case "sort" | "unique":
            if kind(t) not in ("number", "string", "boolean"):
                raise NotTyped(name)
            boxed = (F.collect_set if name == "unique" or b.distinct else F.collect_list)(b.only(F.struct(whole(b.value).alias("v"))))
            return F.transform(F.array_sort(boxed), lambda x: x["v"]), T.ArrayType(t)
    raise NotTyped(name)


def running(s: State, name: str, init: tuple, update: tuple, extract: tuple | None, keys: list[str]) -> State:
    """foreach over sorted rows that adds up, counts or remembers the row before: a window."""
    w = Window.partitionBy(*keys).orderBy(*spark(needed(s))).rowsBetween(Window.unboundedPreceding, 0)
    match init, update:
        case ("literal", x), ("binary", "+", ("identity",), f) if isinstance(x, (int, float)):
            v = value(f, literal(None), {**s.scope, name: s.here})
            if v.kind != "number":
                raise NotTyped(update)
            t = T.LongType() if isinstance(v.type, INTEGERS) and isinstance(x, int) else T.DoubleType()
            so_far = Typed(F.sum(whole(v).cast(t)).over(w) + F.lit(x).cast(t), t)
        case _:
            raise NotTyped(update)
    df = s.df.withColumn("_so_far", so_far.column)
    so_far = replace(so_far, column=F.col("_so_far"))
    return replace(projected(replace(s, df=df, order=[]), value(extract, so_far, {**s.scope, name: s.here}) if extract else so_far), array=False)
