"""Writers of filter results: JSON and YAML texts in their layouts, and files of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import values as V
from . import yaml12

#: The usual colours of null, false, true, numbers, strings, arrays, objects and keys.
COLOURS = {"null": "1;30", "false": "0;39", "true": "0;39", "number": "0;39", "string": "0;32", "array": "1;39", "object": "1;39", "key": "34;1"}


def _texts(df: DataFrame, column: str, f: Callable[[str], str]) -> DataFrame:
    """df with the texts of a column changed by f; null stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if t is None else f(t) for t in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if c == column else b.column(c) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(run, df.schema)


def render(df: DataFrame, column: str = "value", indent: int | None = None, sort_keys: bool = False, ascii_only: bool = False, raw: bool = False, tab: bool = False, colour: bool = False, preserve: bool = False) -> DataFrame:
    """JSON texts in another layout: compact or indented (with tabs), keys sorted, ASCII only, strings raw, in colours; with preserve, numbers as the source spells them."""

    def one(text: str) -> str:
        v = V.load(text, preserve)
        if raw and isinstance(v, str):
            return v
        if colour:
            return coloured(v, indent, sort_keys)
        return V.dump(v, sort_keys, "\t" if tab else indent, ascii_only)

    return _texts(df, column, one)


def coloured(v: object, indent: int | None = None, sort_keys: bool = False, level: int = 0) -> str:
    """JSON text with a terminal's colours."""
    kind = V.kind(v)
    name = str(v).lower() if kind == "boolean" else kind

    def paint(text: str, of: str) -> str:
        return f"\x1b[{COLOURS[of]}m{text}\x1b[0m"

    if kind not in ("array", "object"):
        return paint(V.dump(v), name)
    opened, closed = "[]" if kind == "array" else "{}"
    if not v:
        return paint(opened + closed, name)
    pad = "" if indent is None else "\n" + " " * indent * (level + 1)
    items = [coloured(x, indent, sort_keys, level + 1) for x in v] if kind == "array" else [paint(V.dump(k), "key") + paint(":", name) + ("" if indent is None else " ") + coloured(v[k], indent, sort_keys, level + 1) for k in (sorted(v) if sort_keys else v)]
    last = "" if indent is None else "\n" + " " * indent * level
    return paint(opened, name) + (paint(",", name)).join(pad + x for x in items) + last + paint(closed, name)


def to_yaml(df: DataFrame, column: str = "value", indent: int = 2, places: str | None = None) -> DataFrame:
    """JSON texts as YAML documents; a column of places keeps the source's flow style and quotes."""
    if places is None:
        return _texts(df, column, lambda t: yaml12.emit(V.load(t), indent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t, p in zip(b.column(column).to_pylist(), b.column(places).to_pylist(), strict=True):
                styles = {tuple(x[0]): x[3] for x in json.loads(p or "[]")}
                made.append(None if t is None else yaml12.emit(V.load(t), indent, styles))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == column else b.column(c) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(run, df.schema)


def write_lines(df: DataFrame, path: str, column: str = "value", sep: str = "\n", mode: str = "error") -> None:
    """Texts, each with `sep` after it: a line feed, a zero byte, or nothing, which joins them."""
    if sep == "":
        df = df.select(column).toDF("value").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(["".join(x or "" for x in b.column(0).to_pylist())])], ["value"]) for b in batches if len(b)), "value string")
        column = "value"
    df.select(F.col(column).alias("value")).write.mode(mode).option("lineSep", sep or "\x00").text(path)


def write_seq(df: DataFrame, path: str, column: str = "value", mode: str = "error") -> None:
    """An RFC 7464 sequence: a record separator before and a line feed after each text."""
    df.select(F.concat(F.lit("\x1e"), F.col(column)).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_yaml(df: DataFrame, path: str, column: str = "value", separators: bool = True, mode: str = "error") -> None:
    """YAML documents, each after a --- line."""
    text = F.concat(F.lit("---\n"), F.col(column)) if separators else F.col(column)
    to_yaml(df.select(column), column).select(text.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_split(df: DataFrame, path: str, name: str, column: str = "value", mode: str = "error") -> None:
    """Texts in folders by the name that another column has for each."""
    df.select(F.col(name).cast("string").alias("name"), F.col(column).alias("value")).write.partitionBy("name").mode(mode).option("lineSep", "\n").text(path)


def csv_line(*columns: str) -> Column:
    """The @csv line of columns: strings quoted, quotes in them doubled, numbers and booleans plain, null empty."""
    return _line(",", columns)


def dsv_line(sep: str, *columns: str) -> Column:
    """csv_line() with another separator."""
    return _line(sep, columns)


def _line(sep: str, columns: tuple[str, ...]) -> Column:
    # Which columns are strings is known when the plan is resolved; typeof folds to a constant.
    cells = []
    for c in columns:
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(F.when(F.typeof(F.col(c)) == "string", quoted).otherwise(text), F.lit("")))
    return F.concat_ws(sep, *cells)


def tsv_field(c: str) -> Column:
    """A column as an @tsv field: backslash, tab, line feed and carriage return escaped, null empty."""
    out = F.col(c).cast("string")
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.coalesce(out, F.lit(""))
