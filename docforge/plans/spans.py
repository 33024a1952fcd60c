"""Where the values of a JSON text stand in it: byte ranges, structural characters, lines; and the path of what stands at a place."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKEN = re.compile(rb'[ \t\r\n]*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.S)
NAME = re.compile(r"[A-Za-z_]\w*", re.ASCII)
KINDS = {b"{": "object", b"[": "array", b'"': "string", b"t": "boolean", b"f": "boolean", b"n": "null"}


def tokens(data: bytes) -> Iterator[tuple[int, int]]:
    """The ranges of the tokens of a JSON text."""
    at = 0
    while m := TOKEN.match(data, at):
        yield m.span(1)
        at = m.end()


def structural(data: bytes) -> list[tuple[int, str]]:
    """The places of brackets, braces, colons and commas outside strings."""
    return [(a, data[a:b].decode()) for a, b in tokens(data) if data[a : a + 1] in b"{}[],:"]


def spans(data: bytes) -> list[tuple[list, str, int, int]]:
    """Path, kind, first byte and byte after the last of every value of a valid JSON text, parents first."""
    out: list[list] = []
    #: Open containers: index in out, next key.
    above: list[list] = []
    for a, b in tokens(data):
        c = data[a : a + 1]
        if c in (b"}", b"]"):
            out[above.pop()[0]][3] = b
        elif c == b":":
            continue
        elif c == b",":
            if isinstance(above[-1][1], int):
                above[-1][1] += 1
            else:
                above[-1][1] = None
        else:
            if above and above[-1][1] is None:
                above[-1][1] = json.loads(data[a:b])
                continue
            path = [*out[above[-1][0]][0], above[-1][1]] if above else []
            out.append([path, KINDS.get(c, "number"), a, b])
            if c in (b"{", b"["):
                above.append([len(out) - 1, 0 if c == b"[" else None])
    return [tuple(x) for x in out]


def at_offset(data: bytes, offset: int) -> list | None:
    """The path of the innermost value whose range holds a byte offset."""
    found = None
    for path, _, a, b in spans(data):
        if a <= offset < b:
            found = path
    return found


def line_starts(data: bytes) -> list[int]:
    return [0, *(m.end() for m in re.finditer(rb"\n", data))]


def to_offset(data: bytes, line: int, column: int) -> int | None:
    """The byte offset of a line and column, both from 1."""
    starts = line_starts(data)
    if not 1 <= line <= len(starts) or column < 1:
        return None
    offset = starts[line - 1] + column - 1
    end = starts[line] if line < len(starts) else len(data) + 1
    return offset if offset < end else None


def to_line_column(data: bytes, offset: int) -> tuple[int, int] | None:
    """The line and column, both from 1, of a byte offset up to the text's end."""
    if not 0 <= offset <= len(data):
        return None
    starts = line_starts(data)
    line = bisect_right(starts, offset)
    return line, offset - starts[line - 1] + 1


def expression(path: list) -> str:
    """A path as a filter."""
    out = "".join(f"[{k}]" if isinstance(k, int) else f".{k}" if NAME.fullmatch(k) else f"[{json.dumps(k, ensure_ascii=False)}]" for k in path)
    return out if out.startswith(".") else "." + out


def locate(df: DataFrame, column: str, offset: str | None = None, line: str | None = None, column_number: str | None = None) -> DataFrame:
    """df with `path`, the filter that gives the value at each row's byte offset, or line and column, of its JSON text; null where there is none."""
    names = [offset] if offset else [line, column_number]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, *place in zip(*(b.column(c).to_pylist() for c in (column, *names)), strict=True):
                data = (text or "").encode()
                at = place[0] if offset else None if None in place else to_offset(data, *place)
                found = None if at is None else at_offset(data, at)
                out.append(None if found is None else expression(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "path"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("path", T.StringType())]))


def value_spans(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path (JSON text), type, start and stop of every value in the JSON texts of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            for k, text in enumerate(b.column(column).to_pylist()):
                for r in spans((text or "").encode()):
                    rows.append(r)
                    keep.append(k)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(keep, pa.int64())), pa.array([json.dumps(r[0], ensure_ascii=False, separators=(",", ":")) for r in rows], pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))],
                [key, "path", "type", "start", "stop"],
            )

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, path string, type string, start long, stop long")


def structural_positions(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, n, pos and char of the structural characters in the JSON texts of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, *r) for k, text in enumerate(b.column(column).to_pylist()) for n, r in enumerate(structural((text or "").encode()))]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))], [key, "n", "pos", "char"])

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n long, pos long, char string")
