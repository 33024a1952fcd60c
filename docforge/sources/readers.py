"""Readers of JSON, delimited, YAML and plain text; each gives one row for a value or record, with its file and place."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import values as V
from . import yaml12

WHITE = re.compile(r"[ \t\r\n]*")
FENCE = r"^---[ \t]*\r?\n(?s:(.*?\r?\n)??)(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)(?s:(.*))$"
#: Separators of the usual kinds of delimited text.
PRESETS = {"csv": ",", "tsv": "\t", "psv": "|"}


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, file_idx (their order by name) and value, the whole text. A file is one task's."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    names = sorted(r["file"] for r in whole.select("file").distinct().collect())  # names alone; one for each file
    order = spark.createDataFrame(list(enumerate(names)), "file_idx long, file string")
    return whole.join(F.broadcast(order), "file")


def _exploded(files: DataFrame, each: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """For each file the rows that each(text) gives, after file and file_idx."""
    names = ["file", "file_idx", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, k, text in zip(*(b.column(c).to_pylist() for c in ("file", "file_idx", "value")), strict=True):
                rows = []
                for r in each(text):
                    rows.append((file, k, *r))
                    if len(rows) == 10_000:
                        yield _batch(rows, names, schema)
                        rows = []
                if rows:
                    yield _batch(rows, names, schema)

    return files.select("file", "file_idx", "value").mapInArrow(run, f"file string, file_idx long, {schema}")


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *(ARROW[c.split()[1]] for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each line that isn't blank. Files are split between tasks."""
    return spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> ''")


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """file, file_idx, doc_idx, value, error: concatenated or indented JSON values; after bad text the file's next values are not read."""

    def each(text: str) -> Iterator[tuple]:
        decoder, n = json.JSONDecoder(), 0
        at = WHITE.match(text).end()
        while at < len(text):
            try:
                _, end = decoder.raw_decode(text, at)
            except ValueError as e:
                yield n, None, str(e)
                return
            yield n, text[at:end], None
            at, n = WHITE.match(text, end).end(), n + 1

    return _exploded(whole_files(spark, path), each, "doc_idx long, value string, error string")


def json_seq(spark: SparkSession, path: str) -> DataFrame:
    """value: the records of an RFC 7464 sequence."""
    return spark.read.option("lineSep", "\x1e").text(path).select(F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("value")).filter("value <> ''")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: each line as it is, a carriage return included."""
    return spark.read.option("lineSep", "\n").text(path)


def null_input(spark: SparkSession) -> DataFrame:
    """One null value."""
    return spark.range(1).select(F.lit("null").alias("value"))


def document(values: DataFrame, n: int) -> DataFrame:
    """The n-th document of each file."""
    return values.filter(F.col("doc_idx") == n)


def records(text: str, sep: str = ",", quote: str = '"') -> Iterator[list[str]]:
    """Records of delimited text: quotes toggle, doubled quotes inside are one, only a line feed ends a record, and a carriage return is a character."""
    token = re.compile(f"[{re.escape(sep + quote)}\n]")
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if quote not in text[at:end]:
            yield text[at:end].split(sep)
            at = end + 1
            continue
        row, field, inside = [], [], False
        while True:
            m = token.search(text, at)
            field.append(text[at : m.start() if m else len(text)])
            if not m:
                yield [*row, "".join(field)]
                return
            at = m.end()
            if m[0] == quote:
                if inside and text.startswith(quote, at):
                    field.append(quote)
                    at += 1
                else:
                    inside = not inside
            elif inside:
                field.append(m[0])
            else:
                row.append("".join(field))
                field = []
                if m[0] == "\n":
                    yield row
                    break


def delimited(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', one_line: bool = False) -> DataFrame:
    """file, file_idx, row_idx, row: each record's fields as strings, without header or types; sep may be a name of PRESETS.

    With one_line no field has a line feed: then large files are split between tasks, and row_idx is only in their order.
    """
    sep = PRESETS.get(sep, sep)
    if len(sep) != 1 or ord(sep) > 127 or sep in (quote, "\n"):
        raise ValueError("the separator must be one ASCII character other than the quote and the line feed")
    if not one_line:
        return _exploded(whole_files(spark, path), lambda text: ((k, r) for k, r in enumerate(records(text, sep, quote))), "row_idx long, row array<string>")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.lit(0).cast("long").alias("file_idx"), F.monotonically_increasing_id().alias("row_idx"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [next(records(t, sep, quote), [""]) for t in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("file_idx"), b.column("row_idx"), pa.array(rows, pa.list_(pa.string()))], ["file", "file_idx", "row_idx", "row"])

    return lines.mapInArrow(run, "file string, file_idx long, row_idx long, row array<string>")


def record(rows: DataFrame, n: int) -> DataFrame:
    """The n-th record of each file."""
    return rows.filter(F.col("row_idx") == n)


def cell(rows: DataFrame, column: int) -> DataFrame:
    """Each record's field of a column, from 0; null beyond its end."""
    return rows.withColumn("value", F.get("row", F.lit(column)))


def yaml_values(spark: SparkSession, path: str) -> DataFrame:
    """file, file_idx, doc_idx, value (JSON text), places (JSON text, for tag, anchor, style, kind, line, column and line_comment) and error, for each YAML document."""
    return parse_yaml(whole_files(spark, path))


def parse_yaml(texts: DataFrame) -> DataFrame:
    """yaml_values() of texts(file, file_idx, value)."""

    def each(text: str) -> Iterator[tuple]:
        n = 0
        try:
            for n, (value, places) in enumerate(yaml12.documents(text), 1):
                yield n - 1, V.dump(value), json.dumps(places), None
        except ValueError as e:
            yield n, None, None, str(e)

    return _exploded(texts, each, "doc_idx long, value string, places string, error string")


def read_values(spark: SparkSession, path: str, input_format: str = "auto") -> DataFrame:
    """The documents of files by their kind: by suffix, or `json` or `yaml`; JSON is valid YAML, so anything else is read as that."""
    if input_format not in ("auto", "json", "yaml"):
        raise ValueError(f"not an input format: {input_format}")
    kind = "json" if input_format == "json" or input_format == "auto" and os.path.splitext(path.rstrip("/*"))[1].lower() in (".json", ".jsonl", ".ndjson") else "yaml"
    return json_values(spark, path) if kind == "json" else yaml_values(spark, path)


def front_matter(files: DataFrame) -> DataFrame:
    """files(value) with the YAML header between --- lines as `front`, null without one, and what follows as `body`."""
    found = F.regexp_like("value", F.lit(FENCE))
    return files.withColumns({"front": F.when(found, F.regexp_extract("value", FENCE, 1)), "body": F.when(found, F.regexp_extract("value", FENCE, 2)).otherwise(F.col("value"))})


def eval_all(values: DataFrame) -> DataFrame:
    """All documents of all files as one array, in the order of files and documents."""
    rows = F.array_sort(F.collect_list(F.struct("file_idx", "doc_idx", "value")))
    return values.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["value"]), ","), F.lit("]")).alias("value"))


def load(spark: SparkSession, path: str) -> object:
    """A YAML or JSON file's first document as a variable's value, read on the driver."""
    first = read_values(spark, path).filter("doc_idx = 0").select("value", "error").first()
    if first is None or first["error"]:
        raise ValueError(first["error"] if first else f"nothing in {path}")
    return json.loads(first["value"])


def _diagnosed(df: DataFrame, column: str, check: Callable[[object], tuple[int, int, str] | None]) -> DataFrame:
    """df with valid, and line, column (from 1) and kind of the first error; check(text) gives those three or None."""
    out = [("valid", T.BooleanType(), pa.bool_()), ("line", T.LongType(), pa.int64()), ("column", T.LongType(), pa.int64()), ("problem", T.StringType(), pa.string())]
    kept = [f for f in df.schema.fields if f.name not in {n for n, _, _ in out}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [check(t) for t in b.column(column).to_pylist()]
            made = [[f is None, *(f or (None, None, None))] for f in found]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array([m[k] for m in made], t) for k, (_, _, t) in enumerate(out))], [*(f.name for f in kept), *(n for n, _, _ in out)])

    return df.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in out)]))


def validate_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Whether texts are JSON by RFC 8259; null is the empty text."""

    def check(t: str | None) -> tuple[int, int, str] | None:
        try:
            json.loads(t or "", parse_constant=_no_constant)
        except json.JSONDecodeError as e:
            return e.lineno, e.colno, e.msg
        except ValueError as e:
            return 1, 1, str(e)
        return None

    return _diagnosed(df, column, check)


def _no_constant(name: str) -> float:
    raise ValueError(f"not a JSON value: {name}")


def validate_yaml(df: DataFrame, column: str = "value") -> DataFrame:
    """Whether texts are YAML."""

    def check(t: str | None) -> tuple[int, int, str] | None:
        try:
            for _ in yaml12.documents(t or ""):
                pass
        except ValueError as e:
            found = re.match(r"bad YAML(?: at line (\d+), column (\d+))?: (.*)", str(e), re.S)
            return (int(found[1] or 1), int(found[2] or 1), found[3]) if found else (1, 1, str(e))
        return None

    return _diagnosed(df, column, check)


def validate_utf8(df: DataFrame, column: str = "value") -> DataFrame:
    """Whether bytes are UTF-8."""

    def check(b: bytes | None) -> tuple[int, int, str] | None:
        try:
            (b or b"").decode()
        except UnicodeDecodeError as e:
            before = b[: e.start]
            return before.count(b"\n") + 1, e.start - (before.rfind(b"\n") + 1) + 1, e.reason
        return None

    return _diagnosed(df, column, check)
