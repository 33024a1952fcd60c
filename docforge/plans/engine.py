"""Filters over DataFrames: compiled to plans where the table's types allow it, interpreted on Arrow batches elsewhere."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import values as V
from .interpreter import UNFIT, Halt, evaluate_tree
from .modules import resolve
from .tables import compile_filter
from .typed import NotTyped

__all__ = ["NotTyped", "compile_filter", "exit_status", "interpret", "interpret_stream", "query", "slurp"]

OUT = [T.StructField("out_idx", T.LongType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]


def outputs(tree: tuple, modules: dict, line: str | None, variables: dict | None, mode: str, inputs: Iterator | None = None, info: dict | None = None, preserve: bool = False) -> Iterator[tuple[int, str | None, str | None]]:
    """Number, JSON text and error of each output; an error is the last."""
    n = 0
    try:
        value = None if line is None else V.load(line, preserve)
        for n, x in enumerate(evaluate_tree(tree, value, variables, inputs, mode, modules, {**(info or {}), "text": line or ""}), 1):  # noqa: B007
            yield n - 1, V.dump(x), None
    except V.Raised as r:
        yield n, None, V.text(r.value)
    except V.Break:
        yield n, None, "break"
    except Halt as h:
        if h.message is not None:
            yield n, None, h.message
    except RecursionError:
        yield n, None, "nested too deep"
    except UNFIT as bad:
        yield n, None, str(bad)


def interpret(df: DataFrame, program: str, column: str = "value", variables: dict | None = None, mode: str = "jq", modules: Mapping[str, str] | None = None, files: Mapping[str, object] | None = None, preserve: bool = False) -> DataFrame:
    """Every output of a filter on the JSON texts of a column: out_idx, value (JSON text) and error, after df's other columns.

    Outputs before an error stay; bad JSON is an error row, and a null text is the null value. Runs on Arrow batches, with no shuffle. Columns
    doc_idx and file_idx, where df has them, are what document_index and file_index give, and places what tag, line and others do.
    files has the values that load gives, by name; preserve keeps the spelling of numbers.
    """
    tree, known = resolve(program, modules)  # errors in the filter come here, not from an executor
    others = [f for f in df.schema.fields if f.name not in (column, *(o.name for o in OUT))]
    places = [f.name for f in others if f.name in ("doc_idx", "file_idx", "places")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            where = [b.column(p).to_pylist() for p in places]
            for k, line in enumerate(b.column(column).to_pylist()):
                for out in outputs(tree, known, line, variables, mode, None, {"files": files} | {p: w[k] for p, w in zip(places, where, strict=True)}, preserve):
                    rows.append(out)
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name).take(at) for f in others), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))],
                [*(f.name for f in others), *(o.name for o in OUT)],
            )

    return df.select(*(f.name for f in others), column).mapInArrow(run, T.StructType([*others, *OUT]))


def interpret_stream(df: DataFrame, program: str, by: Sequence[str], order: Sequence[str], column: str = "value", variables: dict | None = None, null_input: bool = False, mode: str = "jq", modules: Mapping[str, str] | None = None) -> DataFrame:
    """A filter on the texts of each stream, where input and inputs take what comes next: the columns `by`, in_idx, and the outputs.

    The rows with the same `by` are one stream, in the order of `order`; with null_input the filter runs once, on null, and all texts are inputs.
    A stream is read row by row in one task, since what a program reads depends on what it has read, and is never held.
    """
    tree, known = resolve(program, modules)
    keys = [df.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(r[c] for c in by), r[column]) for b in batches for r in b.to_pylist())
        ahead = next(rows, None)
        while ahead is not None:
            here = ahead[0]

            def texts() -> Iterator[str]:
                nonlocal ahead
                while ahead is not None and ahead[0] == here:  # noqa: B023
                    line = ahead[1]
                    ahead = next(rows, None)
                    yield line

            left = texts()
            values = (None if t is None else V.load(t) for t in left)
            n = 0
            for line in [None] if null_input else left:
                for out in outputs(tree, known, line, variables, mode, values):
                    yield pa.RecordBatch.from_pylist([dict(zip([*by, "in_idx", *(o.name for o in OUT)], [*here, n, *out], strict=True))], made)
                n += 1
            for _ in left:  # what the program has not read
                pass

    schema = T.StructType([*keys, T.StructField("in_idx", T.LongType()), *OUT])
    made = to_arrow_schema(schema)
    spread = df.repartition(*by) if by else df.coalesce(1)
    return spread.sortWithinPartitions(*by, *order).select(*by, column).mapInArrow(run, schema)


def slurp(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), column: str = "value") -> DataFrame:
    """All texts of each `by` as one JSON array, in order: the input of a program that wants all documents at once."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(column), F.lit("null")).alias("_text"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["_text"]), ","), F.lit("]"))
    return df.groupBy(*by).agg(text.alias(column))


def exit_status(outputs: DataFrame, order: Sequence[str]) -> int:
    """5 after an error, 4 without an output, 1 if the last output is null or false, else 0."""
    last = outputs.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("error").isNotNull()).alias("bad"), F.max_by("value", F.struct(*order)).alias("last")).first()
    return 5 if last["bad"] else 4 if not last["n"] else 1 if last["last"] in (None, "null", "false") else 0


def documents(df: DataFrame) -> DataFrame:
    """Each row of a table as a JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def query(df: DataFrame, program: str, **tables: DataFrame) -> DataFrame:
    """A filter over a typed table: a plan if possible, else interpreted on each row as JSON (without other tables)."""
    try:
        return compile_filter(df, program, **tables)
    except NotTyped:
        if tables:
            raise
        return interpret(documents(df), program)


def typed(outputs: DataFrame, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Interpreted outputs, objects, as columns of a schema; an error fails the job."""
    value = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("value"))
    return outputs.select(*keep, F.from_json(value, schema).alias("_v")).select(*keep, "_v.*")

