"""The node table: one row for each value inside JSON texts, for paths, recursion and streaming events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import values as V

COLUMNS = "node_id long, parent_id long, depth int, ordinal int, path string, key string, type string, value string"


def node_table(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, then node_id (pre-order), parent_id, depth, ordinal, path (JSON text), key, type and value (JSON text) of all nodes; bad or null JSON has none."""

    def visit(v: object) -> Iterator[tuple]:
        todo, n = [(v, None, 0, 0, [])], 0
        while todo:
            x, parent, depth, ordinal, path = todo.pop()
            yield n, parent, depth, ordinal, V.dump(path), None if not path else str(path[-1]), V.kind(x), V.dump(x)
            if isinstance(x, (list, dict)):
                todo += [(y, n, depth + 1, k, [*path, name]) for k, (name, y) in reversed(list(enumerate(V.items(x))))]
            n += 1

    names = [key, *("name" if c.split()[0] == "key" else c.split()[0] for c in COLUMNS.split(", "))]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            for k, line in enumerate(b.column(column).to_pylist()):
                try:
                    found = [] if line is None else list(visit(json.loads(line)))
                except ValueError:
                    continue
                rows += found
                keep += [k] * len(found)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {COLUMNS.replace(' key string', ' name string')}")


def leaf_events(nodes: DataFrame, key: str) -> DataFrame:
    """The leaves of tostream: path and value of scalars and of empty containers."""
    return nodes.filter("type NOT IN ('array', 'object') OR value IN ('[]', '{}')").select(key, "path", F.col("value"))
