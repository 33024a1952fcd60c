"""Filters over streams: stateless ones as the same plans, running folds with state for each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import values as V
from ..plans.engine import interpret
from ..plans.interpreter import evaluate_tree
from ..plans.parser import parse
from ..plans.tables import compile_filter
from ..plans.typed import NotTyped


def stream_filter(stream: DataFrame, program: str, column: str = "value") -> DataFrame:
    """The outputs of a filter for each row of a stream, as they come: a plan where the table's types allow it, else the texts of a column interpreted."""
    try:
        return compile_filter(stream, program)
    except NotTyped:
        return interpret(stream, program, column)


def running_fold(stream: DataFrame, keys: Sequence[str], init: str, update: str, column: str = "value") -> DataFrame:
    """keys, n and value: after each batch, the fold over all JSON texts of a key so far, `foreach .[] as $x (init; update)`, in the order of arrival.

    State is the fold's value, as JSON text, and the count; a key that has no new texts gives no row.
    """
    first, step = parse(init), parse(update)
    names = [stream.schema[k] for k in keys]
    schema = T.StructType([*names, T.StructField("n", T.LongType()), T.StructField("value", T.StringType())])
    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("value", T.StringType())])

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, text = state.get if state.exists else (0, None)
        value = V.load(text) if text is not None else next(evaluate_tree(first, None))
        for part in parts:
            for x in part[column]:
                for value in evaluate_tree(step, value, {"x": None if x is None else V.load(x)}):  # noqa: B007
                    pass
                n += 1
        state.update((n, V.dump(value)))
        yield pd.DataFrame([(*key, n, V.dump(value))], columns=[f.name for f in schema.fields])

    return stream.select(*keys, column).groupBy(*keys).applyInPandasWithState(fold, schema, held, "update", GroupStateTimeout.NoTimeout)
