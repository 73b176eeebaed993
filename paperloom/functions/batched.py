"""Arrow-batched functions over text columns, built only where a query asks for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship

#: Bytes of an Arrow batch that are Python objects at a time. Spark bounds the batch itself only at 64 MB a task
#: (spark.sql.execution.arrow.maxBytesPerBatch), and objects and results of all of it take many times that.
STEP_BYTES = 1 << 20


def steps(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of equally long columns that hold about STEP_BYTES bytes; at least one row each."""
    texts = lambda c: pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
    held = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns if texts(c)), np.full(len(columns[0]), 8, np.int64)))
    at = 0
    while at < len(held):
        stop = max(at + 1, int(np.searchsorted(held, (int(held[at - 1]) if at else 0) + STEP_BYTES, "right")))
        yield tuple(c.slice(at, stop - at) for c in columns)
        at = stop


def in_steps(fn: Callable, returned: pa.DataType, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """``fn`` of pandas Series over each slice of the batches; every slice's result leaves before the next is read."""
    for columns in batches:
        for part in steps(columns):
            got = fn(*(pd.Series(c.to_pylist(), dtype=object) for c in part))
            if isinstance(got, pd.DataFrame):
                yield pa.StructArray.from_arrays([pa.Array.from_pandas(got[f.name], type=f.type) for f in returned], fields=list(returned))
            else:
                yield pa.Array.from_pandas(got, type=returned)


def batched(return_type: str) -> Callable:
    """Turns a function of pandas Series into one of Columns. Importing it needs no session."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        def on_columns(*columns: Column) -> Column:
            ship(SparkSession.active())
            returned = to_arrow_type(types._parse_datatype_string(return_type))

            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return in_steps(fn, returned, ((c,) for c in batches))

            def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                return in_steps(fn, returned, batches)

            run = one if len(columns) == 1 else several
            run.__annotations__ = {"batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
            return F.arrow_udf(run, return_type)(*columns)

        on_columns.__name__, on_columns.__doc__, on_columns.plain = fn.__name__, fn.__doc__, fn
        return on_columns

    return wrap
