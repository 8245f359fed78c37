"""Arrow UDFs that are made when they are used: a worker that imports the module needs no session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pagewright.workspace import ship

#: Bytes of arguments that a function gets at once: what it makes of them is several times as large.
SLICE_BYTES = 1 << 20


def slices(arrays: tuple[pa.Array, ...], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The rows in order, in runs of at most so many bytes or of one row."""
    rows = len(arrays[0])
    if rows <= 1 or sum(a.nbytes for a in arrays) <= most:
        yield arrays
    else:
        for start, stop in ((0, rows // 2), (rows // 2, rows)):
            yield from slices(tuple(a.slice(start, stop - start) for a in arrays), most)


def _arrow(values: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pd.DataFrame):
        return pa.StructArray.from_arrays([_arrow(values[f.name], f.type) for f in kind], fields=list(kind))
    if pa.types.is_map(kind):
        return pa.array([None if x is None else list(x.items()) for x in values], kind)
    return pa.array(values, kind, from_pandas=True)


def batch_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas series as a function of columns; it gets an Arrow batch in slices."""

    def made(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def column(*columns: Column) -> Column:
            ship(SparkSession.getActiveSession())
            kind, one = to_arrow_type(DataType.fromDDL(schema)), len(columns) == 1

            def sliced(batches):
                for batch in batches:
                    for part in slices((batch,) if one else batch):
                        yield _arrow(function(*(a.to_pandas() for a in part)), kind)

            sliced.__annotations__ = {"batches": Iterator[pa.Array] if one else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
            return F.arrow_udf(sliced, schema)(*columns)

        return column

    return made
