"""Plain Python functions of a row's values as columns, over Arrow batches of their inputs alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..session import ship


def column(run: Callable[..., Any], returns: str, *inputs: Column) -> Column:
    """run(values of a row) as a column; a null input counts as an empty text or array."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(SparkSession.active())
    kind = to_arrow_type(DataType.fromDDL(returns))

    def values(a: pa.Array) -> list[Any]:
        empty: Any = "" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else []
        return [empty if x is None else x for x in a.to_pylist()]

    if len(inputs) == 1:
        @F.arrow_udf(returns)
        def batch(a: pa.Array) -> pa.Array:
            return pa.array([run(x) for x in values(a)], kind)
    else:
        @F.arrow_udf(returns)
        def batch(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([run(x, y) for x, y in zip(values(a), values(b))], kind)

    return batch(*inputs)
