"""Functions of one row's values over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_batches(kind: str, arrow: pa.DataType, one: Callable, *columns: Column) -> Column:
    """``one`` of each row's values as a column of type ``kind`` (``arrow``, in Arrow's terms). Lists of structs come back as tuples: by way of pandas each would be copied twice."""

    def all_of(*values: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(v.to_pylist() for v in values))], type=arrow)

    all_of.__name__ = one.__name__  # what plans show
    return F.arrow_udf(all_of, kind)(*columns)
