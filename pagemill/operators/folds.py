"""Folds over the rows of a key in order, as a stream over sorted partitions.

The state of the open key is all that a task holds, so a key may have any number of rows and the work grows with
their number only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` by key in as many partitions as the session shuffles into.

    Adaptive execution would merge them by their bytes; a step in Python takes long over few bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def held(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, for loops: in the session's checkpoint folder, without one on the executors."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def fold(rows: DataFrame, keys: list[str], order: list, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], out: str) -> DataFrame:
    """``rows`` with the columns ``out``, made by ``step(state, row) -> (state, values)`` along each key's order.

    ``order`` holds names or Columns and should be total; null keys are keys like any other.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(out).fields])
    names, at = schema.names, [rows.columns.index(k) for k in keys]
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            made: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, start()
                state, values = step(state, row)
                made.append(values)
            columns = zip(*made) if made else ([] for _ in names[width:])
            kinds = [types.field(n).type for n in names[width:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names)

    types = to_arrow_schema(schema)
    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
