"""Arrow batches of tables whose columns may have any name."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_in_arrow(df: DataFrame, run: Callable[[Iterable], Iterable], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` that also takes names with dots, which Spark's would read as paths."""
    names = df.columns

    def named(batches: Iterable) -> Iterable:
        import pyarrow as pa

        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)
