"""Handing rows to code outside Spark: callbacks per row or batch, and checks by function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally import schemas
from paytally.plans.suite import Check
from paytally.tables import PaymentTables


# Types whose values are the same from an Arrow batch as from a row that Spark hands over.
_SAME_IN_ARROW = (T.StringType, T.DecimalType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType)


def _values(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_decimal(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def for_each_row(df: DataFrame, handler: Callable[[Row], None]) -> None:
    """Call ``handler`` on every row, on the executors, as the rows stream by.

    Plain columns come in Arrow batches, a column at a time, which takes less than half the time of rows; a table
    with others (dates with a time, bytes, nested ones) comes row by row.
    """
    names = df.columns

    def visit(rows: Iterator[Row]) -> None:
        for row in rows:
            handler(row)

    def visit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*map(_values, batch.columns), strict=True):
                row = tuple.__new__(Row, values)
                row.__fields__ = names
                handler(row)
        yield from ()

    if not names or not all(isinstance(f.dataType, _SAME_IN_ARROW) for f in df.schema):
        df.foreachPartition(visit)
        return
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    text = [F.make_valid_utf8(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in plain.schema]
    plain.select(*text).mapInArrow(visit_batches, "none int").write.format("noop").mode("overwrite").save()


def local_rows(df: DataFrame) -> Iterator[Row]:
    """The rows on the driver, one partition in memory at a time: for small results and tests."""
    return df.toLocalIterator()


def function_check(name: str, table: str, function: Callable, columns: list[str]) -> Check:
    """A check by a pandas function, for what needs a call outside Spark (a service, a library).

    ``function`` takes a frame of ``columns`` and returns a frame with the issue columns. It
    runs on Arrow batches in the tasks of the scan; only ``columns`` are read.
    """

    def build(tables: PaymentTables) -> DataFrame:
        def run(frames):
            for frame in frames:
                yield function(frame)

        schema = schemas.T.StructType(
            [*(schemas.T.StructField(c, schemas.T.StringType()) for c in tables.scope), *schemas.ISSUES.fields]
        )
        return getattr(tables, table).select(*tables.scope, *columns).mapInPandas(run, schema)

    return Check(name, build)
