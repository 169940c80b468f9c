"""Adding computed columns to a DataFrame by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows that a worker takes from a batch at once.
ROWS = 512


def small_batches(df: DataFrame) -> None:
    """Let the session send ``ROWS`` rows at once to Python, unless it has a setting of its own.

    The default of 10,000 rows would put tens of megabytes of text into a batch, once in
    the JVM and once in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(ROWS))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in views of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def with_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], outputs: str) -> DataFrame:
    """``df`` with the columns of ``make`` (DDL ``outputs``) after its own.

    A column of ``df`` with the name of an output, in any case, is replaced. ``make``
    sees a few hundred rows at a time and is called on executors; it returns one value a row.
    """
    small_batches(df)
    added = T._parse_datatype_string(outputs)
    new = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in new]
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = make(batch)
            arrays = [batch.column(f.name) for f in kept] + [made[n] for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + names)

    return df.mapInArrow(run, T.StructType(kept + list(added)))
