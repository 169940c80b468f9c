"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in a single JVM, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodeseek-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: what comes after doesn't compute it anew."""
    path = f"{shared_dir(df.sparkSession)}/lodeseek-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` wrote; nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def levels(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], level: str, most: int | None = None, back: int | None = None) -> DataFrame:
    """What ``step`` reaches from ``start``, breadth first, with the column ``level`` (int): in how many steps.

    step: from the rows of one level to candidates for the next, with the same columns.
    Rows whose ``keys`` an earlier level has are dropped, so cycles end. Each level is
    written before the next, and a step's plan reads tables only. ``most``: levels after
    the first, None for all there are. ``back``: how many levels before the next one can
    hold rows that a step leads to again (2 where steps lead both ways), None for all.
    """
    spark = start.sparkSession
    path = f"{shared_dir(spark)}/lodeseek-{uuid.uuid4().hex}"
    schema = T.StructType([*start.schema.fields, T.StructField(level, T.IntegerType())])

    def found(first: int = 0) -> DataFrame:
        return spark.read.schema(schema).parquet(path).where(F.col(level) >= first)

    start.dropDuplicates(keys).write.parquet(f"{path}/{level}=0")
    n = 0
    while most is None or n < most:
        front = spark.read.schema(start.schema).parquet(f"{path}/{level}={n}")
        if front.isEmpty():
            break
        new = step(front).select(*start.columns).dropDuplicates(keys).join(found(0 if back is None else n + 1 - back).select(*keys), keys, "left_anti")
        n += 1
        new.select(*start.columns).write.parquet(f"{path}/{level}={n}")
    return spark.read.schema(schema).parquet(path)
