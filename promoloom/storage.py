"""Where intermediate tables live, and how small ones reach every task.

``settle`` writes a table once to the shared folder the cluster names in
``spark.checkpoint.dir`` and reads it back: later passes scan only the columns
they need, lost executors re-read files instead of recomputing a long lineage,
and Catalyst knows the true size.  ``bounded`` is the only way a table is
broadcast in this library: its rows and bytes are measured first, and a table above the
limits is joined by shuffle instead.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most that is broadcast, and the rows that tell how wide a table is.
BROADCAST_ROWS, BROADCAST_BYTES, FIRST_ROWS = 50_000, 64_000_000, 2_000

#: Rows that a task makes of a table whose rows multiply.
TASK_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates, from the session's own setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="promoloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/promoloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a settled table that no later read needs: a round of a loop, once the next one is written."""
    path = getattr(df, "settled_at", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, copies: int, *keys: str) -> DataFrame:
    """Deal ``df`` out by ``keys`` to so many tasks that none makes more than some ``TASK_ROWS`` rows when each row becomes ``copies``.

    A written table of few bytes is read by one task, whatever its rows become; ``df`` is counted, so settle it first.
    """
    return df.repartition(1 + df.count() * copies // TASK_ROWS, *keys)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null; the left side's keys remain."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else leave it.

    The first rows tell how wide a row is; no more than the limits and a row
    reach the driver.  A bigger table comes back unchanged and its join shuffles.
    """
    rows = df.limit(min(FIRST_ROWS, max_rows + 1)).toArrow()
    if rows.num_rows == FIRST_ROWS <= max_rows:
        fits = min(max_rows, int(max_bytes * FIRST_ROWS // max(rows.nbytes, 1)))
        if fits < FIRST_ROWS:
            return df
        rows = df.limit(fits + 1).toArrow()
        max_rows = fits
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    # An Arrow table becomes a local relation: no job reads it again.
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a per-key table, or add a one-row table's values when no key is given."""
    if keys:
        return df.join(bounded(small), keys, how)
    row = small.first()
    values: list[Column] = [
        F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in small.schema.fields
    ]
    return df.select("*", *values)
