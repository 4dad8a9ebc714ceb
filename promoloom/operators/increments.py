"""The feature panel as a stored table that grows month by month.

Features of a row look back over a bounded number of rows of its series.  Next
to the panel, stored by month, lies the tail of every series: its last rows in
one array.  A new month reads the tails and its own rows, writes one month of the panel
and the next version of the tails; earlier months are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import DEFAULTS, SERIES_KEY
from ..storage import join_null_safe
from .features import ROLLING, add_features


class PanelStore:
    """A stored panel under ``folder``, with features of the given lags.

    ``month=...`` folders hold the panel; ``tails/<month>`` the series' last rows
    after that month.  A month is complete once its tails are written: an
    interrupted ``append`` leaves the store as it was, and can be run again.
    """

    def __init__(self, spark: SparkSession, folder: str, lags: tuple[int, ...] = DEFAULTS.lags) -> None:
        self.spark, self.folder, self.lags = spark, folder.rstrip("/"), lags
        self.depth = max([*lags, *[rows for _, rows in ROLLING.values()]])

    def _months(self) -> list[str]:
        """Months whose tails are complete, in order; one folder name each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/tails")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path)]
        ready = [p.getName() for p in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(ready)

    def create(self, panel: DataFrame) -> None:
        """Store a whole panel (from ``build_panel``)."""
        if self._months():
            raise ValueError(f"{self.folder} holds a panel already")
        self._write(add_features(panel, self.lags), panel, None)

    def append(self, rows: DataFrame) -> None:
        """Add the rows of one month, later than all stored ones."""
        new = rows.agg(F.min("month").alias("low"), F.max("month").alias("high")).first()
        done = self._months()
        if new.low is None:
            return
        if new.low != new.high or done and str(new.low) <= done[-1]:
            raise ValueError(f"one month after {done[-1] if done else 'none'} is wanted, not {new.low} to {new.high}")
        tails = self._tails(done[-1])
        met = join_null_safe(rows, tails, list(SERIES_KEY), "left")
        old = met.select(*[F.col(k) for k in SERIES_KEY], F.explode("tail").alias("t")).select(*SERIES_KEY, "t.month", "t.qty")
        both = rows.unionByName(old, allowMissingColumns=True)
        self._write(add_features(both, self.lags).filter(F.col("month") == F.lit(new.low)), rows, tails)

    def _tails(self, month: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tails/{month}")

    def _write(self, features: DataFrame, rows: DataFrame, tails: DataFrame | None) -> None:
        features.withColumn("stored", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "stored").parquet(f"{self.folder}/panel")
        # A series has one row a month, and a tail a bounded number of them.
        own = rows.groupBy(*SERIES_KEY).agg(F.collect_list(F.struct("month", "qty")).alias("own"))
        if tails is None:
            joined = own.withColumn("tail", F.array().cast(own.schema["own"].dataType))
        else:
            renamed = own.withColumnsRenamed({k: f"_{k}" for k in SERIES_KEY})
            match = [tails[k].eqNullSafe(renamed[f"_{k}"]) for k in SERIES_KEY]
            joined = tails.join(renamed, match[0] & match[1], "full").select(
                *[F.coalesce(k, f"_{k}").alias(k) for k in SERIES_KEY], "tail", "own")
        kind = own.schema["own"].dataType
        every = F.array_sort(F.concat(F.coalesce("tail", F.array().cast(kind)), F.coalesce("own", F.array().cast(kind))))
        month = rows.agg(F.max("month")).first()[0]
        (joined.select(*SERIES_KEY, F.slice(every, F.greatest(F.size(every) - self.depth + 1, F.lit(1)), self.depth).alias("tail"))
         .write.mode("overwrite").parquet(f"{self.folder}/tails/{month}"))

    def panel(self) -> DataFrame:
        """All stored rows with their features."""
        return self.spark.read.parquet(f"{self.folder}/panel").drop("stored")

    def month(self, month: str) -> DataFrame:
        """One month's rows; its files alone are read."""
        return self.spark.read.parquet(f"{self.folder}/panel").filter(F.col("stored") == F.lit(month).cast("date")).drop("stored")
