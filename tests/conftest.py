import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[*]").appName("promoloom-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def made_panel(spark):
    """A panel with a planted effect of 0.03 per point of discount, confounded by month and category."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for s in range(40):
        cat = f"C{s % 3}"
        level = rng.normal(3.0 + 0.3 * (s % 3), 0.2)
        for c in ("A", "B", "X"):
            for m in range(24):
                month = dt.date(2021 + m // 12, m % 12 + 1, 1)
                season = np.sin(2 * np.pi * (m % 12 + 1) / 12)
                depth = float(rng.choice([0, 0, 5, 10, 15, 20, 30]))
                if season > 0.5:
                    depth = float(rng.choice([0, 10, 20, 30]))
                y = level + 0.4 * season + 0.03 * depth + rng.normal(0, 0.15)
                rows.append((f"S{s:02d}", c, month, float(np.expm1(max(y, 0))), cat, f"G{s % 5}", depth))
    df = spark.createDataFrame(
        rows, "sku string, client string, month date, qty double, category string, grp string, own_disc double")
    return df.cache()
