"""Session defaults for this engine."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "weirgate", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` (dots as ``__``) overrides."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once for each application, so that it needs to be on the driver only."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="weirgate-")) / "weirgate.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


#: Bytes that a core reads at once, as Spark's splits.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over all cores if it has less than a split for each (a small file may be one row group,
    which one core would read and scan alone); larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, key) if size < cores * SPLIT_BYTES else df
