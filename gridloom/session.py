"""Session helpers: a local session with the recommended settings, and the package for the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that suit these plans; AQE re-plans joins and coalesces shuffle partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def local_session(name: str = "gridloom", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A ``local[cores]`` session for tests, benchmarks and small data."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"})
    return ship(builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
    return spark
