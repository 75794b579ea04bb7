"""The session that tests, the benchmark and the examples use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, where they wouldn't find it: Python was started elsewhere and PYTHONPATH doesn't name its folder."""
    package = Path(__file__).resolve().parent
    known = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if package.parent in (p.resolve() for p in known) or getattr(spark, "_corvane_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="corvane-package-")) / f"{package.name}.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark._corvane_shipped = True


def build_session(cores: int | str = 8, partitions: int = 8, memory: str | None = None) -> SparkSession:
    """A local session with the settings that the operators rely on.

    The settings that matter for results: UTC, and the last value winning for repeated map keys.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.driver.memory", memory or os.environ.get("CORVANE_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
