"""What a running Spark session needs to execute this package's Python code."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of a session, once for each application.

    Executors that have no copy of the package import it from there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_text(encoding="utf-8"))
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves it from here
    path = os.path.join(folder, "palimpsest.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
    return spark


def local(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
