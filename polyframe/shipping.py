"""Sends this package to Python workers that cannot import it from their own path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's source to the application once; workers then import it from there."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        # The driver serves the file to executors from here as long as it runs.
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        target = Path(folder) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark
