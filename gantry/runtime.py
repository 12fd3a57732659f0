"""Getting the package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session and only where their path lacks it."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="gantry-")  # the driver serves the archive from here for as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/gantry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "gantry").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(archive)
    _sent.add(spark.sparkContext.applicationId)
