"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless they find it by PYTHONPATH or working directory."""
    known = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in known or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="scoutflow-")) / "scoutflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "scoutflow").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
