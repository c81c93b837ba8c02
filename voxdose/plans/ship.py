"""Make the package importable in Python workers that were not started in its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Add the package to the session's files, once, unless workers find it by path already."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app not in _sent and not any(p and Path(p).resolve() == ROOT for p in known):
        path = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "voxdose_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in [*ROOT.glob("*.py"), *(ROOT / "voxdose").rglob("*.py")]:
                z.write(f, f.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
    return spark
