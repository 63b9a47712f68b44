"""Makes this package importable in Python workers that were started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def importable() -> bool:
    """Workers inherit PYTHONPATH, and in local mode the working folder."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Gives the package's sources to Spark's file server once an application, if workers cannot import it."""
    app = spark.sparkContext.applicationId
    if app in _done or importable():
        return
    archive = Path(tempfile.mkdtemp(prefix="sources-")) / "ferrolith_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "ferrolith").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
        for source in ROOT.glob("corpus_pipeline.py"):
            z.write(source, source.name)
    spark.sparkContext.addPyFile(str(archive))
    _done.add(app)
