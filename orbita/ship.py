"""Sends the package to the workers, for sessions whose workers can't import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Once for each application: the package as a zip on the workers' path."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="orbita-ship-")) / "orbita_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(to))
