"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph-sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
