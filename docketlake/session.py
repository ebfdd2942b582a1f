"""Session settings, and the package's code on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the library's semantics rely on.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
#: Settings for large clusters that are worth setting where the cluster has no opinion of its own.
ADVISED = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}

_shipped: set[str] = set()


def build_session(app: str = "docketlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**ADVISED, **REQUIRED, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="docketlake-code-")
    target = os.path.join(folder, "docketlake.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
