"""Sending this package to the executors."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes in an Arrow batch on its way to Python, at most, where the session doesn't say: workers hold some batches at once.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, unless PYTHONPATH has it for them; keeps Arrow batches small."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH))
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(root))
    before = list(sys.path)
    spark.sparkContext.addPyFile(str(path))
    sys.path[:] = before
    _sent.add(app)
