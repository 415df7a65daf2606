"""Sessions, and shipping this package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once for each context; the driver serves the archive."""
    context = spark.sparkContext
    if context not in _SHIPPED:
        root = Path(__file__).parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="textloom-ship-"), "textloom_package.zip")
        Path(path).write_bytes(held.getvalue())
        context.addPyFile(path)
        _SHIPPED.add(context)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false",
    }
    return ship(SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate())
