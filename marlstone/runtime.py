"""What Python code on executors needs."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run."""
    key = spark.sparkContext.applicationId
    with _lock:
        if key in _shipped:
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a local session that sets none (tests), a temporary one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
