"""Where a job keeps its intermediate tables, and how the package reaches the executors.

Intermediate tables are Parquet under the folder named by ``spark.checkpoint.dir``. Every executor sees that folder, so
a job that loses executors rereads the tables instead of recomputing what led to them. Where the setting is absent
(local runs, tests) a folder beside the warehouse is used.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder; falls back to a local one only when the session names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "pagewright-shared")


class Workspace:
    """Intermediate tables of one run, in a folder of their own."""

    def __init__(self, spark: SparkSession, purpose: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/pagewright/{purpose}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends at the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._folder(self.path(name), lambda files, path: files.delete(path, True))

    def keep_only(self, *names: str) -> None:
        """Delete all tables of this run but those named."""
        there = self._folder(self.root, lambda files, path: [x.getPath().getName() for x in files.listStatus(path)])
        for name in set(there) - set(names):
            self.drop(name)

    def _folder(self, name: str, do):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return do(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_pagewright_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("pagewright", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._pagewright_shipped = True
