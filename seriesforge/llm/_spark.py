"""Session helpers: shared scratch tables and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_seriesforge_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="seriesforge-")
    target = os.path.join(folder, "seriesforge_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(target)
    sc._seriesforge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, one of our own is set (local runs, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    own = getattr(sc, "_seriesforge_shared", None)
    if own is None:
        if sc.master.startswith("local[") or sc.master == "local":
            own = "file://" + tempfile.mkdtemp(prefix="seriesforge-shared-")
        else:
            own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_seriesforge"
        sc._seriesforge_shared = own
    return own


class Scratch:
    """Written tables of one run in the shared folder: they cut lineage and outlive executors.

    ``keep(name, df)`` writes and rereads; ``drop(name)`` deletes what is no
    longer needed.  What the returned DataFrame reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, df: DataFrame, rows: int | None = None, by: str | None = None) -> DataFrame:
        """Write and reread; rows: how many rows at most go to Python at once, where they are long; by: a column that parts the files."""
        # a task that holds a writer for each of a few parts need not sort its rows by them
        keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.maxConcurrentOutputFileWriters": by and 4}
        usual = {key: self.spark.conf.get(key) for key, value in keys.items() if value}
        try:
            for key in usual:
                self.spark.conf.set(key, str(keys[key]))
            df.write.mode("overwrite").parquet(self.path(name), partitionBy=by)
        finally:
            for key, value in usual.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
