"""A table that grows by numbered parts: each is written once, and counts once it is whole.

A full part stands for all parts before it, so state that only needs its
latest form (known series, latest times) stays as small as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[tuple[int, bool]]:
        """Numbers of the whole parts, and whether each is a full one, in order; a part without its mark of success does not count."""
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        found = []
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name.startswith("part-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
                number, _, full = name[5:].partition("-")
                found.append((int(number), full == "full"))
        return sorted(found)

    def next(self) -> int:
        return max((n for n, _ in self.parts()), default=-1) + 1

    def read(self, before: int | None = None, first: int = 0) -> DataFrame:
        """Rows of the parts numbered from first up to before, from the last full one of them on."""
        parts = [(n, full) for n, full in self.parts() if n >= first and (before is None or n < before)]
        start = max((i for i, (_, full) in enumerate(parts) if full), default=0)
        paths = [self._name(n, full) for n, full in parts[start:]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def deltas(self, before: int) -> int:
        """How many parts a reading up to before takes."""
        parts = [full for n, full in self.parts() if n < before]
        return len(parts) - max((i for i, full in enumerate(parts) if full), default=0)

    def _name(self, n: int, full: bool) -> str:
        return f"{self.path}/part-{n:012d}{'-full' if full else ''}"

    def write(self, n: int, rows: DataFrame, full: bool = False) -> None:
        """Write part n; one that was left unfinished, or written by a try that did not end, is replaced."""
        rows.write.mode("overwrite").parquet(self._name(n, full))

    def drop(self, n: int) -> None:
        """Remove part n, such as one that only one step reads."""
        _, fs = self._fs()
        for full in (False, True):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._name(n, full)), True)
