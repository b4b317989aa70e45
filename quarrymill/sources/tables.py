"""Versioned tables: every write is a new directory, which counts once its one small commit file is there."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Readers keep the version they opened; a write that fails before its commit leaves the version where it was.

    The current version is the highest committed one, so nothing has to be replaced: the commit file is moved into place in
    one rename. A version names the folders that hold its parts: those it wrote itself, and those of earlier versions that
    it left as they are.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _versions(self) -> list[int]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _said(self, version: int) -> dict | None:
        path = self._path(f"{self.root}/v{version:08d}/COMMITTED")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict | None]:
        for v in reversed(self._versions()):
            said = self._said(v)
            if said is not None:
                return v, said
        return 0, None

    def version(self) -> int:
        return self._current()[0]

    def parts(self) -> dict[str, str]:
        """part -> folder, of the current version; a table written as a whole has the one part "all"."""
        said = self._current()[1]
        return said["parts"] if said else {}

    def read(self, only: list[str] | None = None) -> DataFrame | None:
        """The current version, or some of its parts; None if there is none."""
        _, said = self._current()
        if said is None:
            return None
        folders = [f for p, f in sorted(said["parts"].items()) if only is None or p in only]
        read = self.spark.read.schema(said["schema"])
        return read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], said["schema"])

    def write(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Writes a new version, checks it as written, and only then makes it current."""
        v = max(self._versions(), default=0) + 1
        path = f"{self.root}/v{v:08d}/data"
        df.write.mode("overwrite").parquet(path)
        if check is not None:
            check(self.spark.read.schema(df.schema).parquet(path))
        return self._commit(v, {"all": f"v{v:08d}/data"}, df)

    def write_parts(self, df: DataFrame, part: Column, touched: list[str], check: Callable[[DataFrame], None] | None = None) -> int:
        """Writes a new version in which the parts `touched` are those of df and all others stay as they are. part: the name of a row's part."""
        before = self.parts()
        v = max(self._versions(), default=0) + 1
        path = f"{self.root}/v{v:08d}/data"
        df.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(path)
        if check is not None:
            check(self.spark.read.schema(df.schema).parquet(path))
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        new = {name.removeprefix("_part="): f"v{v:08d}/data/{name}" for name in made if name.startswith("_part=")}
        return self._commit(v, {p: f for p, f in before.items() if p not in touched} | new, df)

    def _commit(self, v: int, parts: dict[str, str], df: DataFrame) -> int:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        part, final = (self._path(f"{self.root}/v{v:08d}/{name}") for name in ("COMMITTING", "COMMITTED"))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"parts": parts, "schema": ddl}), "utf-8"))
        out.close()
        if not self._fs.rename(part, final):
            raise OSError(f"could not commit version {v} of {self.root}")
        return v


def part_of(*keys: str, parts: int) -> Column:
    """The name of the part that a hash of the keys names."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")
