"""Keyed tables in hash buckets that outlive the process: a write replaces the buckets it touches and becomes current by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def buckets_for(rows: int) -> int:
    """A number of buckets for about so many keys: a million each, four at least."""
    return max(4, min(4096, -(-rows // 1_000_000)))


class SharedFolder:
    """Small files in the folder all executors share, through the file system the cluster uses."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: the text is written aside and renamed."""
        folder, _, base = name.rpartition("/")
        aside = self._at(f"{folder}/.{base}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class KeyedTable:
    """Rows of ``schema`` in ``buckets`` buckets by the hash of ``keys``.

    ``_commits/N`` names the version each bucket has after commit N; the highest N is current. A new object over the same folder
    goes on where the last one stopped. Versions that a commit replaced are removed by the commit after it, so that whoever
    reads the current state meanwhile keeps its files. The number of buckets is fixed by the first commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self._folder = SharedFolder(spark, self.path)
        last = self._last()
        self.buckets = last["count"] if last else buckets

    def _last(self) -> dict | None:
        done = [n for n in self._folder.names("_commits") if not n.startswith(".")]
        return json.loads(self._folder.read(f"_commits/{done[-1]}")) if done else None

    @property
    def version(self) -> int:
        """The number of the latest commit, -1 before the first."""
        last = self._last()
        return last["version"] if last else -1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, *rows: DataFrame) -> list[int]:
        """The buckets that keys of ``rows`` fall into; at most as many numbers as there are buckets."""
        return sorted(x[0] for x in reduce(DataFrame.unionAll, [r.select(self.bucket().alias("b")) for r in rows]).distinct().collect())

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The current rows, of the given buckets or of all."""
        last = self._last()
        at = last["buckets"] if last else {}
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in at.items() if only is None or int(b) in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, touched: Iterable[int], version: int) -> None:
        """Put ``rows`` in place of the touched buckets as commit ``version``, which must be higher than the current one."""
        last = self._last() or {"version": -1, "buckets": {}, "dropped": []}
        if version <= last["version"]:
            raise ValueError(f"commit {version} after {last['version']}")
        names = rows.columns
        out = rows.select(*names, self.bucket().alias("bucket")).hint("rebalance", "bucket")  # small buckets meet in a task, large ones are cut
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        written = {n.split("=")[1] for n in self._folder.names(f"v={version}") if n.startswith("bucket=")}
        touched = {str(b) for b in touched} | written
        dropped = [[v, b] for b, v in last["buckets"].items() if b in touched]
        now = {b: v for b, v in last["buckets"].items() if b not in touched} | {b: version for b in written}
        self._folder.write(f"_commits/{version:012d}", json.dumps({"version": version, "count": self.buckets, "buckets": now, "dropped": dropped}))
        for v, b in last["dropped"]:
            self._folder.delete(f"v={v}/bucket={b}")
