"""The stored tables: Parquet folders, written version by version, partitioned by snapshot where snapshots come and go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import schemas
from treeloom.operators import store


class Catalog:
    """Tables under one folder. A write makes a new version and then points to it, so that a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._versions: dict[str, str | None] = {}

    def _pointer(self, table: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/_current")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self, table: str) -> str | None:
        if table not in self._versions:
            fs, path = self._pointer(table)
            self._versions[table] = bytes(self.spark.read.format("binaryFile").load(path.toString()).first()["content"]).decode() if fs.exists(path) else None
        return self._versions[table]

    def create(self) -> None:
        """Make every table that isn't there yet, empty."""
        for t in schemas.tables():
            if self._version(t) is None:
                self.write(t, self.spark.createDataFrame([], schemas.schema(t)))

    def read(self, table: str) -> DataFrame:
        v = self._version(table)
        if v is None:
            return self.spark.createDataFrame([], schemas.schema(table))
        return self.spark.read.schema(schemas.schema(table)).parquet(f"{self.root}/{table}/{v}")

    def write(self, table: str, df: DataFrame) -> None:
        v = f"v-{uuid.uuid4().hex}"
        w = df.select(*schemas.schema(table).names)
        by = schemas.PARTITIONS.get(table)
        writer = w.repartition(by).write.partitionBy(by) if by else w.write
        writer.parquet(f"{self.root}/{table}/{v}")
        fs, path = self._pointer(table)
        out = fs.create(path, True)
        out.write(bytearray(v.encode()))
        out.close()
        self._versions[table] = v

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows by key, the last write winning; an empty set changes nothing. A column ``seq`` orders writes of one key."""
        if rows.limit(1).count():
            new = store.last_write(rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0)), schemas.KEYS[table], "seq").drop("seq")
            self.write(table, store.upsert(self.read(table), new, schemas.KEYS[table]))

    def delete(self, table: str, condition) -> int:
        kept, gone = store.delete_where(self.read(table), condition)
        n = gone.first()["deleted"]
        if n:
            self.write(table, kept)
        return n

    def purge(self, snapshot_id: str) -> dict[str, int]:
        """Remove a snapshot with all that hangs on it; counts by table, jobs untouched."""
        tables = {t: self.read(t) for t in store.PURGED}
        left, counts = store.purge(tables, self.spark.createDataFrame([(snapshot_id,)], "id string"))
        n = {r["table_name"]: r["deleted"] for r in counts.collect()}
        for t in store.PURGED:
            if n.get(t):
                self.write(t, left[t])
        return {t: n.get(t, 0) for t in store.PURGED}
