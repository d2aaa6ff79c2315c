"""Session settings, materialisation and size-checked broadcasts shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their texts and arrays, up to which a side may be broadcast after both were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def build(master: str | None = None, app: str = "treeloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given by the caller or the cluster win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is set and the session is local."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        sc.setCheckpointDir(at)
    return at


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that they need no path of their own to it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        at = shared_dir(spark)
        folder = f"{at[7:]}/treeloom" if at.startswith("file://") else tempfile.mkdtemp(prefix="treeloom-")
        os.makedirs(folder, exist_ok=True)
        package = os.path.dirname(os.path.abspath(__file__))
        stage = os.path.join(folder, f"code-{uuid.uuid4().hex}")
        shutil.copytree(package, os.path.join(stage, "treeloom"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, f"treeloom-{uuid.uuid4().hex}"), "zip", stage))
        shutil.rmtree(stage)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a lost executor costs no recomputation of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: compressed, columnar, prunable and survives executors.

    ``by`` names a column of few values that makes folders, so that a reader of one value opens nothing else.
    """
    at = f"{shared_dir(df.sparkSession)}/treeloom/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts and arrays by length, eight for anything else."""
    sizes = [F.lit(16)]
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if t in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif t in ("array", "map"):
            sizes.append(32 * F.greatest(F.size(c), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return reduce(lambda a, b: a + b, sizes).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when at most ``rows`` rows of ``bytes_`` together were counted; beyond, the planner's join stays."""
    n, size = df.select(_bytes(df).alias("_size")).limit(rows + 1).agg(F.count("*"), F.sum("_size")).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= bytes_ else df
