"""Session defaults and the shared scratch space used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "plexaform", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and AQE on; cluster settings given at submit time win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither the session nor the context names one (tests, local mode) a temporary folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plexaform-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_ROOTS: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage, outlive lost executors and give the planner true sizes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plexaform-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        self._n = 0
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and read it back; the shuffle files behind it go when it is written."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.option("compression", "zstd")
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plexaform_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            path = getattr(table, "_plexaform_path", None)
            if path:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


class Pile:
    """A table that grows by written parts. Parts are merged only once there are many of them, so a loop of many rounds neither
    rewrites everything each round nor ends in a plan of as many scans."""

    def __init__(self, tmp: Scratch, *parts: DataFrame, most: int = 16):
        self.tmp, self.parts, self.most = tmp, list(parts), most

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            merged = self.tmp.keep(self.all())
            # the part just added may still be read by itself
            self.tmp.drop(*self.parts[:-1])
            self.parts = [merged]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table written by ``Scratch`` in this session; results not yet read can't be read any more."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
