"""Session helpers: configuration, table access and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Configuration a stand-alone run starts with; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Whether the shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("codeloom")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = os.path.join(tempfile.gettempdir(), f"codeloom-{os.getpid()}")
    os.makedirs(fallback, exist_ok=True)
    return f"file://{fallback}"


class Scratch:
    """Intermediate tables in the shared folder.

    They go when they are dropped, when ``close`` is called or a ``with`` block ends, or when the driver's JVM ends, stopped session or not. What an operator returns may
    read them, so only those that the result doesn't need are dropped before.

    ``cut(df)`` writes ``df`` as Parquet and reads it back: lineage ends there, the files outlive executors, the shuffle files that led to
    them are gone, and the next plan has exact sizes. ``drop(df)`` frees one that is no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codeloom-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self._paths: dict[int, str] = {}
        system, root = self._system(self.root)
        system.mkdirs(root)
        system.deleteOnExit(root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count:04d}"
        self.count += 1
        schema = df.schema
        # The table takes the shuffle's place: its files go at once, not when the driver happens to collect its garbage.
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(SHUFFLE_CLEANUP) if before is None else self.spark.conf.set(SHUFFLE_CLEANUP, before)
        back = self.spark.read.schema(schema).parquet(path)
        self._paths[id(back)] = path
        back._codeloom_keep = self  # noqa: SLF001 - ties the folder's handle to the frame
        return back

    def cut_counted(self, df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
        """``cut``, and aggregates (with names) of the rows, taken while they are written."""
        seen = Observation()
        return self.cut(df.observe(seen, *figures)), seen.get

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            self._delete(path)

    def close(self) -> None:
        self._paths.clear()
        self._delete(self.root)

    def _system(self, path: str) -> tuple:
        """The file system of a path, and the path in the JVM's terms."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target  # noqa: SLF001

    def _delete(self, path: str) -> None:
        system, target = self._system(path)
        system.delete(target, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that Python functions can be unpickled there."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    import codeloom

    source = os.path.dirname(os.path.abspath(codeloom.__file__))
    # On the driver only: Spark serves the archive to the executors from a copy of its own.
    folder_ = tempfile.mkdtemp(prefix="codeloom-ship-")
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)
    archive = os.path.join(folder_, "codeloom_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(source):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("codeloom", os.path.relpath(full, source)))
    sc.addPyFile(archive)
    sc._codeloom_shipped = True  # noqa: SLF001
