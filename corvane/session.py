"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    The plan after it starts at files that any executor can read, so the loss of an executor repeats no work before it;
    Parquet also keeps the copy small. The files are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffle files of this write any more once it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that no plan reads any more."""
    files = {os.path.dirname(f) for f in df.inputFiles()}
    for s, p in list(_written):
        if any(f.split(":", 1)[-1].lstrip("/").endswith(p.split(":", 1)[-1].lstrip("/")) for f in files):
            _remove(s, p)
            _written.remove((s, p))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for s, p in _written:
        try:
            _remove(s, p)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
