"""Writers (SNK-*, HSH-*): staged publishing, promotion, manifests, one file per key, archives.

Paths go through Hadoop's file system, so they may lie on any store that Spark knows; where renaming a folder is not
atomic, the manifest, which is written last, tells a whole revision from a broken one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.ranking import ranked


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, a: str, b: str) -> None:
    fs, pa = _fs(spark, a)
    _, pb = _fs(spark, b)
    if not fs.rename(pa, pb):
        raise OSError(f"{a} could not be renamed to {b}")


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file, visible only when it is whole (SNK-01)."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str).encode()))
    out.hsync()
    out.close()
    fs.delete(p, False)
    rename(spark, path + ".tmp", path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def publish(spark: SparkSession, path: str, build: Callable[[str], None], overwrite: bool = False) -> str:
    """Run build in a staging folder and rename it to path at the end; refuses an existing path (SNK-02).

    What lies at path is renamed aside first and removed last, and comes back if the new folder can't take its place; a
    crash between the two renames leaves it aside, where the next run finds it and brings it back."""
    stage, aside = f"{path}.staging", f"{path}.previous"
    if exists(spark, aside):
        remove(spark, aside) if exists(spark, path) else rename(spark, aside, path)
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    remove(spark, stage)
    build(stage)
    if exists(spark, path):
        rename(spark, path, aside)
    try:
        rename(spark, stage, path)
    except Exception:
        if exists(spark, aside):
            rename(spark, aside, path)
        raise
    remove(spark, aside)
    return path


def promote(spark: SparkSession, revision: str, active: str, language: str = "vi", force: bool = False) -> DataFrame:
    """Copy one language of a revision to the active folder; returns the manifest of what lies there (SNK-03)."""

    def build(stage: str) -> None:
        spark.read.parquet(f"{revision}/records").where(F.col("language") == language).write.partitionBy("split").parquet(f"{stage}/records")

    publish(spark, active, build, overwrite=force)
    return manifest(spark, active)


def one_folder_per(df: DataFrame, key: str, path: str) -> None:
    """One folder for each value of key (SNK-04); rows of a value are brought together first, so it has one file."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).json(path)


def manifest(spark: SparkSession, path: str, skip: tuple[str, ...] = ("manifest.json", ".tmp", "_SUCCESS", ".crc")) -> DataFrame:
    """(path, bytes, sha256) of each file below path (HSH-01, HSH-02)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", "^file:/*", "/")
    keep = F.lit(True)
    for s in skip:
        keep = keep & ~name.endswith(s)
    return r.where(keep).select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def archive(spark: SparkSession, paths: list[str], target: str, dry_run: bool = True) -> dict:
    """Inventory of paths and, unless dry_run, their move to target/<time stamp> (SNK-07)."""
    there = [p for p in paths if exists(spark, p)]
    files = [r.asDict() for p in there for r in manifest(spark, p).orderBy("path").toLocalIterator()]
    stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    out = {"dry_run": dry_run, "target": f"{target}/{stamp}", "n_files": len(files), "bytes": sum(f["bytes"] for f in files), "files": files}
    if not dry_run:
        fs, p = _fs(spark, out["target"])
        fs.mkdirs(p)
        for x in there:
            rename(spark, x, f"{out['target']}/{x.rstrip('/').rsplit('/', 1)[-1]}")
        write_json(spark, f"{out['target']}/inventory.json", out)
    return out


def raw_filter(raw: DataFrame, keep, order: str, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The untouched rows that keep takes, and (filtered_index, source_index) per part (SNK-06)."""
    kept = raw.where(keep)
    ix = ranked(kept.select(*([part] if part else []), F.col(order).alias("source_index")), ["source_index"], part, "nth")
    return kept, ix.select(*([part] if part else []), "source_index", (F.col("nth") - 1).alias("filtered_index"))
