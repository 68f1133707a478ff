"""Parquet tables of a data folder, and working tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once, so that these need no search path of their own."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_leafmill_shipped", False) or not package.is_dir():
        return
    out = Path(tempfile.mkdtemp(prefix="leafmill-")) / "leafmill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(out))
    sc._leafmill_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; filters and column choice reach its Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a session that
    runs in one process; on a cluster, whose executors could not read it, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation; the files are removed when the
    application ends. An empty ``df`` comes back empty with its schema.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/leafmill-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _OWN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Remove the working tables of sessions that still run."""
    while _OWN:
        spark, path = _OWN.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and its folder is the cluster's to clean
            pass
