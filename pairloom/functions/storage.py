"""Cutting lineage so that jobs survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a session, so that Python functions find it on other hosts too.

    Without a cluster it is sent only if the workers could not import it from the driver's own path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pairloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not alone or not any(p and Path(p).resolve() == root for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        # Spark copies the archive from the driver to every executor
        to = Path(tempfile.mkdtemp()) / "pairloom.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted((root / "pairloom").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(to))
    sc._pairloom_shipped = True


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without a cluster a temporary folder if that isn't set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if getattr(sc, "_pairloom_files", None) is None:
            sc._pairloom_files = f"file://{tempfile.mkdtemp(prefix='pairloom-')}"
        at = sc._pairloom_files
    return at.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the session's JVM ends."""
    at = f"{shared(spark)}/pairloom-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder, a fraction of the size of a checkpoint. Its rows may be read in other partitions."""
    at = f"{shared_folder(df.sparkSession, 'table')}/t"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, order: list, out: str, lay: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """df with its row's place (from 0) in an order, without gathering it: places inside range partitions, and one offset for each. `lay` stores the rows in between."""
    from pyspark.sql import functions as F

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = lay(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted(laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(out, place).drop("_part", "_before", "_id")
