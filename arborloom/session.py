"""Session helpers: local sessions, lineage cuts in the shared folder, checked broadcasts, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; a wider side is given its own bound by the caller.
BROADCAST_ROWS = 200_000
#: Bytes of Parquet that a broadcast side may have.
BROADCAST_BYTES = 16 << 20


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "arborloom") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in a one-process session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="arborloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def _path_of(spark: SparkSession, path: str):
    """File system and path object of a folder."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def written(df: DataFrame, tag: str, to: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back; with ``to``, beside the rows of that written table.

    The table is computed once, survives lost executors, and is removed by ``dropped`` or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arborloom-{tag}-{uuid.uuid4().hex}" if to is None else to._arborloom_path
    df.write.mode("errorifexists" if to is None else "append").parquet(path)
    fs, hadoop_path = _path_of(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborloom_path = path
    return out


def named(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a projection of a written table, as the holder of that table for ``dropped``."""
    df._arborloom_path = table._arborloom_path
    return df


def dropped(df: DataFrame) -> None:
    """Remove the table of ``written`` that no later plan reads."""
    if path := getattr(df, "_arborloom_path", None):
        fs, hadoop_path = _path_of(df.sparkSession, path)
        fs.delete(hadoop_path, True)


def removed(spark: SparkSession, files: list[str]) -> None:
    """Remove single files of a written table that no later plan reads."""
    for file in files:
        fs, hadoop_path = _path_of(spark, file)
        fs.delete(hadoop_path, False)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes as Parquet; otherwise without a mark, for a shuffled join.

    The side is computed once: it is written first, unless it is a written table already, and its files are measured.
    """
    table = df if hasattr(df, "_arborloom_path") else written(df, "side")
    fs, hadoop_path = _path_of(df.sparkSession, table._arborloom_path)
    small = fs.getContentSummary(hadoop_path).getLength() <= size and table.count() <= rows
    return F.broadcast(table) if small else table


def once_each(rows: DataFrame, key: str, pick: Callable[[DataFrame], DataFrame], tag: str = "repeated") -> DataFrame:
    """``rows`` with each key once: ``pick`` reduces the rows of repeated keys, the others stay where they are.

    Only keys and the rows of repeated keys are shuffled, not the content of all rows. Null keys are left out.
    """
    again = small_side(written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), tag))
    once = rows.where(F.col(key).isNotNull()).join(again, key, "left_anti")
    return once.unionByName(pick(rows.join(again, key, "left_semi")))


def ship_code(spark: SparkSession) -> None:
    """Send the package to workers that may not have it on their path, once a session; in a one-process session only if
    neither PYTHONPATH nor the working folder leads to it.
    """
    if getattr(spark.sparkContext, "_arborloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    seen = [Path(x).resolve() for x in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if x]
    if is_local(spark) and here.parent in seen:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="arborloom-code-"), "arborloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._arborloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
