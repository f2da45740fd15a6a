"""Session defaults, shared folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "ferrule", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or a new local one where it is unset and the master is local.

    A cluster without the setting is an error: its executors can't read the driver's folders.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here is None:
        here = spark.conf.get("spark.checkpoint.dir", None)
        if here is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = here or tempfile.mkdtemp(prefix="spark-ferrule-")
        sc.setCheckpointDir(here)
    return here


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/ferrule-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder: what follows survives the loss of executors.

    Unlike a checkpoint, a written table tells the planner its true size. (A checkpoint keeps the estimate of its
    plan, which joins multiply; over the rounds of a loop that number alone takes minutes to compute.)
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """A cut table and how many of its rows meet a condition, counted while it is written (0 is exact, retries may raise more)."""
    seen = Observation()
    written = cut(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return written, seen.get.get("n", 0)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's cut tables; call it after the results that come from them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library to the Python workers, as --py-files would; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # else the library itself was loaded from a zip that the workers have
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-ferrule-")) / package.name), "zip", package.parent, package.name)
        sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
