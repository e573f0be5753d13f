"""The package on the workers, tables in the shared folder, and small tables spread over the cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application; the driver serves it until it ends."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="inkwell-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "inkwell_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = sc.getConf().get("inkwell.own.dir") or tempfile.mkdtemp(prefix="inkwell-")
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(rows: DataFrame, small: DataFrame, key: str | list[str], most: int = 500_000) -> DataFrame:
    """``rows`` joined with ``small``, which is handed to every task only where it has no more than ``most`` rows."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, key)


#: Tables up to this size on disk may sit in one row group, which one task would have to read alone.
SPREAD_BYTES = 32 * 1024 * 1024


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table over all cores, by the hash of ``key``; larger ones keep the partitions of their files.

    A scan can't split a row group, so without this a table of one row group is
    worked on by one core, whatever follows. The size is the plan's estimate.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if size <= SPREAD_BYTES and cores > 1 else df
