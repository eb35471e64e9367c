"""Session helpers: shared working folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, unless their environment has its folder on the path already."""
    package = os.path.dirname(os.path.abspath(__file__))
    home = os.path.dirname(package)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if home in known or (local and os.path.abspath(os.getcwd()) == home) or spark.sparkContext.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="lessonloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/lessonloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", home))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lessonloom-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    The files carry sizes, so later joins are planned on facts. They stay until the folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is under the bound, else unchanged.

    ``df`` has to be cheap to count (a written table); ``row_bytes`` is the width a row takes in memory.
    """
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows and n * row_bytes <= BROADCAST_BYTES else df


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hashes of ``key``; a hash bound first, so tasks don't each send as many."""
    n = df.count()
    if n <= rows:
        return df
    h = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    return df.filter(h < int(min(1.0, (1.5 * rows + 100) / n) * (1 << 32))).orderBy(h, key).limit(rows)


def tables(spark: SparkSession, sf_dir: str):
    """Reader ``t(name)`` for the parquet tables of one folder."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
