"""Sessions and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict = {}
_STAGED: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "fairloom", **conf) -> SparkSession:
    """A session with the settings the operators count on; conf overrides them."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per context, so that they need no installation."""
    sc = spark.sparkContext
    if _SHIPPED.get("context") is sc:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # else it runs from a zip file that has been sent
        path = Path(tempfile.mkdtemp(prefix="fairloom-"), "fairloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in root.rglob("*.py"):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
    _SHIPPED["context"] = sc


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where neither is set and the master is local, a temporary folder is made.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fairloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """Write df once as Parquet below the shared folder and read it back: cuts lineage, survives lost executors.

    The files go away when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _STAGED:
        atexit.register(release)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what stage() wrote; DataFrames over it can't be read afterwards."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, its folder too or left to its owner
            pass


def broadcast_if_small(df: DataFrame, rows: int, bound: int = 200_000) -> DataFrame:
    """A broadcast hint only for a side whose counted rows keep within bound; else Spark shuffles and AQE splits skew."""
    return F.broadcast(df) if rows <= bound else df
