"""Session builder and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC on. ``master`` is left to spark-submit when None."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8" if (master or "").startswith("local") else "400",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves local sessions only; a cluster must name one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _MADE:
        d = tempfile.mkdtemp(prefix="lexiloom-")
        _MADE.append(f"file://{d}")
    return _MADE[0]


_TABLES: list[str] = []


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``by`` makes a folder for each value, which reads can skip.

    This cuts the lineage in a way that survives the loss of any executor, and the column pruning of later reads still works.
    The tables stay until ``release`` or the end of the process, since results may still be read from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialise`` of what ``make`` gives. The tables that ``make`` wrote on the way are deleted then, so nothing else may read them."""
    kept = len(_TABLES)
    out = materialise(make(), name)
    _drop(_TABLES[kept:-1])
    del _TABLES[kept:-1]
    return out


def _drop(paths: list[str]) -> None:
    gateway = SparkContext._gateway
    try:
        if gateway is not None and paths:
            conf = gateway.jvm.org.apache.hadoop.conf.Configuration()
            for t in paths:
                path = gateway.jvm.org.apache.hadoop.fs.Path(t)
                path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone by now
        pass


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables that were written inside; for sessions that stay up. Results must be read or saved before."""
    kept = len(_TABLES)
    try:
        yield
    finally:
        _drop(_TABLES[kept:])
        del _TABLES[kept:]


def release() -> None:
    """Deletes all tables ``materialise`` wrote in this process; results not yet read are lost with them."""
    _drop(_TABLES)
    _TABLES.clear()
    for d in _MADE:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)
    _MADE.clear()


atexit.register(release)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
