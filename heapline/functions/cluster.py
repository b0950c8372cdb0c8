"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where
    that is unset, a local session (tests, laptops) gets a temporary folder that
    goes with the process; on a cluster, whose executors do not share one, it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="heapline-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows up to which a counted side of a join is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written and counted (a checkpoint has no statistics), to be broadcast if it has at most so many rows of a few numbers each."""
    df = shared_checkpoint(df)
    return F.broadcast(df) if df.count() <= rows else df


#: Column that marks a table whose rows are known to be delivered once (sources.prepare).
ONCE = "delivered_once"


def once(df: DataFrame, keys: list[str], known: bool) -> DataFrame:
    """Each key once, without work where the table is known to hold it once.

    Copies are few, so the rows go to their partition as they are: looking for
    copies before the shuffle would sort them twice.
    """
    return df if known else df.repartition(*keys).dropDuplicates(keys)


_ONLY: ContextVar[tuple[int | None, frozenset[int]]] = ContextVar("_ONLY", default=(None, frozenset()))


@contextmanager
def only_logs(log_id: int | None, dropped: frozenset[int] = frozenset()) -> Iterator[None]:
    """Tables read inside hold the rows of this log only, or of all but the dropped ones; the filter reaches the scan."""
    token = _ONLY.set((log_id, dropped))
    try:
        yield
    finally:
        _ONLY.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    log_id, dropped = _ONLY.get()
    if "log_id" in df.columns:
        if dropped:
            df = df.filter(~F.col("log_id").isin(sorted(dropped)))
        if log_id is not None:
            df = df.filter(F.col("log_id") == log_id)
    return df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, wherever the driver found it; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_heapline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="heapline-"), "heapline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)  # the driver serves it to the executors
    sc._heapline_shipped = True
