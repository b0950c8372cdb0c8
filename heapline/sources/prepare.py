"""Clean tables, written once for many views.

Every view removes re-delivered rows, which costs a shuffle of the columns it
reads.  Where many views are to run, ``prepare`` does that once for all columns
and lays the events out by family, log and time: views over the result scan only
the families they need, skip row groups of other logs, and shuffle nothing unless
they need order or groups.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cluster import ONCE, table

_TABLES = ("gc_events", "survivor_records", "safepoints")


def prepare(spark: SparkSession, folder: str, target: str) -> None:
    """Write clean copies of the event tables of ``folder`` to ``target``, and log_meta as it is.

    One copy of each (log_id, seq) is kept, they differ in their arrival only;
    rows without log, sequence or time are left out.
    """
    for name in _TABLES:
        rows = table(spark, folder, name).filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL")
        rows = rows.dropDuplicates(["log_id", "seq"]).withColumn(ONCE, F.lit(True))
        if name == "gc_events":
            by_class = [(c, S.family(c)) for c in (*S.GG, *S.G1_CONCURRENT, *S.CMS_CONCURRENT, *S.ZGC)]
            implied = F.try_element_at(F.create_map(*(F.lit(x) for pair in by_class for x in pair)), F.col("event_class"))
            rows = rows.withColumn("family", F.coalesce(implied, F.col("family")))
            laid = rows.repartitionByRange("family", "log_id", "t_us").sortWithinPartitions("family", "log_id", "t_us")
            laid.write.mode("overwrite").partitionBy("family").parquet(f"{target}/{name}.parquet")
        else:
            rows.repartitionByRange("log_id", "t_us").sortWithinPartitions("log_id", "t_us").write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    table(spark, folder, "log_meta").write.mode("overwrite").parquet(f"{target}/log_meta.parquet")
