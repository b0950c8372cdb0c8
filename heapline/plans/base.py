"""What all views share: the clean event tables, pauses, durations, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cluster import ONCE, once, table
from ..functions.ordered import sharded_once


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a view; ``sql`` follows the common WITH list (ev, pauses, meta, ...)."""

    def put(f):
        REGISTRY[name] = Query(f, PRELUDE + sql if sql else None)
        return f

    return put


def category(column: str = "event_class") -> Column:
    return F.expr(S.sql_category(column))


def events(
    spark: SparkSession,
    sf_dir: str,
    cols: Sequence[Column | str] = (),
    classes: Sequence[str] | None = None,
    where: Column | None = None,
    keep: str | None = None,
    ordered: bool = False,
    copies: bool = False,
) -> DataFrame:
    """gc_events with each (log_id, seq) once: log_id, seq, t_us, t_sec, event_class, duration_us and ``cols``.

    Class filters, column choice and ``keep`` (a predicate over the chosen
    columns) come before the removal of re-delivered rows; the rows of one event
    are the same but for their arrival.  Rows without log, sequence, time or class
    are left out.  ``ordered`` leaves the rows partitioned by (log_id, _shard) for
    the ordered functions; ``copies`` leaves re-delivered rows in.
    """
    ev = table(spark, sf_dir, "gc_events").filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL AND event_class IS NOT NULL")
    if classes is not None:
        ev = ev.filter(F.col("event_class").isin(list(classes)))
        if ONCE in ev.columns:  # a prepared table is partitioned by the family that its classes imply
            ev = ev.filter(F.col("family").isin(sorted({S.family(c) for c in classes})))
    if where is not None:
        ev = ev.filter(where)
    known = ONCE in ev.columns or copies
    got = ev.select("log_id", "seq", "t_us", "t_sec", "event_class", "duration_us", *cols)
    got = got.filter(keep) if keep else got
    return sharded_once(got) if ordered else once(got, ["log_id", "seq"], known)


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, seq, event_class, category, t_us, dur_us): stop-the-world pauses, ZGC cycles as their sub-pauses."""
    sub = F.array(*(F.struct(F.col(f"zgc.pauses.{p}.t_us").alias("t"), F.col(f"zgc.pauses.{p}.dur_us").alias("d")) for p in S.ZGC_PAUSES))
    own = F.array(F.struct(F.col("t_us").alias("t"), F.col("duration_us").alias("d")))
    ev = events(spark, sf_dir, [F.when(F.col("event_class").isin(list(S.ZGC)), sub).otherwise(own).alias("p")], (*S.GG, *S.ZGC))
    rows = ev.select("log_id", "seq", "event_class", category().alias("category"), F.posexplode("p").alias("sub", "x"))
    return rows.select("log_id", "seq", "sub", "event_class", "category", F.col("x.t").alias("t_us"), F.col("x.d").alias("dur_us")).filter("t_us IS NOT NULL AND dur_us > 0")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "log_meta").select("log_id", F.when(F.col("estimated_runtime_sec") > 0, F.col("estimated_runtime_sec")).alias("est"))


_SUB = " UNION ALL ".join(
    f"SELECT log_id, seq, {i} AS sub, event_class, category, zgc.pauses.{p}.t_us AS t_us, zgc.pauses.{p}.dur_us AS dur_us FROM ev WHERE event_class IN {S.sql_in(S.ZGC)}"
    for i, p in enumerate(S.ZGC_PAUSES)
)
PRELUDE = f"""WITH ev AS (
  SELECT *, {S.sql_category()} AS category FROM gc_events
  WHERE log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL AND event_class IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY log_id, seq ORDER BY arrived_at) = 1),
gg AS (SELECT * FROM ev WHERE event_class IN {S.sql_in(S.GG)}),
zg AS (SELECT * FROM ev WHERE event_class IN {S.sql_in(S.ZGC)}),
young AS (SELECT * FROM ev WHERE event_class IN {S.sql_in(S.G1_YOUNG)}),
pauses AS (
  SELECT * FROM (
    SELECT log_id, seq, 0 AS sub, event_class, category, t_us, duration_us AS dur_us FROM gg
    UNION ALL {_SUB}) WHERE t_us IS NOT NULL AND dur_us > 0),
meta AS (SELECT log_id, CASE WHEN estimated_runtime_sec > 0 THEN estimated_runtime_sec END AS est FROM log_meta),
sv AS (SELECT * FROM survivor_records WHERE log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY log_id, seq) = 1),
sp AS (SELECT * FROM safepoints WHERE log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY log_id, seq) = 1),
heaps AS (
  SELECT log_id, seq, t_us, t_sec, event_class, category, heap.valid AS valid, heap.occ_before AS ob, heap.occ_after AS oa,
         heap.size_before AS sb, heap.size_after AS sa, 1024e0 AS unit FROM gg
  UNION ALL
  SELECT log_id, seq, t_us, t_sec, event_class, category, zgc.memory IS NOT NULL AND zgc.capacity IS NOT NULL,
         zgc.memory.occ_before, zgc.memory.occ_after, zgc.capacity.max_capacity, zgc.capacity.max_capacity, 1048576e0 FROM zg)
"""


def heaps(spark: SparkSession, sf_dir: str, keep: str = "valid", ordered: bool = False) -> DataFrame:
    """(log_id, seq, t_us, t_sec, event_class, category, valid, ob, oa, sb, sa, unit): pools of KB or bytes, ``unit`` of them a MB; ``keep`` chooses rows by valid, ob, oa, sb and sa."""
    z = F.col("event_class").isin(list(S.ZGC))
    pick = lambda a, b: F.when(z, F.col(b)).otherwise(F.col(a))
    cols = [
        F.when(z, F.col("zgc.memory").isNotNull() & F.col("zgc.capacity").isNotNull()).otherwise(F.col("heap.valid")).alias("valid"),
        pick("heap.occ_before", "zgc.memory.occ_before").alias("ob"),
        pick("heap.occ_after", "zgc.memory.occ_after").alias("oa"),
        pick("heap.size_before", "zgc.capacity.max_capacity").alias("sb"),
        pick("heap.size_after", "zgc.capacity.max_capacity").alias("sa"),
    ]
    ev = events(spark, sf_dir, cols, (*S.GG, *S.ZGC), keep=keep, ordered=ordered)
    return ev.withColumns({"category": category(), "unit": F.when(z, F.lit(1048576.0)).otherwise(F.lit(1024.0))}).drop("duration_us")


def long_form(df: DataFrame, keys: Sequence[str], series: dict[str, Column], name: str = "series", value: str = "y") -> DataFrame:
    """One row per series whose value is not null."""
    cells = F.array(*(F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in series.items()))
    got = df.select(*keys, F.explode(cells).alias("c")).filter("c.v IS NOT NULL")
    return got.select(*keys, F.col("c.k").alias(name), F.col("c.v").alias(value))


def sql_long(source: str, keys: str, series: dict[str, str], name: str = "series", value: str = "y") -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {keys}, '{k}' AS {name}, {e} AS {value} FROM {source}" for k, e in series.items()) + f") WHERE {value} IS NOT NULL"
