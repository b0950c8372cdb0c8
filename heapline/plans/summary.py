"""The log summary: pauses by class, headline figures, notes and collector detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ordered import with_last, with_previous
from .base import events, meta, query

#: Gap below which two pauses are back to back, and the change of capacity that is a resize.
BACK_TO_BACK_US, RESIZE_KB = 10_000, 512

_NONNEG = [f"greatest(coalesce(zgc.pauses.{p}.dur_us, 0), 0)" for p in S.ZGC_PAUSES]
_PAUSE = f"CASE WHEN event_class IN {S.sql_in(S.ZGC)} THEN {' + '.join(_NONNEG)} ELSE greatest(duration_us, 0) END"
_MOST = f"CASE WHEN event_class IN {S.sql_in(S.ZGC)} THEN greatest({', '.join(_NONNEG)}) ELSE greatest(duration_us, 0) END"

STW_SQL = f""", stw AS (
  SELECT log_id, seq, t_us, event_class, gc_cause, {_PAUSE} AS pause_us, {_MOST} AS most_us,
         heap.valid AS valid, heap.occ_before AS ob, heap.occ_after AS oa, heap.size_after AS sa,
         event_class NOT IN {S.sql_in(S.ZGC)} AS is_gg
  FROM ev WHERE event_class IN {S.sql_in((*S.GG, *S.ZGC))}),
hv AS (
  SELECT *, ob - lag(oa) OVER w AS alloc_kb, abs(sa - lag(sa) OVER w) AS size_kb FROM stw
  WHERE is_gg AND valid AND ob IS NOT NULL AND oa IS NOT NULL AND sa IS NOT NULL WINDOW w AS (PARTITION BY log_id ORDER BY t_us, seq)),
iv AS (
  SELECT *, t_us - lag(t_us) OVER (PARTITION BY log_id, event_class ORDER BY t_us, seq) AS dt,
         t_us - lag(t_us + pause_us) OVER (PARTITION BY log_id ORDER BY t_us, seq) AS free FROM stw),
kb AS (SELECT log_id, event_class, CAST(sum(greatest(alloc_kb, 0)) AS BIGINT) AS alloc_kb, CAST(sum(greatest(ob - oa, 0)) AS BIGINT) AS recovered_kb,
              count(*) FILTER (size_kb > {RESIZE_KB}) AS resized FROM hv GROUP BY ALL),
per AS (
  SELECT log_id, event_class, count(*) AS n, CAST(sum(pause_us) AS BIGINT) AS pause_us, max(most_us) AS most_us,
         CAST(sum(dt) FILTER (dt > 0) AS BIGINT) AS dt_us, count(*) FILTER (dt > 0) AS dt_n,
         count(*) FILTER (free < {BACK_TO_BACK_US}) AS b2b, count(*) FILTER (gc_cause = 'ALLOC_STALL') AS stalls, min((t_us, seq)) AS f FROM iv GROUP BY ALL),
cls AS (SELECT per.*, coalesce(alloc_kb, 0) AS alloc_kb, coalesce(recovered_kb, 0) AS recovered_kb, coalesce(resized, 0) AS resized FROM per LEFT JOIN kb USING (log_id, event_class))
"""


def stw_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (log, event class): counts and sums of its stop-the-world events; everything else follows from it."""
    cols = ["gc_cause", F.expr(_PAUSE).alias("pause_us"), F.expr(_MOST).alias("most_us")]
    pool = [F.col(f"heap.{a}").alias(b) for a, b in (("valid", "valid"), ("occ_before", "ob"), ("occ_after", "oa"), ("size_after", "sa"))]
    stw = events(spark, sf_dir, [*cols, *pool], (*S.GG, *S.ZGC), ordered=True)
    usable = F.col("event_class").isin(list(S.GG)) & F.expr("valid AND ob IS NOT NULL AND oa IS NOT NULL AND sa IS NOT NULL")
    iv = with_last(stw, {"prev": (F.struct("oa", "sa"), usable), "ended": (F.col("t_us") + F.col("pause_us"), None)})
    iv = with_previous(iv, F.col("t_us"), "same", ("log_id", "event_class"))
    dt, free = F.col("t_us") - F.col("same"), F.col("t_us") - F.col("ended")
    kb = lambda x: F.coalesce(F.sum(F.when(usable, F.greatest(x, F.lit(0)))), F.lit(0))
    return iv.groupBy("log_id", "event_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pause_us").alias("pause_us"),
        F.max("most_us").alias("most_us"),
        F.sum(F.when(dt > 0, dt)).alias("dt_us"),
        F.count_if(dt > 0).alias("dt_n"),
        F.count_if(free < BACK_TO_BACK_US).alias("b2b"),
        F.count_if(F.col("gc_cause") == "ALLOC_STALL").alias("stalls"),
        F.min(F.struct("t_us", "seq")).alias("f"),
        kb(F.col("ob") - F.col("prev.oa")).alias("alloc_kb"),
        kb(F.col("ob") - F.col("oa")).alias("recovered_kb"),
        F.count_if(usable & (F.abs(F.col("sa") - F.col("prev.sa")) > RESIZE_KB)).alias("resized"),
    )


@query(
    "summary_stw_table",
    STW_SQL
    + """SELECT log_id, event_class, n, pause_us / 1e6 AS total_sec, pause_us / 1e3 / n AS avg_ms, most_us / 1e3 AS max_ms,
  CASE WHEN est > 0 THEN pause_us / 1e4 / est END AS pct_paused, CASE WHEN dt_n > 0 THEN dt_us / 1e6 / dt_n END AS interval_s,
  alloc_kb / 1024e0 AS alloc_mb, recovered_kb / 1024e0 AS recovered_mb,
  CAST(row_number() OVER (PARTITION BY log_id ORDER BY f) AS INTEGER) AS ord
FROM cls LEFT JOIN meta USING (log_id)""",
)
def summary_stw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = stw_classes(spark, sf_dir).join(meta(spark, sf_dir), "log_id", "left")
    return c.select(
        "log_id",
        "event_class",
        "n",
        (F.col("pause_us") / F.lit(1e6)).alias("total_sec"),
        (F.col("pause_us") / F.lit(1e3) / F.col("n")).alias("avg_ms"),
        (F.col("most_us") / F.lit(1e3)).alias("max_ms"),
        F.when(F.col("est") > 0, F.col("pause_us") / F.lit(1e4) / F.col("est")).alias("pct_paused"),
        F.when(F.col("dt_n") > 0, F.col("dt_us") / F.lit(1e6) / F.col("dt_n")).alias("interval_s"),
        (F.col("alloc_kb") / F.lit(1024.0)).alias("alloc_mb"),
        (F.col("recovered_kb") / F.lit(1024.0)).alias("recovered_mb"),
        F.row_number().over(Window.partitionBy("log_id").orderBy("f")).alias("ord"),
    )


def sql_collector(has: str, zgc: str, g1: str, cms: tuple[str, ...]) -> str:
    """``has``: predicate template over a class list inside an aggregate."""
    return f"""CASE WHEN {has.format(zgc)} THEN 'zgc' WHEN {has.format(g1)} THEN 'g1' WHEN {has.format("event_class IN " + S.sql_in(cms))} THEN 'cms'
  WHEN {has.format("event_class IN ('PSYoungGen', 'PSFullGC')")} THEN 'parallel' WHEN {has.format("event_class IN ('DefNew', 'FullGC')")} THEN 'serial' ELSE 'unknown' END"""


SUMMARY_COLLECTOR = sql_collector("bool_or({})", f"event_class IN {S.sql_in(S.ZGC)}", f"event_class IN {S.sql_in(S.G1_PAUSE)}", S.CMS_PAUSE)
ANALYTICS_COLLECTOR = sql_collector("bool_or({})", "event_class LIKE 'ZGC%'", "event_class LIKE 'G1%'", (*S.CMS_PAUSE, *S.CMS_CONCURRENT))


@query("collector_detect", f"SELECT log_id, {SUMMARY_COLLECTOR} AS summary_collector, {ANALYTICS_COLLECTOR} AS analytics_collector FROM ev GROUP BY log_id")
def collector_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivery changes no flag, so nothing is deduplicated and only one column is read beside the key."""
    from ..functions.cluster import table

    ev = table(spark, sf_dir, "gc_events").filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL AND event_class IS NOT NULL")
    return ev.groupBy("log_id").agg(F.expr(SUMMARY_COLLECTOR).alias("summary_collector"), F.expr(ANALYTICS_COLLECTOR).alias("analytics_collector"))


_HEAD = f"""SELECT log_id, collector, dur AS duration_s, pause_us / 1e6 AS total_pause_s,
  CASE WHEN dur > 0 THEN 1 - pause_us / 1e6 / dur ELSE 1e0 END AS mmu,
  CASE WHEN dur > 0 THEN pause_us / 1e4 / dur ELSE 0e0 END AS pct_paused,
  0e0 AS total_concurrent_s, 0e0 AS pct_concurrent,
  CASE WHEN dur > 0 THEN 100 * (1 - pause_us / 1e6 / dur) ELSE 100e0 END AS throughput_pct,
  alloc_kb / 1024e0 AS allocated_mb, recovered_kb / 1024e0 AS recovered_mb,
  CASE WHEN dur - pause_us / 1e6 > 0 THEN alloc_kb / 1024e0 / (dur - pause_us / 1e6) ELSE 0e0 END AS alloc_mb_per_s,
  CASE WHEN dur > 0 THEN recovered_kb / 1024e0 / dur ELSE 0e0 END AS recovered_mb_per_s,
  full_us / 1e6 AS full_pause_s, CASE WHEN pause_us > 0 THEN 1e2 * full_us / pause_us ELSE 0e0 END AS full_to_total_pct,
  b2b AS back_to_back, young_cycles, old_cycles, full_cycles, pause_us / 1e3 / n AS avg_pause_ms, stalls AS allocation_stalls FROM h"""
_HEAD_AGG = {
    "pause_us": "sum(pause_us)",
    "alloc_kb": "sum(alloc_kb)",
    "recovered_kb": "sum(recovered_kb)",
    "full_us": f"sum(CASE WHEN event_class IN {S.sql_in(S.SUMMARY_FULL)} THEN pause_us ELSE 0 END)",
    "b2b": "sum(b2b)",
    "n": "sum(n)",
    "young_cycles": "sum(CASE WHEN event_class = 'ZGCYoungCollection' THEN n ELSE 0 END)",
    "old_cycles": "sum(CASE WHEN event_class = 'ZGCOldCollection' THEN n ELSE 0 END)",
    "full_cycles": "sum(CASE WHEN event_class = 'ZGCFullCollection' THEN n ELSE 0 END)",
    "stalls": f"sum(CASE WHEN event_class IN {S.sql_in(S.ZGC)} THEN stalls ELSE 0 END)",
}


@query(
    "summary_headline",
    STW_SQL
    + f""", h0 AS (SELECT log_id, {SUMMARY_COLLECTOR} AS collector, {", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in _HEAD_AGG.items())} FROM cls GROUP BY log_id),
h AS (SELECT h0.*, coalesce(est, 0e0) AS dur FROM h0 LEFT JOIN meta USING (log_id)) """
    + _HEAD,
)
def summary_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stw_classes(spark, sf_dir).groupBy("log_id").agg(F.expr(SUMMARY_COLLECTOR).alias("collector"), *(F.expr(e).alias(k) for k, e in _HEAD_AGG.items()))
    h = h.join(meta(spark, sf_dir), "log_id", "left").withColumn("dur", F.coalesce("est", F.lit(0.0)))
    return spark.sql(_HEAD.replace("FROM h", "FROM {h}"), h=h)


_NOTES = {
    "heap_resized": "sum(resized)",
    "back_to_back": "sum(b2b)",
    "initial_marks": "sum(CASE WHEN event_class = 'G1YoungInitialMark' THEN n ELSE 0 END)",
    "allocation_stalls": f"sum(CASE WHEN event_class IN {S.sql_in(S.ZGC)} THEN stalls ELSE 0 END)",
}


@query("summary_notes", STW_SQL + f"SELECT log_id, {', '.join(f'CAST({e} AS BIGINT) AS {k}' for k, e in _NOTES.items())}, CAST(0 AS BIGINT) AS to_space_exhausted, CAST(0 AS BIGINT) AS cms_aborts FROM cls GROUP BY log_id")
def summary_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    got = stw_classes(spark, sf_dir).groupBy("log_id").agg(*(F.expr(e).alias(k) for k, e in _NOTES.items()))
    return got.withColumns({"to_space_exhausted": zero, "cms_aborts": zero})


_CONCURRENT = (*S.G1_CONCURRENT, *S.CMS_CONCURRENT)


@query(
    "summary_concurrent_table",
    f""", c AS (SELECT log_id, event_class, count(*) AS n, CAST(sum(greatest(duration_us, 0)) AS BIGINT) AS us, greatest(max(duration_us), 0) AS most,
  CAST(sum(CAST(round((coalesce(cpu.user, 0) + coalesce(cpu.kernel, 0)) * 1e6) AS BIGINT)) AS BIGINT) AS cpu_us, count(*) FILTER (aborted) AS aborted
  FROM ev WHERE event_class IN {S.sql_in(_CONCURRENT)} GROUP BY ALL)
SELECT log_id, event_class, n, us / 1e6 AS wall_sec, cpu_us / 1e6 AS cpu_sec, us / 1e6 / n AS avg_sec, most / 1e6 AS max_sec,
  CASE WHEN est > 0 THEN us / 1e4 / est END AS pct_concurrent, aborted FROM c LEFT JOIN meta USING (log_id)""",
)
def summary_concurrent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concurrent phases by class: an extension, the headline's concurrent totals stay 0."""
    cpu = F.coalesce(F.col("cpu.user"), F.lit(0.0)) + F.coalesce(F.col("cpu.kernel"), F.lit(0.0))
    ev = events(spark, sf_dir, [F.round(cpu * F.lit(1e6)).cast("bigint").alias("cpu_us"), "aborted"], _CONCURRENT)
    c = ev.groupBy("log_id", "event_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest("duration_us", F.lit(0))).alias("us"), F.greatest(F.max("duration_us"), F.lit(0)).alias("most"),
        F.sum("cpu_us").alias("cpu_us"), F.count_if("aborted").alias("aborted"),
    ).join(meta(spark, sf_dir), "log_id", "left")
    return c.select(
        "log_id", "event_class", "n", (F.col("us") / F.lit(1e6)).alias("wall_sec"), (F.col("cpu_us") / F.lit(1e6)).alias("cpu_sec"),
        (F.col("us") / F.lit(1e6) / F.col("n")).alias("avg_sec"), (F.col("most") / F.lit(1e6)).alias("max_sec"),
        F.when(F.col("est") > 0, F.col("us") / F.lit(1e4) / F.col("est")).alias("pct_concurrent"), "aborted",
    )
