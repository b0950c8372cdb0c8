"""Figures about a log: trends, worst windows, clusters, causes, runs; with the grade that each figure gets.

One scan aggregates what needs no order (``facts``); windows, trends and runs
have plans of their own.  Thresholds are parameters with their defaults below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cluster import shared_checkpoint
from ..functions.ordered import with_previous, with_running_sum
from ..functions.stats import ERF_A, ERF_P, trend_frame
from .base import PRELUDE, REGISTRY, category, events, meta, pauses, query
from .summary import ANALYTICS_COLLECTOR
from .views import survivors

# Thresholds.
WARM_UP_US = 60_000_000
PROMOTION = (0.10, 0.15)
INDICATOR_SIGNIFICANT = 5
FREQUENCY_PER_SEC, FREQUENCY_SHARE = 5, 0.10
STALLS_PER_MIN = 1.0
STABILITY_SAMPLES, STABILITY_P, STABILITY_MB_PER_HOUR = (20, 5000), 0.05, 10.0
THROUGHPUT = {"window": 1_800_000_000, "step": 60_000_000}
CLUSTER = {"window": 10_000_000, "step": 1_000_000, "warn": 90.0, "significant": 70.0}
PERIODIC = {"cv": 0.30, "calls": 5, "mean": (1.0, 86400.0)}
FULL_GC_SIGNIFICANT = 3
CPU = {"ratio": 1.5, "wall": 0.05, "kernel": 0.02}
DURATION = (3600.0, 86400.0)
WARN_MS = "CASE WHEN collector = 'zgc' THEN 10e0 WHEN collector IN ('parallel', 'serial') THEN 500e0 ELSE 200e0 END"
SIGNIFICANT_MS = "CASE WHEN collector = 'zgc' THEN 50e0 ELSE 1000e0 END"
TARGET_PCT = "CASE WHEN collector = 'zgc' THEN 99.9e0 ELSE 95e0 END"

_EXPLICIT = ("DIAGNOSTIC_COMMAND", "JVMTI_FORCE_GC", "HEAP_DUMP", "HEAP_INSPECTION")
_ISF = "category = 'FULL'"
_HASCPU = f"event_class IN {S.sql_in(S.GG)} AND (coalesce(cpu_user, 0) > 0 OR coalesce(cpu_kernel, 0) > 0 OR coalesce(cpu_wall, 0) > 0)"


def _n(where: str) -> str:
    return f"sum(CASE WHEN {where} THEN 1 ELSE 0 END)"


_TOTAL = "(coalesce(cpu_user, 0) + coalesce(cpu_kernel, 0))"
FACTS = {
    "events": "count(*)",
    "g1_events": _n("event_class LIKE 'G1%'"),
    "first_us": "min(t_us)",
    "last_us": "max(t_us)",
    "system_gcs": _n("gc_cause = 'JAVA_LANG_SYSTEM'"),
    "explicit_gcs": _n(f"gc_cause IN {S.sql_in(_EXPLICIT)}"),
    "lockers": _n("gc_cause = 'GC_LOCKER'"),
    "stalls": _n("gc_cause = 'ALLOC_STALL'"),
    "metaspace_gcs": _n("gc_cause = 'METADATA_GENERATION_THRESHOLD'"),
    "last_metaspace_us": "max(CASE WHEN gc_cause = 'METADATA_GENERATION_THRESHOLD' THEN t_us END)",
    "full_gcs": _n(_ISF),
    "full_us": f"sum(CASE WHEN {_ISF} THEN duration_us ELSE 0 END)",
    "mark_aborts": _n("event_class = 'G1ConcurrentMark' AND aborted"),
    "overflows": _n("event_class = 'G1ConcurrentMarkResetForOverflow'"),
    "to_space": _n(f"event_class IN {S.sql_in(S.G1_YOUNG)} AND to_space_exhausted"),
    "cpu_pauses": _n(_HASCPU),
    "kernel_over_user": _n(f"{_HASCPU} AND coalesce(cpu_kernel, 0) > coalesce(cpu_user, 0)"),
    "single_thread": _n(f"{_HASCPU} AND cpu_wall >= {CPU['wall']}e0 AND {_TOTAL} <= cpu_wall * {CPU['ratio']}e0"),
    "kernel_share": _n(f"{_HASCPU} AND {_TOTAL} > 0 AND coalesce(cpu_kernel, 0) / {_TOTAL} >= {CPU['kernel']}e0"),
}
_FACTS_SQL = (
    f""", fev AS (SELECT *, cpu.user AS cpu_user, cpu.kernel AS cpu_kernel, cpu.wall AS cpu_wall FROM ev),
f0 AS (SELECT log_id, {ANALYTICS_COLLECTOR} AS collector, {", ".join(f"CAST({e} AS BIGINT) AS {k}" for k, e in FACTS.items())} FROM fev GROUP BY log_id),
facts AS (SELECT f0.*, coalesce(est, greatest(last_us - first_us, 0) / 1e6) AS dur FROM f0 LEFT JOIN meta USING (log_id)) """
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log, from one scan; ``metaspace_late``: the metaspace-triggered collections after the warm-up, if any."""
    cols = ["gc_cause", "aborted", "to_space_exhausted", *(F.col(f"cpu.{k}").alias(f"cpu_{k}") for k in ("user", "kernel", "wall"))]
    ev = events(spark, sf_dir, cols).withColumn("category", category())
    f = ev.groupBy("log_id").agg(F.expr(ANALYTICS_COLLECTOR).alias("collector"), *(F.expr(e).alias(k) for k, e in FACTS.items()))
    f = f.join(meta(spark, sf_dir), "log_id", "left")
    return f.withColumn("dur", F.coalesce("est", F.greatest(F.col("last_us") - F.col("first_us"), F.lit(0)) / F.lit(1e6))).drop("est")


def _from_facts(name: str, columns: str, where: str = "true") -> None:
    """A finding that follows from the facts of a log alone; its expressions hold in both dialects."""
    text = f"SELECT log_id, {columns} FROM {{facts}} WHERE {where}"

    def run(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
        return spark.sql(text, facts=f if f is not None else facts(spark, sf_dir))

    query(name, _FACTS_SQL + text.replace("{facts}", "facts"))(run)


def _grade(significant: str, concerning: str) -> str:
    return f"CASE WHEN {significant} THEN 'SIGNIFICANT' WHEN {concerning} THEN 'CONCERNING' ELSE 'OK' END AS impact"


_LATE = f"last_metaspace_us - first_us >= {WARM_UP_US}"
_WORST = "greatest(full_gcs, mark_aborts, overflows, to_space)"
_CPU_WORST = "greatest(kernel_over_user, single_thread, kernel_share)"
_PER_MIN = "CASE WHEN dur > 0 THEN stalls * 60e0 / dur ELSE 0e0 END"
_from_facts("an_metaspace", f"metaspace_gcs, {_grade('false', _LATE)}")
_from_facts("an_heap_small_indicators", f"full_gcs, mark_aborts, overflows, to_space, {_grade(f'{_WORST} >= {INDICATOR_SIGNIFICANT}', f'{_WORST} > 0')}", "collector IN ('g1', 'cms', 'unknown')")
_from_facts("an_heap_small_stalls", f"stalls, {_PER_MIN} AS per_min, {_grade(f'{_PER_MIN} >= {STALLS_PER_MIN}e0', 'stalls > 0')}", "collector = 'zgc'")
_from_facts("an_system_gc", f"system_gcs, {_grade('false', 'system_gcs > 0')}")
_from_facts("an_diagnostic_gc", "explicit_gcs, 'CONCERNING' AS impact", "explicit_gcs > 0 AND collector NOT IN ('parallel', 'serial')")
_from_facts("an_gclocker", f"lockers, {_grade('false', 'lockers > 0')}")
_from_facts("an_full_gc", f"full_gcs, full_us / 1e6 AS full_sec, {_grade(f'full_gcs >= {FULL_GC_SIGNIFICANT}', 'full_gcs > 0')}", "collector IN ('g1', 'cms', 'unknown')")
_from_facts("an_cpu", f"cpu_pauses, kernel_over_user, single_thread, kernel_share, {_grade(f'{_CPU_WORST} > 0 AND {_CPU_WORST} * 4 >= cpu_pauses', f'{_CPU_WORST} > 0')}", "cpu_pauses > 0")
_from_facts("an_log_duration", f"dur AS duration_s, {_grade(f'dur < {DURATION[0]}e0', f'dur < {DURATION[1]}e0')}", "dur > 0")


@query(
    "an_premature",
    _FACTS_SQL
    + f""", s AS (SELECT log_id, count(*) AS records, count(*) FILTER (calculated_threshold < max_threshold) AS premature FROM sv GROUP BY log_id),
r AS (SELECT log_id, coalesce(records, 0) AS records, coalesce(premature, 0) AS premature, CASE WHEN records > 0 THEN premature * 1e0 / records ELSE 0e0 END AS ratio FROM facts LEFT JOIN s USING (log_id) WHERE collector = 'g1')
SELECT *, {_grade(f"ratio >= {PROMOTION[1]}e0", f"ratio >= {PROMOTION[0]}e0")} FROM r""",
)
def an_premature(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    s = survivors(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("calculated_threshold") < F.col("max_threshold")).alias("premature"))
    f = f if f is not None else facts(spark, sf_dir)
    got = f.filter("collector = 'g1'").select("log_id").join(s, "log_id", "left").fillna(0, ["records", "premature"])
    got = got.withColumn("ratio", F.when(F.col("records") > 0, F.col("premature") * F.lit(1.0) / F.col("records")).otherwise(F.lit(0.0)))
    return got.withColumn("impact", F.expr(_grade(f"ratio >= {PROMOTION[1]}e0", f"ratio >= {PROMOTION[0]}e0").removesuffix(" AS impact")))


def _graded_pauses(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    if p is not None:
        return p
    f = f if f is not None else facts(spark, sf_dir)
    return pauses(spark, sf_dir).join(f.select("log_id", "collector", "dur"), "log_id")


_PAUSE_LIMITS = f", pl AS (SELECT pauses.*, collector, dur, {WARN_MS} AS warn_ms, {SIGNIFICANT_MS} AS sig_ms FROM pauses JOIN facts USING (log_id)) "


@query(
    "an_high_pause",
    _FACTS_SQL
    + _PAUSE_LIMITS
    + f""", a AS (SELECT log_id, count(*) AS n, max(dur_us) / 1e3 AS max_ms, any_value(warn_ms) AS warn_ms, any_value(sig_ms) AS sig_ms,
  count(*) FILTER (dur_us / 1e3 > warn_ms) AS over_warn, count(*) FILTER (dur_us / 1e3 > sig_ms) AS over_sig FROM pl GROUP BY log_id)
SELECT *, {_grade("max_ms > sig_ms", "max_ms > warn_ms")} FROM a""",
)
def an_high_pause(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    p = _graded_pauses(spark, sf_dir, f, p).withColumns({"warn_ms": F.expr(WARN_MS), "sig_ms": F.expr(SIGNIFICANT_MS), "ms": F.col("dur_us") / F.lit(1e3)})
    a = p.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ms").alias("max_ms"), F.max("warn_ms").alias("warn_ms"), F.max("sig_ms").alias("sig_ms"),
        F.count_if(F.col("ms") > F.col("warn_ms")).alias("over_warn"), F.count_if(F.col("ms") > F.col("sig_ms")).alias("over_sig"),
    )
    return a.withColumn("impact", F.expr(_grade("max_ms > sig_ms", "max_ms > warn_ms").removesuffix(" AS impact")))


_PCTS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(
    "an_distribution",
    _FACTS_SQL
    + _PAUSE_LIMITS
    + f""", a AS (SELECT log_id, count(*) AS n, {", ".join(f"quantile_cont(CAST(dur_us AS DOUBLE), {q}) / 1e3 AS {k}" for k, q in _PCTS.items())}, max(dur_us) / 1e3 AS max_ms, any_value(warn_ms) AS warn_ms, any_value(sig_ms) AS sig_ms FROM pl GROUP BY log_id)
SELECT log_id, n, {", ".join(f"round({k}, 6) AS {k}" for k in _PCTS)}, max_ms, {_grade("p99 > sig_ms", "p99 > warn_ms")} FROM a""",
)
def an_distribution(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    """Exact percentiles from the counts of distinct durations, which are added up before they meet in one task a log."""
    p = p if p is not None else pauses(spark, sf_dir)
    counted = p.groupBy("log_id", "dur_us").agg(F.count(F.lit(1)).alias("k"))
    a = counted.groupBy("log_id").agg(F.sum("k").alias("n"), F.percentile(F.col("dur_us").cast("double"), list(_PCTS.values()), F.col("k")).alias("p"), (F.max("dur_us") / F.lit(1e3)).alias("max_ms"))
    f = f if f is not None else facts(spark, sf_dir)
    a = a.join(f.select("log_id", F.expr(WARN_MS).alias("warn_ms"), F.expr(SIGNIFICANT_MS).alias("sig_ms")), "log_id")
    p99 = F.col("p")[3] / F.lit(1e3)
    impact = F.when(p99 > F.col("sig_ms"), "SIGNIFICANT").when(p99 > F.col("warn_ms"), "CONCERNING").otherwise("OK")
    return a.select("log_id", "n", *(F.round(F.col("p")[i] / F.lit(1e3), 6).alias(k) for i, k in enumerate(_PCTS)), "max_ms", impact.alias("impact"))


def _worst_sql(window: int, step: int) -> str:
    """worst(log_id, k, t0, stw_us, n): the window of most pause; pauses count whole, in the windows that hold their start."""
    return f""", b AS (SELECT log_id, min(t_us) AS t0, CAST(floor(any_value(dur) * 1e6) AS BIGINT) AS log_us FROM pauses JOIN facts USING (log_id) GROUP BY log_id),
hit AS (SELECT p.log_id, t0, unnest(generate_series(CASE WHEN t_us - t0 < {window} THEN 0 ELSE (t_us - t0 - {window}) // {step} + 1 END, least((t_us - t0) // {step}, (log_us - {window}) // {step}))) AS k, p.dur_us AS d
        FROM pauses p JOIN b USING (log_id) WHERE b.log_us >= {window}),
w AS (SELECT log_id, t0, k, CAST(sum(d) AS BIGINT) AS stw_us, count(*) AS n FROM hit GROUP BY ALL),
worst AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY stw_us DESC, k) = 1) """


def _worst(p: DataFrame, window: int, step: int) -> DataFrame:
    b = p.groupBy("log_id").agg(F.min("t_us").alias("t0"), F.floor(F.max("dur") * F.lit(1e6)).cast("bigint").alias("log_us")).filter(F.col("log_us") >= window)
    hit = p.select("log_id", "t_us", "dur_us").join(b, "log_id").withColumn("dt", F.col("t_us") - F.col("t0"))
    lo = F.expr(f"CASE WHEN dt < {window} THEN 0 ELSE (dt - {window}) div {step} + 1 END").cast("bigint")
    hi = F.least(F.expr(f"dt div {step}"), F.expr(f"(log_us - {window}) div {step}"))
    hit = hit.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").select("log_id", "t0", "dur_us", F.explode(F.sequence("lo", "hi")).alias("k"))
    w = hit.groupBy("log_id", "t0", "k").agg(F.sum("dur_us").alias("stw_us"), F.count(F.lit(1)).alias("n"))
    best = w.groupBy("log_id", "t0").agg(F.max_by(F.struct("k", "stw_us", "n"), F.struct(F.col("stw_us"), -F.col("k"))).alias("x"))
    return best.select("log_id", "t0", "x.*")


@query(
    "an_throughput",
    _FACTS_SQL
    + _worst_sql(THROUGHPUT["window"], THROUGHPUT["step"])
    + f""", a AS (SELECT log_id, any_value(dur) AS duration_s, any_value({TARGET_PCT}) AS target_pct, CAST(sum(dur_us) AS BIGINT) / 1e6 AS stw_s FROM pauses JOIN facts USING (log_id) WHERE dur > 0 GROUP BY log_id),
r AS (SELECT a.*, 100 * (1 - stw_s / duration_s) AS overall_pct, 100 * (1 - stw_us / {THROUGHPUT["window"]}e0) AS worst_pct, (t0 + k * {THROUGHPUT["step"]}) / 1e6 AS worst_start_s FROM a LEFT JOIN worst USING (log_id))
SELECT *, {_grade("overall_pct < target_pct", "worst_pct < target_pct")} FROM r""",
)
def an_throughput(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    p = _graded_pauses(spark, sf_dir, f, p)
    a = p.filter("dur > 0").groupBy("log_id").agg(F.max("dur").alias("duration_s"), F.max(F.expr(TARGET_PCT)).alias("target_pct"), (F.sum("dur_us") / F.lit(1e6)).alias("stw_s"))
    r = a.join(_worst(p, **THROUGHPUT), "log_id", "left").select(
        "log_id", "duration_s", "target_pct", "stw_s",
        (F.lit(100) * (1 - F.col("stw_s") / F.col("duration_s"))).alias("overall_pct"),
        (F.lit(100) * (1 - F.col("stw_us") / F.lit(float(THROUGHPUT["window"])))).alias("worst_pct"),
        ((F.col("t0") + F.col("k") * THROUGHPUT["step"]) / F.lit(1e6)).alias("worst_start_s"),
    )
    return r.withColumn("impact", F.expr(_grade("overall_pct < target_pct", "worst_pct < target_pct").removesuffix(" AS impact")))


_CLUSTER_GRADE = _grade(f"worst_pct < {CLUSTER['significant']}e0", f"worst_pct < {CLUSTER['warn']}e0")


@query(
    "an_clustering",
    _FACTS_SQL
    + _worst_sql(CLUSTER["window"], CLUSTER["step"])
    + f""", r AS (SELECT log_id, 100 * (1 - stw_us / {CLUSTER["window"]}e0) AS worst_pct, n, stw_us / 1e6 AS stw_s, (t0 + k * {CLUSTER["step"]}) / 1e6 AS start_s FROM worst JOIN facts USING (log_id) WHERE dur >= {2 * CLUSTER["window"] // 1000000})
SELECT *, {_CLUSTER_GRADE} FROM r""",
)
def an_clustering(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    p = _graded_pauses(spark, sf_dir, f, p).filter(F.col("dur") >= 2 * CLUSTER["window"] / 1e6)
    w = _worst(p, CLUSTER["window"], CLUSTER["step"])
    r = w.select("log_id", (F.lit(100) * (1 - F.col("stw_us") / F.lit(float(CLUSTER["window"])))).alias("worst_pct"), "n", (F.col("stw_us") / F.lit(1e6)).alias("stw_s"), ((F.col("t0") + F.col("k") * CLUSTER["step"]) / F.lit(1e6)).alias("start_s"))
    return r.withColumn("impact", F.expr(_CLUSTER_GRADE.removesuffix(" AS impact")))


_FREQ_GRADE = _grade(f"most > {FREQUENCY_PER_SEC} AND violating * 1e0 / seconds >= {FREQUENCY_SHARE}e0", f"most > {FREQUENCY_PER_SEC}")


@query(
    "an_heap_small_frequency",
    _FACTS_SQL
    + f""", b AS (SELECT log_id, t_us, min(t_us) OVER (PARTITION BY log_id) AS t0 FROM pauses JOIN facts USING (log_id) WHERE collector IN ('parallel', 'serial') AND dur >= 2),
s AS (SELECT log_id, (t_us - t0) // 1000000 AS sec, count(*) AS k, max(t_us - t0) AS span FROM b GROUP BY ALL),
r AS (SELECT log_id, CAST(sum(k) AS BIGINT) AS n, max(k) AS most, count(*) FILTER (k > {FREQUENCY_PER_SEC}) AS violating, greatest(1, CAST(ceil(max(span) / 1e6) AS BIGINT) + 1) AS seconds FROM s GROUP BY log_id)
SELECT *, {_FREQ_GRADE} FROM r WHERE n >= 5""",
)
def an_heap_small_frequency(spark: SparkSession, sf_dir: str, f: DataFrame | None = None, p: DataFrame | None = None) -> DataFrame:
    p = _graded_pauses(spark, sf_dir, f, p).filter("collector IN ('parallel', 'serial') AND dur >= 2").select("log_id", "t_us")
    p = p.join(p.groupBy("log_id").agg(F.min("t_us").alias("t0")), "log_id").withColumn("dt", F.col("t_us") - F.col("t0"))
    s = p.groupBy("log_id", F.expr("dt div 1000000").alias("sec")).agg(F.count(F.lit(1)).alias("k"), F.max("dt").alias("span"))
    r = s.groupBy("log_id").agg(
        F.sum("k").alias("n"), F.max("k").alias("most"), F.count_if(F.col("k") > FREQUENCY_PER_SEC).alias("violating"),
        F.greatest(F.lit(1), F.ceil(F.max("span") / F.lit(1e6)) + 1).cast("bigint").alias("seconds"),
    )
    return r.filter("n >= 5").withColumn("impact", F.expr(_FREQ_GRADE.removesuffix(" AS impact")))


@query(
    "an_periodic_gc",
    f""", s AS (SELECT log_id, t_us, (t_us - lag(t_us) OVER (PARTITION BY log_id ORDER BY t_us, seq)) / 1e6 AS dt FROM ev WHERE gc_cause = 'JAVA_LANG_SYSTEM'),
r AS (SELECT log_id, count(*) AS calls, round(avg(dt), 6) AS mean_s, round(stddev_pop(dt) / nullif(avg(dt), 0), 6) AS cv FROM s GROUP BY log_id)
SELECT *, 'SIGNIFICANT' AS impact FROM r WHERE calls >= {PERIODIC["calls"]} AND mean_s BETWEEN {PERIODIC["mean"][0]} AND {PERIODIC["mean"][1]} AND cv <= {PERIODIC["cv"]}""",
)
def an_periodic_gc(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    ev = with_previous(events(spark, sf_dir, (), None, F.col("gc_cause") == "JAVA_LANG_SYSTEM", ordered=True), F.col("t_us"), "prev")
    dt = (F.col("t_us") - F.col("prev")) / F.lit(1e6)
    r = ev.withColumn("dt", dt).groupBy("log_id").agg(F.count(F.lit(1)).alias("calls"), F.avg("dt").alias("m"), F.stddev_pop("dt").alias("sd"))
    r = r.select("log_id", "calls", F.round("m", 6).alias("mean_s"), F.round(F.try_divide("sd", "m"), 6).alias("cv"), F.lit("SIGNIFICANT").alias("impact"))
    return r.filter((F.col("calls") >= PERIODIC["calls"]) & F.col("mean_s").between(*PERIODIC["mean"]) & (F.col("cv") <= PERIODIC["cv"]))


@query(
    "an_mixed_runs",
    """, c AS (SELECT log_id, event_class, sum(CASE WHEN event_class = 'G1YoungInitialMark' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS cycle FROM young),
k AS (SELECT log_id, cycle, count(*) FILTER (event_class = 'G1Mixed') AS mixed FROM c WHERE cycle >= 1 GROUP BY ALL),
d AS (SELECT * FROM k QUALIFY cycle < max(cycle) OVER (PARTITION BY log_id))
SELECT log_id, mixed, count(*) AS runs FROM d GROUP BY ALL""",
)
def an_mixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of mixed collections between two initial marks; the last, open cycle of a log is left out."""
    ev = events(spark, sf_dir, (), S.G1_YOUNG, ordered=True)
    c = with_running_sum(ev, F.when(F.col("event_class") == "G1YoungInitialMark", 1).otherwise(0), "cycle")
    k = c.filter("cycle >= 1").groupBy("log_id", "cycle").agg(F.count_if(F.col("event_class") == "G1Mixed").alias("mixed"))
    last = k.groupBy("log_id").agg(F.max("cycle").alias("last"))
    return k.join(last, "log_id").filter("cycle < last").groupBy("log_id", "mixed").agg(F.count(F.lit(1)).alias("runs"))


_ERF = "(1 - u * ({a0}e0 + u * ({a1}e0 + u * ({a2}e0 + u * ({a3}e0 + u * {a4}e0)))) * exp(-x * x))".format(**{f"a{i}": a for i, a in enumerate(ERF_A)})
_VERDICT = f"""CASE WHEN n IS NULL THEN 'not enough' WHEN p IS NULL THEN 'constant' WHEN p >= {STABILITY_P}e0 THEN 'stable'
  WHEN mb_per_hour <= 0 THEN 'downward' WHEN mb_per_hour < {STABILITY_MB_PER_HOUR}e0 THEN 'trending' ELSE 'leaking' END"""
_TREND_GRADE = _grade("verdict = 'leaking'", "verdict = 'trending'")
_TREND_SQL = f""", raw AS (
  SELECT log_id, t_us, seq, heap.occ_after / 1024e0 AS mb, row_number() OVER (PARTITION BY log_id ORDER BY t_us, seq) - 1 AS i, count(*) OVER (PARTITION BY log_id) AS total
  FROM gg WHERE heap.valid AND heap.occ_after IS NOT NULL),
s AS (
  SELECT log_id, t_us / 1e6 AS t, mb, row_number() OVER (PARTITION BY log_id ORDER BY t_us, seq) AS k FROM raw
  WHERE total >= {STABILITY_SAMPLES[0]} AND (total <= {STABILITY_SAMPLES[1]} OR (i * {STABILITY_SAMPLES[1]} + total - 1) // total < ((i + 1) * {STABILITY_SAMPLES[1]} + total - 1) // total)),
ties AS (SELECT log_id, CAST(sum(c) AS INTEGER) AS n, sum(CASE WHEN c > 1 THEN c * (c - 1) * (2 * c + 5) ELSE 0 END) AS tie FROM (SELECT log_id, mb, count(*) AS c FROM s GROUP BY ALL) GROUP BY log_id),
pr AS (SELECT a.log_id, CAST(sum(sign(b.mb - a.mb)) AS BIGINT) AS s, list_sort(list((b.mb - a.mb) / nullif(b.t - a.t, 0)) FILTER (b.t <> a.t)) AS slopes
       FROM s a JOIN s b ON a.log_id = b.log_id AND b.k > a.k GROUP BY a.log_id),
v AS (SELECT log_id, n, s, slopes, (n * (n - 1.0e0) * (2 * n + 5) - tie) / 18e0 AS var FROM ties JOIN pr USING (log_id)),
z AS (SELECT *, CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) END AS z FROM v),
e AS (SELECT *, abs(z) / sqrt(2e0) AS x, 1 / (1 + {ERF_P}e0 * (abs(z) / sqrt(2e0))) AS u FROM z),
r AS (SELECT log_id, n, s, round(z, 9) AS z, round(2 * (1 - 0.5e0 * (1 + {_ERF})), 9) AS p,
       CASE WHEN var > 0 THEN coalesce(slopes[len(slopes) // 2 + 1], 0) * 3600 END AS mb_per_hour FROM e),
j AS (SELECT log_id, n, s, z, p, mb_per_hour, {_VERDICT} AS verdict FROM (SELECT DISTINCT log_id FROM ev) LEFT JOIN r USING (log_id))
SELECT *, {_TREND_GRADE} FROM j"""


@query("an_heap_stability", _TREND_SQL)
def an_heap_stability(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Mann-Kendall and Theil-Sen over the occupancy after collections; logs beyond 5,000 samples are strided evenly, as the test demands.

    A group in Python holds at most 5,000 rows: ordinals come from sharded running sums, and the stride is applied before.
    """
    least, most = STABILITY_SAMPLES
    ev = events(spark, sf_dir, [F.col("heap.valid").alias("valid"), F.col("heap.occ_after").alias("oa")], S.GG, keep="valid AND oa IS NOT NULL", ordered=True)
    ev = with_running_sum(ev.select("log_id", "_shard", "seq", "t_us", (F.col("oa") / F.lit(1024.0)).alias("mb")), F.lit(1), "i").withColumn("i", F.col("i") - 1)
    n = ev.groupBy("log_id").agg(F.count(F.lit(1)).alias("total"))
    ev = ev.join(n, "log_id").filter(f"total <= {most} OR (i * {most} + total - 1) div total < ((i + 1) * {most} + total - 1) div total")
    got = ev.filter(f"total >= {least}").select("log_id", "t_us", "seq", "mb").groupBy("log_id").applyInPandas(trend_frame, "log_id int, n int, s bigint, z double, p double, mb_per_hour double")
    got = got.withColumns({"z": F.round("z", 9), "p": F.round("p", 9)})
    every = (f if f is not None else facts(spark, sf_dir)).select("log_id").join(got, "log_id", "left").withColumn("verdict", F.expr(_VERDICT))
    return every.withColumn("impact", F.expr(_TREND_GRADE.removesuffix(" AS impact")))


_MIXED = ("cycles", "mixed", "fewest", "most")


@query(
    "an_mixed",
    REGISTRY["an_mixed_runs"].sql.removeprefix(PRELUDE).replace("SELECT log_id, mixed, count(*) AS runs FROM d GROUP BY ALL", "")
    + f""", m AS (SELECT log_id, count(*) AS cycles, CAST(sum(mixed) AS BIGINT) AS mixed, min(mixed) AS fewest, max(mixed) AS most FROM d GROUP BY log_id),
g1 AS (SELECT DISTINCT log_id FROM ev WHERE event_class LIKE 'G1%')
SELECT log_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _MIXED)}, 'OK' AS impact FROM g1 LEFT JOIN m USING (log_id)""",
)
def an_mixed(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Mixed collections of the closed cycles of every log with a G1 event, also of one without cycles; never graded worse than OK."""
    f = f if f is not None else facts(spark, sf_dir)
    runs = an_mixed_runs(spark, sf_dir).groupBy("log_id").agg(F.sum("runs").alias("cycles"), F.sum(F.col("mixed") * F.col("runs")).alias("mixed"), F.min("mixed").alias("fewest"), F.max("mixed").alias("most"))
    return f.filter("g1_events > 0").select("log_id").join(runs, "log_id", "left").fillna(0, list(_MIXED)).withColumn("impact", F.lit("OK"))


#: The findings of a log in their order: query, group, title, and the figures that go with it (label: column, ``n`` for whole numbers, else three decimals).
FINDINGS: dict[str, tuple[str, str, dict[str, str]]] = {
    "an_premature": ("heap", "Early promotion", {"records": "n records", "early": "n premature", "share": "ratio"}),
    "an_metaspace": ("heap", "Collections for metaspace", {"collections": "n metaspace_gcs"}),
    "an_heap_small_indicators": ("heap", "Signs of a small heap", {"full": "n full_gcs", "aborted marks": "n mark_aborts", "overflows": "n overflows", "to-space": "n to_space"}),
    "an_heap_small_frequency": ("heap", "Frequent collections", {"pauses": "n n", "most in a second": "n most", "busy seconds": "n violating", "seconds": "n seconds"}),
    "an_heap_small_stalls": ("heap", "Allocation stalls", {"stalls": "n stalls", "a minute": "per_min"}),
    "an_heap_stability": ("heap", "Trend of the live heap", {"samples": "n n", "MB an hour": "mb_per_hour", "p": "p"}),
    "an_high_pause": ("pause", "Long pauses", {"pauses": "n n", "longest ms": "max_ms", "over first limit": "n over_warn", "over second limit": "n over_sig"}),
    "an_throughput": ("pause", "Throughput", {"overall %": "overall_pct", "target %": "target_pct", "worst window %": "worst_pct", "from s": "worst_start_s"}),
    "an_clustering": ("pause", "Clustered pauses", {"worst window %": "worst_pct", "pauses": "n n", "paused s": "stw_s", "from s": "start_s"}),
    "an_distribution": ("pause", "Distribution of pauses", {"p50 ms": "p50", "p90 ms": "p90", "p99 ms": "p99", "longest ms": "max_ms"}),
    "an_system_gc": ("cause", "Explicit collections", {"calls": "n system_gcs"}),
    "an_periodic_gc": ("cause", "Periodic explicit collections", {"calls": "n calls", "every s": "mean_s", "variation": "cv"}),
    "an_diagnostic_gc": ("cause", "Collections by tools", {"collections": "n explicit_gcs"}),
    "an_gclocker": ("cause", "Collections for critical sections", {"collections": "n lockers"}),
    "an_full_gc": ("cause", "Full collections", {"collections": "n full_gcs", "s": "full_sec"}),
    "an_mixed": ("mixed", "Mixed collections a cycle", {"cycles": "n cycles", "mixed": "n mixed", "fewest": "n fewest", "most": "n most"}),
    "an_cpu": ("cpu", "Processor time in pauses", {"pauses": "n cpu_pauses", "kernel over user": "n kernel_over_user", "one thread": "n single_thread", "kernel share": "n kernel_share"}),
    "an_log_duration": ("duration", "Length of the log", {"s": "duration_s"}),
}


def _columns(name: str, i: int) -> str:
    """Select list of a finding's row, the same in both dialects."""
    group, title, figures = FINDINGS[name]
    cells = []
    for label, column in figures.items():
        kind = "BIGINT" if column.startswith("n ") else "DECIMAL(30, 3)"
        x = column.removeprefix("n ")
        value = f"CAST({x} AS {kind})" if kind == "BIGINT" else f"CAST(round({x}, 3) AS {kind})"
        cells.append(f"'{label} ', coalesce(CAST({value} AS STRING), '-')")
    return f"log_id, {i} AS ord, '{group}' AS grp, '{name[3:]}' AS finding, '{title}' AS title, impact, concat({", '; ', ".join(cells)}) AS figures"


def _findings_sql() -> str:
    parts = (f"SELECT {_columns(name, i)} FROM ({REGISTRY[name].sql})" for i, name in enumerate(FINDINGS))
    return ", one AS (SELECT 1) " + " UNION ALL ".join(parts)


_OVER_PAUSES = ("an_high_pause", "an_throughput", "an_clustering", "an_distribution", "an_heap_small_frequency")


@query("an_findings", _findings_sql())
def an_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, ord, grp, finding, title, impact, figures): all graded findings in their order.

    The facts, a row a log, and the pauses with their log's collector and length
    are made once.
    """
    f, out = shared_checkpoint(facts(spark, sf_dir)), None
    p = shared_checkpoint(_graded_pauses(spark, sf_dir, f).select("log_id", "t_us", "dur_us", "collector", "dur"))
    for i, name in enumerate(FINDINGS):
        got = REGISTRY[name].run(spark, sf_dir, f, p) if name in _OVER_PAUSES else REGISTRY[name].run(spark, sf_dir, f)
        one = spark.sql(f"SELECT {_columns(name, i)} FROM {{got}}", got=got)
        out = one if out is None else out.unionByName(one)
    return out
