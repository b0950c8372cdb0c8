"""Status of every view of every log: ERROR (no source), EMPTY, WARNING or OK, in this order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .base import REGISTRY, category, events, query
from .views import _ALLOC_SQL, _allocated, safepoints, survivors

ALLOCATION_RATE_DROPS = 5

_G, _Z = f"event_class IN {S.sql_in(S.GG)}", f"event_class IN {S.sql_in(S.ZGC)}"
_GEN, _YOUNG, _G1P = f"event_class IN {S.sql_in(S.GEN_PAUSE)}", f"event_class IN {S.sql_in(S.G1_YOUNG)}", f"event_class IN {S.sql_in(S.G1_PAUSE)}"
_C = "category IS NOT NULL"
_HEAP = f"(({_G} AND coalesce(heap_valid, false)) OR ({_Z} AND z_heap))"
_LOST = f"(({_G} OR ({_Z} AND {_C})) AND NOT {_HEAP})"
_G1, _GENS, _ZS = "family = 'G1GC'", "family = 'GENERATIONAL'", "family = 'ZGC'"
_ALL = f"({_G1} OR {_GENS} OR {_ZS})"
_TWO = f"({_G1} OR {_GENS})"


def _subs(template: str, names, op: str = " OR ") -> str:
    return "(" + op.join(template.format(n) for n in names) + ")"


_ZPAUSE = _subs("(zgc.pauses.{0}.t_us IS NOT NULL AND zgc.pauses.{0}.dur_us > 0)", S.ZGC_PAUSES)
_REGION_SUM = " + ".join(f"greatest(coalesce(regions.{r}.{s}, 0), 0)" for r in S.REGIONS for s in ("before", "after"))

#: view: (source, point, drop) as predicates over one event; a drop makes a warning.
EVENT_VIEWS: dict[str, tuple[str, str, str]] = {
    "heap-occupancy": (_ALL, f"{_HEAP} AND {_C} AND oa IS NOT NULL AND sa IS NOT NULL", _LOST),
    "heap-occupancy-before": (_ALL, f"{_HEAP} AND {_C} AND ob IS NOT NULL AND sb IS NOT NULL", _LOST),
    "heap-occupancy-before-percent": (_ALL, f"{_HEAP} AND {_C} AND ob IS NOT NULL AND sb > 0", f"{_LOST} OR ({_HEAP} AND NOT coalesce(sb, 0) > 0)"),
    "heap-occupancy-after-percent": (_ALL, f"{_HEAP} AND {_C} AND oa IS NOT NULL AND sa > 0", f"{_LOST} OR ({_HEAP} AND NOT coalesce(sa, 0) > 0)"),
    "tenured-occupancy": (_GENS, f"{_GEN} AND tenured.valid AND tenured.occ_after IS NOT NULL", f"{_GEN} AND NOT coalesce(tenured.valid, false)"),
    "tenured-occupancy-before": (_GENS, f"{_GEN} AND tenured.valid AND tenured.occ_before IS NOT NULL", f"{_GEN} AND NOT coalesce(tenured.valid, false)"),
    "metaspace-occupancy": (
        _ALL,
        f"({_G} AND metaspace.valid) OR ({_Z} AND zgc.metaspace IS NOT NULL)",
        f"({_G} AND NOT coalesce(metaspace.valid, false)) OR ({_Z} AND zgc.metaspace IS NULL)",
    ),
    "pause-time": (_ALL, f"{_C} AND (({_G} AND duration_us > 0) OR ({_Z} AND {_ZPAUSE}))", "false"),
    "mmu": (_ALL, f"({_G} AND duration_us > 0) OR ({_Z} AND {_ZPAUSE})", "false"),
    "concurrent-phase-duration": (_TWO, f"event_class IN {S.sql_in((*S.G1_CONCURRENT, *S.CMS_CONCURRENT))} AND duration_us > 0", "false"),
    "cpu-breakouts": (_TWO, f"{_G} AND (cpu.user > 0 OR cpu.kernel > 0 OR cpu.wall > 0)", "false"),
    "recovered": (_ALL, f"{_HEAP} AND {_C} AND ob >= oa", f"{_HEAP} AND {_C} AND ob < oa"),
    "summary": (_ALL, f"{_G} OR {_Z}", "false"),
    "g1-phases": (_G1, f"{_YOUNG} AND n_phases > 0", f"{_YOUNG} AND NOT coalesce(n_phases, 0) > 0"),
    "g1-phase-percent": (_G1, f"{_YOUNG} AND n_phases > 0", f"{_YOUNG} AND NOT coalesce(n_phases, 0) > 0"),
    **{
        f"g1-{name}{suffix}": (_G1, f"{_YOUNG} AND n_{key} > 0", f"{_YOUNG} AND NOT coalesce(n_{key}, 0) > 0")
        for name, key in (("pre-collection", "pre"), ("collection", "evac"), ("post-collection", "post"), ("other-collection", "other"))
        for suffix in ("", "-percent")
    },
    **{
        f"g1-regions-{side}{suffix}": (_G1, f"{_G1P} AND regions IS NOT NULL AND {_REGION_SUM} > 0", f"{_G1P} AND (regions IS NULL OR {_REGION_SUM} = 0)")
        for side in ("before", "after")
        for suffix in ("", "-percent")
    },
    "gc-cause": (_ALL, "true", "false"),
    **{
        f"reference-{what}": (_TWO, f"{_G} AND " + _subs("(coalesce(refs.{0}.n, 0) <> 0 OR coalesce(refs.{0}.sec, 0) > 0)", S.REFERENCES), "false")
        for what in ("count", "time")
    },
    "zgc-live-at-relocate-start": (_ZS, f"{_Z} AND zgc.live.live_relocate_start IS NOT NULL", f"{_Z} AND zgc.live.live_relocate_start IS NULL"),
    "zgc-live-at-relocate-end": (_ZS, f"{_Z} AND zgc.live.live_relocate_end IS NOT NULL", f"{_Z} AND zgc.live.live_relocate_end IS NULL"),
    "zgc-concurrent-phase-durations": (_ZS, f"{_Z} AND " + _subs("zgc.concurrent.{0} > 0", S.ZGC_CONCURRENT), "false"),
    "zgc-cycle-durations": (_ZS, f"{_Z} AND duration_us > 0", "false"),
    "zgc-cycle-time-percent": (_ZS, f"{_Z} AND duration_us > 0 AND " + _subs("zgc.concurrent.{0} > 0", S.ZGC_CONCURRENT), "false"),
    "zgc-pause-time": (_ZS, f"{_Z} AND {_ZPAUSE}", "false"),
    "zgc-system-load": (_ZS, f"{_Z} AND (load1 >= 0 OR load5 >= 0 OR load15 >= 0)", "false"),
    "analytics": (_ALL, "true", "false"),
}
_OTHER_N = " + ".join(f"CASE WHEN other_phases.{k} > 0 THEN 1 ELSE 0 END" for k in S.OTHER_PHASES)




_DERIVED = {
    "heap_valid": "heap.valid",
    "z_heap": "zgc.memory IS NOT NULL AND zgc.capacity IS NOT NULL",
    "ob": f"CASE WHEN {_Z} THEN zgc.memory.occ_before ELSE heap.occ_before END",
    "oa": f"CASE WHEN {_Z} THEN zgc.memory.occ_after ELSE heap.occ_after END",
    "sb": f"CASE WHEN {_Z} THEN zgc.capacity.max_capacity ELSE heap.size_before END",
    "sa": f"CASE WHEN {_Z} THEN zgc.capacity.max_capacity ELSE heap.size_after END",
    "n_other": _OTHER_N,
}
_ARRAYS = {"n_phases": "phases", "n_pre": "pre_phases", "n_evac": "evac_phases", "n_post": "post_phases"}
_SPARK_GOOD = "size(filter({}, x -> trim(coalesce(x.name, '')) <> '' AND x.sec IS NOT NULL AND NOT isnan(x.sec) AND x.sec >= 0))"
_DUCK_GOOD = "len(list_filter({}, lambda x: trim(coalesce(x.name, '')) <> '' AND x.sec IS NOT NULL AND NOT isnan(x.sec) AND x.sec >= 0))"
_STATUS = "CASE WHEN coalesce(sources, 0) = 0 THEN 'ERROR' WHEN points = 0 THEN 'EMPTY' WHEN warned THEN 'WARNING' ELSE 'OK' END"


def _sum(where: str) -> str:
    return f"CAST(sum(CASE WHEN {where} THEN 1 ELSE 0 END) AS BIGINT)"


def _wide_sql(name) -> str:
    return ", ".join(f"{_sum(s)} AS s{i}, {_sum(p)} AS p{i}, {_sum(d)} AS d{i}" for i, (s, p, d) in enumerate(EVENT_VIEWS.values()))


_STATUS_SQL = (
    _ALLOC_SQL
    + f""", d AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in _DERIVED.items())}, {", ".join(f"{_DUCK_GOOD.format(a)} AS {k}" for k, a in _ARRAYS.items())},
  zgc.load[1] AS load1, zgc.load[2] AS load5, zgc.load[3] AS load15 FROM ev),
wide AS (SELECT log_id, {_wide_sql(None)} FROM d GROUP BY log_id),
logs AS (SELECT log_id, s0 AS n FROM wide),
ordered AS (SELECT log_id, count(*) FILTER (t_us > pt AND mb >= 0) AS rates, count(*) FILTER (mb >= 0) AS allocs, count(*) FILTER (mb < 0) AS negative FROM a GROUP BY log_id),
timed AS (
  SELECT log_id, seq, 0 AS sub, category, t_us FROM gg UNION ALL SELECT log_id, seq, sub, category, t_us FROM pauses WHERE event_class LIKE 'ZGC%'),
pct AS (SELECT log_id, count(*) AS n FROM (SELECT *, lag(t_us) OVER (PARTITION BY log_id ORDER BY t_us, seq, sub) AS prev FROM timed) WHERE t_us > prev AND category IS NOT NULL GROUP BY log_id),
cyc AS (SELECT log_id, count(*) AS sources, count(*) FILTER (duration_us > 0 OR dt > 0) AS points FROM (SELECT *, t_us - lag(t_us) OVER (PARTITION BY log_id ORDER BY t_us, seq) AS dt FROM zg) GROUP BY log_id),
svn AS (SELECT log_id, count(*) AS sources, count(calculated_threshold) AS thresholds,
        count(*) FILTER (len(bytes_at_age) > 1) AS volumes, count(*) FILTER (len(list_filter(bytes_at_age[2:], lambda x: x > 0)) > 0) AS ages FROM sv GROUP BY log_id),
spn AS (SELECT log_id, count(*) AS sources, count(*) FILTER (duration_us > 0) AS durations, count(vm_operation) AS operations FROM sp GROUP BY log_id),
st AS ("""
    + " UNION ALL ".join(f"SELECT log_id, '{v}' AS view_id, s{i} AS sources, p{i} AS points, d{i} > 0 AS warned FROM wide" for i, v in enumerate(EVENT_VIEWS))
    + f"""
  UNION ALL SELECT log_id, 'allocation-rate', logs.n, coalesce(rates, 0), coalesce(negative, 0) > {ALLOCATION_RATE_DROPS} FROM logs LEFT JOIN ordered USING (log_id)
  UNION ALL SELECT log_id, 'allocation-per-collection', logs.n, coalesce(allocs, 0), coalesce(negative, 0) > 0 FROM logs LEFT JOIN ordered USING (log_id)
  UNION ALL SELECT log_id, 'percent-time-in-gc', logs.n, coalesce(pct.n, 0), false FROM logs LEFT JOIN pct USING (log_id)
  UNION ALL SELECT log_id, 'zgc-cycle-durations-and-intervals', coalesce(sources, 0), coalesce(points, 0), false FROM logs LEFT JOIN cyc USING (log_id)
  UNION ALL SELECT log_id, 'tenuring-summary', sources, coalesce(sources, 0), false FROM logs LEFT JOIN svn USING (log_id)
  UNION ALL SELECT log_id, 'tenuring-volume', sources, coalesce(volumes, 0), false FROM logs LEFT JOIN svn USING (log_id)
  UNION ALL SELECT log_id, 'tenuring-threshold', sources, coalesce(thresholds, 0), false FROM logs LEFT JOIN svn USING (log_id)
  UNION ALL SELECT log_id, 'tenuring-over-time', sources, coalesce(ages, 0), false FROM logs LEFT JOIN svn USING (log_id)
  UNION ALL SELECT log_id, 'safepoint-duration', sources, coalesce(durations, 0), false FROM logs LEFT JOIN spn USING (log_id)
  UNION ALL SELECT log_id, 'safepoint-cause', sources, coalesce(operations, 0), false FROM logs LEFT JOIN spn USING (log_id))
SELECT log_id, view_id, {_STATUS} AS status FROM st"""
)


@query("view_status", _STATUS_SQL)
def view_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan counts sources, points and drops of the views that take events one by one; the ordered ones bring their own counts, from a scan each."""
    cols = ["family", "heap", "tenured", "metaspace", "cpu", "refs", "regions", "zgc", *(F.expr(_SPARK_GOOD.format(a)).alias(k) for k, a in _ARRAYS.items()), "other_phases"]
    ev = events(spark, sf_dir, cols).withColumn("category", category())
    ev = ev.withColumns({k: F.expr(e) for k, e in _DERIVED.items()}).withColumns({k: F.get("zgc.load", F.lit(i)) for i, k in enumerate(("load1", "load5", "load15"))})
    wide = ev.groupBy("log_id").agg(*(F.expr(_sum(x)).alias(f"{k}{i}") for i, v in enumerate(EVENT_VIEWS.values()) for k, x in zip("spd", v, strict=True)))
    cells = F.array(*(F.struct(F.lit(v).alias("view_id"), F.col(f"s{i}").alias("sources"), F.col(f"p{i}").alias("points"), (F.col(f"d{i}") > 0).alias("warned")) for i, v in enumerate(EVENT_VIEWS)))

    a = _allocated(spark, sf_dir).groupBy("log_id").agg(
        F.count_if((F.col("dt_us") > 0) & (F.col("mb") >= 0)).alias("rates"), F.count_if(F.col("mb") >= 0).alias("allocs"), F.count_if(F.col("mb") < 0).alias("negative")
    )
    pct = REGISTRY["percent_time_in_gc"].run(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("pct"))
    cyc = REGISTRY["zgc_durations_intervals"].run(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("cyc"))
    sv = survivors(spark, sf_dir).groupBy("log_id").agg(
        F.count(F.lit(1)).alias("sv"), F.count("calculated_threshold").alias("thresholds"), F.count_if(F.size("bytes_at_age") > 1).alias("volumes"),
        F.count_if(F.expr("exists(slice(bytes_at_age, 2, greatest(size(bytes_at_age), 1)), x -> x > 0)")).alias("ages"),
    )
    sp = safepoints(spark, sf_dir).groupBy("log_id").agg(F.count(F.lit(1)).alias("sp"), F.count_if(F.col("duration_us") > 0).alias("durations"), F.count("vm_operation").alias("operations"))
    zgc_source = [i for i, v in enumerate(EVENT_VIEWS) if v == "zgc-pause-time"][0]
    more = wide.select("log_id", F.col("s0").alias("all_n"), F.col(f"s{zgc_source}").alias("zgc_n"), cells.alias("cells"))
    for one in (a, pct, cyc, sv, sp):
        more = more.join(one, "log_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    extra = {
        "allocation-rate": ("all_n", "rates", n("negative") > ALLOCATION_RATE_DROPS),
        "allocation-per-collection": ("all_n", "allocs", n("negative") > 0),
        "percent-time-in-gc": ("all_n", "pct", F.lit(False)),
        "zgc-cycle-durations-and-intervals": ("zgc_n", "cyc", F.lit(False)),
        "tenuring-summary": ("sv", "sv", F.lit(False)),
        "tenuring-volume": ("sv", "volumes", F.lit(False)),
        "tenuring-threshold": ("sv", "thresholds", F.lit(False)),
        "tenuring-over-time": ("sv", "ages", F.lit(False)),
        "safepoint-duration": ("sp", "durations", F.lit(False)),
        "safepoint-cause": ("sp", "operations", F.lit(False)),
    }
    own = F.array(*(F.struct(F.lit(v).alias("view_id"), n(s).alias("sources"), n(p).alias("points"), w.alias("warned")) for v, (s, p, w) in extra.items()))
    flat = more.select("log_id", F.explode(F.concat("cells", own)).alias("c")).select("log_id", "c.*")
    return flat.select("log_id", "view_id", F.expr(_STATUS).alias("status"))
