"""The views that show events as they are: occupancy, pauses, allocation, phases, regions, tenuring, causes, ZGC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cluster import ONCE, once, table
from ..functions.ordered import sharded_once, with_previous
from .base import category, events, heaps, long_form, meta, pauses, query, sql_long

KEYS = ("log_id", "seq", "t_sec")
POSITIVE = lambda c: F.when(c > 0, c)


# ---- occupancy ---------------------------------------------------------------------------------------------------


def _occupancy(occ: str, size: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = heaps(spark, sf_dir, f"valid AND {occ} IS NOT NULL AND {size} IS NOT NULL").filter("category IS NOT NULL")
        cells = F.array(
            F.struct(F.lit("HEAP_CAPACITY").alias("category"), (F.col(size) / F.col("unit")).alias("mb")),
            F.struct(F.col("category"), (F.col(occ) / F.col("unit")).alias("mb")),
        )
        return h.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.*")

    sql = f"""SELECT log_id, seq, t_sec, 'HEAP_CAPACITY' AS category, {size} / unit AS mb FROM heaps WHERE valid AND category IS NOT NULL AND {occ} IS NOT NULL AND {size} IS NOT NULL
UNION ALL SELECT log_id, seq, t_sec, category, {occ} / unit FROM heaps WHERE valid AND category IS NOT NULL AND {occ} IS NOT NULL AND {size} IS NOT NULL"""
    return run, sql


def _occupancy_percent(occ: str, size: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = heaps(spark, sf_dir, f"valid AND {occ} IS NOT NULL AND {size} > 0").filter("category IS NOT NULL")
        return h.select(*KEYS, "category", (F.lit(100.0) * F.col(occ) / F.col(size)).alias("pct"))

    return run, f"SELECT log_id, seq, t_sec, category, 100e0 * {occ} / {size} AS pct FROM heaps WHERE valid AND category IS NOT NULL AND {occ} IS NOT NULL AND {size} > 0"


def _tenured(side: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = [F.col("tenured.valid").alias("valid"), F.col(f"tenured.occ_{side}").alias("occ"), F.col(f"tenured.size_{side}").alias("size")]
        ev = events(spark, sf_dir, cols, S.GEN_PAUSE, keep="valid AND occ IS NOT NULL AND size IS NOT NULL")
        cells = F.array(
            F.struct(F.lit("HEAP_CAPACITY").alias("category"), (F.col("size") / F.lit(1024.0)).alias("mb")),
            F.struct(category().alias("category"), (F.col("occ") / F.lit(1024.0)).alias("mb")),
        )
        return ev.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.*").filter("category IS NOT NULL")

    where = f"event_class IN {S.sql_in(S.GEN_PAUSE)} AND tenured.valid AND tenured.occ_{side} IS NOT NULL AND tenured.size_{side} IS NOT NULL"
    return run, f"""SELECT log_id, seq, t_sec, 'HEAP_CAPACITY' AS category, tenured.size_{side} / 1024e0 AS mb FROM ev WHERE {where}
UNION ALL SELECT log_id, seq, t_sec, category, tenured.occ_{side} / 1024e0 FROM ev WHERE {where}"""


for _name, (_run, _sql) in {
    "heap_occupancy": _occupancy("oa", "sa"),
    "heap_occupancy_before": _occupancy("ob", "sb"),
    "heap_occupancy_before_pct": _occupancy_percent("ob", "sb"),
    "heap_occupancy_after_pct": _occupancy_percent("oa", "sa"),
    "tenured_occupancy": _tenured("after"),
    "tenured_occupancy_before": _tenured("before"),
}.items():
    query(_name, _sql)(_run)


@query(
    "metaspace_occupancy",
    f"""SELECT * FROM (
SELECT log_id, seq, t_sec, 'METASPACE_CAPACITY' AS category, metaspace.size_after / 1024e0 AS mb FROM gg WHERE metaspace.valid
UNION ALL SELECT log_id, seq, t_sec, category, metaspace.occ_after / 1024e0 FROM gg WHERE metaspace.valid
UNION ALL SELECT log_id, seq, t_sec, 'METASPACE_CAPACITY', zgc.metaspace.committed / 1024e0 FROM zg
UNION ALL SELECT log_id, seq, t_sec, category, zgc.metaspace.used / 1024e0 FROM zg) WHERE mb IS NOT NULL""",
)
def metaspace_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("event_class").isin(list(S.ZGC))
    size = F.when(z, F.col("zgc.metaspace.committed")).when(F.col("metaspace.valid"), F.col("metaspace.size_after"))
    occ = F.when(z, F.col("zgc.metaspace.used")).when(F.col("metaspace.valid"), F.col("metaspace.occ_after"))
    ev = events(spark, sf_dir, [size.alias("size"), occ.alias("occ")], (*S.GG, *S.ZGC), keep="size IS NOT NULL OR occ IS NOT NULL")
    cells = F.array(
        F.struct(F.lit("METASPACE_CAPACITY").alias("category"), (F.col("size") / F.lit(1024.0)).alias("mb")),
        F.struct(category().alias("category"), (F.col("occ") / F.lit(1024.0)).alias("mb")),
    )
    return ev.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.*").filter("mb IS NOT NULL")


# ---- pauses ------------------------------------------------------------------------------------------------------


@query("pause_time", "SELECT log_id, seq, t_us / 1e6 AS t_sec, category, dur_us / 1e3 AS pause_ms FROM pauses WHERE category IS NOT NULL")
def pause_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pauses(spark, sf_dir).filter("category IS NOT NULL")
    return p.select("log_id", "seq", (F.col("t_us") / F.lit(1e6)).alias("t_sec"), "category", (F.col("dur_us") / F.lit(1e3)).alias("pause_ms"))


_TIMED = """timed AS (
  SELECT log_id, seq, 0 AS sub, category, t_us, greatest(duration_us, 0) AS dur_us FROM gg
  UNION ALL SELECT log_id, seq, sub, category, t_us, dur_us FROM pauses WHERE event_class LIKE 'ZGC%')"""


@query(
    "percent_time_in_gc",
    f""", {_TIMED},
l AS (SELECT *, lag(t_us) OVER (PARTITION BY log_id ORDER BY t_us, seq, sub) AS prev FROM timed)
SELECT log_id, seq, t_us / 1e6 AS t_sec, category, 100e0 * dur_us / (t_us - prev) AS pct FROM l WHERE t_us > prev AND category IS NOT NULL""",
)
def percent_time_in_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.struct(F.col("t_us").alias("t"), F.greatest(F.col("duration_us"), F.lit(0)).alias("d")))
    sub = F.array(*(F.struct(F.col(f"zgc.pauses.{p}.t_us").alias("t"), F.when(F.col(f"zgc.pauses.{p}.dur_us") > 0, F.col(f"zgc.pauses.{p}.dur_us")).alias("d")) for p in S.ZGC_PAUSES))
    ev = events(spark, sf_dir, [F.when(F.col("event_class").isin(list(S.ZGC)), sub).otherwise(own).alias("p")], (*S.GG, *S.ZGC), copies=True)
    rows = ev.select("log_id", F.col("seq").alias("at"), category().alias("category"), F.posexplode("p").alias("sub", "x"))
    rows = rows.select("log_id", "at", "sub", "category", F.col("x.t").alias("t_us"), F.col("x.d").alias("d")).filter("t_us IS NOT NULL AND d IS NOT NULL")
    rows = sharded_once(rows).withColumn("seq", F.struct("at", "sub"))
    rows = with_previous(rows, F.col("t_us"), "prev").filter("t_us > prev AND category IS NOT NULL")
    return rows.select("log_id", F.col("at").alias("seq"), (F.col("t_us") / F.lit(1e6)).alias("t_sec"), "category", (F.lit(100.0) * F.col("d") / (F.col("t_us") - F.col("prev"))).alias("pct"))


_STEP = 60_000_000
_WINDOWS = {"1m": 60_000_000, "5m": 300_000_000, "15m": 900_000_000}


@query(
    "mmu",
    f""", span AS (
  SELECT log_id, min(t_us) AS t0, CAST(floor(coalesce(any_value(est) * 1e6, arg_max(t_us + dur_us, (t_us, seq, sub)) - min(t_us))) AS BIGINT) AS dur
  FROM pauses LEFT JOIN meta USING (log_id) GROUP BY log_id),
s AS (SELECT log_id, t0, unnest(generate_series(1, (dur + 1) // {_STEP})) AS j FROM span WHERE dur >= {_STEP}),
w(series, width) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _WINDOWS.items())}),
c AS (SELECT s.log_id, s.j, s.t0, w.series, w.width FROM s, w WHERE s.j * {_STEP} >= w.width),
hit AS (
  SELECT c.log_id, c.j, c.series, sum(least(p.t_us + p.dur_us, c.t0 + c.j * {_STEP}) - greatest(p.t_us, c.t0 + c.j * {_STEP} - c.width)) AS stw
  FROM c JOIN pauses p ON p.log_id = c.log_id AND p.t_us < c.t0 + c.j * {_STEP} AND p.t_us + p.dur_us > c.t0 + c.j * {_STEP} - c.width
  GROUP BY ALL)
SELECT c.log_id, c.series, (c.t0 + c.j * {_STEP}) / 1e6 AS t_sec,
       100e0 * (c.width - least(c.width, coalesce(CAST(h.stw AS BIGINT), 0))) / c.width AS mutator_pct
FROM c LEFT JOIN hit h USING (log_id, j, series)""",
)
def mmu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses are sent to the samples whose windows they touch and clipped there; samples without a pause are 100 %."""
    p = pauses(spark, sf_dir)
    order = F.struct("t_us", "seq", "sub")
    span = p.groupBy("log_id").agg(F.min("t_us").alias("t0"), F.max_by(F.col("t_us") + F.col("dur_us"), order).alias("end"))
    span = span.join(meta(spark, sf_dir), "log_id", "left")
    dur = F.floor(F.coalesce(F.col("est") * F.lit(1e6), (F.col("end") - F.col("t0")).cast("double"))).cast("bigint")
    span = span.select("log_id", "t0", F.expr("0").alias("_"), dur.alias("dur")).drop("_").withColumn("last", F.expr(f"(dur + 1) div {_STEP}"))
    windows = F.array(*(F.struct(F.lit(k).alias("series"), F.lit(v).cast("bigint").alias("width")) for k, v in _WINDOWS.items()))
    longs = span.filter(f"dur >= {_STEP} AND last >= 1")
    samples = longs.select("log_id", "t0", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("j")).withColumn("w", F.explode(windows)).select("log_id", "t0", "j", "w.*")
    samples = samples.filter(F.col("j") * _STEP >= F.col("width"))
    hits = p.join(longs, "log_id").withColumn("w", F.explode(windows)).select("log_id", "t0", "last", "t_us", "dur_us", "w.*")
    hits = hits.withColumns(
        {
            "lo": F.greatest(F.lit(1), F.floor((F.col("t_us") - F.col("t0")) / F.lit(_STEP)) + 1).cast("bigint"),
            "hi": F.least(F.col("last"), F.floor((F.col("t_us") + F.col("dur_us") - F.col("t0") + F.col("width")) / F.lit(_STEP)) + 1).cast("bigint"),
        }
    ).filter("lo <= hi")
    hits = hits.withColumn("j", F.explode(F.sequence("lo", "hi")))
    at = F.col("t0") + F.col("j") * _STEP
    clip = F.least(F.col("t_us") + F.col("dur_us"), at) - F.greatest(F.col("t_us"), at - F.col("width"))
    stw = hits.withColumn("clip", clip).filter("clip > 0").groupBy("log_id", "j", "series").agg(F.sum("clip").alias("stw"))
    got = samples.join(stw, ["log_id", "j", "series"], "left")
    free = F.col("width") - F.least(F.col("width"), F.coalesce("stw", F.lit(0)))
    return got.select("log_id", "series", (at / F.lit(1e6)).alias("t_sec"), (F.lit(100.0) * free / F.col("width")).alias("mutator_pct"))


_CONCURRENT = (*S.G1_CONCURRENT, *S.CMS_CONCURRENT)


@query("concurrent_phase", f"SELECT log_id, seq, event_class AS series, t_sec, duration_us / 1e3 AS ms FROM ev WHERE event_class IN {S.sql_in(_CONCURRENT)} AND duration_us > 0")
def concurrent_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir, (), _CONCURRENT, F.col("duration_us") > 0)
    return ev.select("log_id", "seq", F.col("event_class").alias("series"), "t_sec", (F.col("duration_us") / F.lit(1e3)).alias("ms"))


@query("cpu_breakouts", sql_long("gg WHERE (coalesce(cpu.user, 0) > 0 OR coalesce(cpu.kernel, 0) > 0 OR coalesce(cpu.wall, 0) > 0)", "log_id, seq, t_sec", {"user": "cpu.user", "kernel": "cpu.kernel", "wall": "cpu.wall"}))
def cpu_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir, [F.col(f"cpu.{k}").alias(k) for k in ("user", "kernel", "wall")], S.GG, keep="user > 0 OR kernel > 0 OR wall > 0")
    return long_form(ev, KEYS, {k: F.col(k) for k in ("user", "kernel", "wall")})


# ---- allocation and recovery -------------------------------------------------------------------------------------

_VALID = "valid AND ob IS NOT NULL AND oa IS NOT NULL AND category IS NOT NULL"
_ALLOC_SQL = f""", a AS (
  SELECT *, lag(t_us) OVER w AS pt, ob / unit - lag(oa / unit) OVER w AS mb FROM heaps WHERE {_VALID} WINDOW w AS (PARTITION BY log_id ORDER BY t_us, seq))
"""


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid heaps with ``mb`` allocated since the one before, and the time ``dt_us`` between."""
    h = heaps(spark, sf_dir, "valid AND ob IS NOT NULL AND oa IS NOT NULL", ordered=True).filter(_VALID)
    h = with_previous(h, F.struct(F.col("t_us"), (F.col("oa") / F.col("unit")).alias("mb")), "prev")
    return h.withColumns({"mb": F.col("ob") / F.col("unit") - F.col("prev.mb"), "dt_us": F.col("t_us") - F.col("prev.t_us")})


@query("allocation_rate", _ALLOC_SQL + "SELECT log_id, seq, t_sec, mb / ((t_us - pt) / 1e6) AS mb_per_sec FROM a WHERE t_us > pt AND mb >= 0")
def allocation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _allocated(spark, sf_dir).filter("dt_us > 0 AND mb >= 0")
    return a.select(*KEYS, (F.col("mb") / (F.col("dt_us") / F.lit(1e6))).alias("mb_per_sec"))


@query("allocation_per_collection", _ALLOC_SQL + "SELECT log_id, seq, t_sec, category, mb FROM a WHERE mb >= 0")
def allocation_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocated(spark, sf_dir).filter("mb >= 0").select(*KEYS, "category", "mb")


@query("recovered", f"SELECT log_id, seq, t_sec, category, ob / unit - oa / unit AS mb FROM heaps WHERE {_VALID} AND ob >= oa")
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = heaps(spark, sf_dir, "valid AND ob >= oa").filter("category IS NOT NULL")
    return h.select(*KEYS, "category", (F.col("ob") / F.col("unit") - F.col("oa") / F.col("unit")).alias("mb"))


# ---- G1 ----------------------------------------------------------------------------------------------------------

_USABLE_SQL = "trim(coalesce(p.name, '')) <> '' AND p.sec IS NOT NULL AND NOT isnan(p.sec) AND p.sec >= 0"
#: Phase times are added up as whole nanoseconds, so that sums (below 104 days) do not depend on the order of rows.
_NS_SQL = "round({} * 1e9)"


def _ns(sec):
    return F.round(sec * F.lit(1e9))


def _usable(column: str):
    return F.filter(column, lambda x: (F.trim(F.coalesce(x["name"], F.lit(""))) != "") & x["sec"].isNotNull() & ~F.isnan(x["sec"]) & (x["sec"] >= 0))


def _total_ns(column: str):
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + _ns(x["sec"]))


_PHASES_SQL = f""", x AS (SELECT log_id, seq, t_sec, unnest(phases) AS p FROM young),
ph AS (SELECT log_id, seq, t_sec, p.name AS phase, sum({_NS_SQL.format("p.sec")}) AS ns FROM x WHERE {_USABLE_SQL} GROUP BY ALL),
names AS (SELECT DISTINCT log_id, phase FROM ph),
bars AS (SELECT log_id, seq, t_sec, sum(ns) AS total FROM ph GROUP BY ALL),
dense AS (SELECT bars.log_id, bars.seq, bars.t_sec, names.phase, total, coalesce(ns, 0e0) AS ns
  FROM bars JOIN names ON names.log_id = bars.log_id LEFT JOIN ph ON ph.log_id = bars.log_id AND ph.seq = bars.seq AND ph.phase = names.phase)
"""


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each event with a usable phase, with a value for every phase of its log, 0 where the event has none; ``total`` is the bar's height.

    The names of a log's phases come from a scan of the names alone; copies of an event change them not.
    """
    ev = events(spark, sf_dir, [_usable("phases").alias("p")], S.G1_YOUNG, keep="size(p) > 0")
    named = events(spark, sf_dir, [_usable("phases").alias("p")], S.G1_YOUNG, keep="size(p) > 0", copies=True)
    named = named.select("log_id", F.explode("p").alias("x")).groupBy("log_id").agg(F.collect_set("x.name").alias("names"))
    bars = ev.select(*KEYS, "p", _total_ns("p").alias("total")).join(named, "log_id").select(*KEYS, "p", "total", F.explode("names").alias("phase"))
    mine = F.filter("p", lambda x: x["name"] == F.col("phase"))
    return bars.select(*KEYS, "phase", "total", _total_ns(mine).alias("ns"))


@query("g1_phases", _PHASES_SQL + "SELECT log_id, seq, t_sec, phase, ns / 1e6 AS ms FROM dense")
def g1_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir).select(*KEYS, "phase", (F.col("ns") / F.lit(1e6)).alias("ms"))


@query("g1_phase_pct", _PHASES_SQL + "SELECT log_id, seq, t_sec, phase, CASE WHEN total > 0 THEN 100e0 * ns / total ELSE 0e0 END AS pct FROM dense")
def g1_phase_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir).select(*KEYS, "phase", F.when(F.col("total") > 0, F.lit(100.0) * F.col("ns") / F.col("total")).otherwise(F.lit(0.0)).alias("pct"))


_TYPE_SQL = "CASE event_class WHEN 'G1Mixed' THEN 'Mixed' WHEN 'G1YoungInitialMark' THEN 'InitialMark' ELSE 'Young' END"


def _sub_phase(kind: str, percent: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == "other":
            scalars = F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"other_phases.{k}").alias("sec")) for k in S.OTHER_PHASES))
            p = F.filter(scalars, lambda x: x["sec"].isNotNull() & ~F.isnan(x["sec"]) & (x["sec"] > 0))
        else:
            p = _usable(S.SUB_PHASES[kind])
        ev = events(spark, sf_dir, [p.alias("p")], S.G1_YOUNG, keep="size(p) > 0")
        label = F.when(F.col("event_class") == "G1Mixed", "Mixed").when(F.col("event_class") == "G1YoungInitialMark", "InitialMark").otherwise("Young")
        rows = ev.select(*KEYS, label.alias("type"), _total_ns("p").alias("total"), F.explode("p").alias("x"))
        got = rows.groupBy(*KEYS, F.concat("x.name", F.lit("::"), "type").alias("series")).agg(F.sum(_ns(F.col("x.sec"))).alias("ns"), F.first("total").alias("total"))
        if percent:
            return got.filter("total > 0").select(*KEYS, "series", (F.lit(100.0) * F.col("ns") / F.col("total")).alias("y"))
        return got.select(*KEYS, "series", (F.col("ns") / F.lit(1e6)).alias("y"))

    if kind == "other":
        x = " UNION ALL ".join(
            f"SELECT log_id, seq, t_sec, '{k}::' || {_TYPE_SQL} AS series, other_phases.{k} AS sec FROM young WHERE other_phases.{k} > 0 AND NOT isnan(other_phases.{k})" for k in S.OTHER_PHASES
        )
    else:
        x = f"SELECT log_id, seq, t_sec, p.name || '::' || {_TYPE_SQL} AS series, p.sec AS sec FROM (SELECT *, unnest({S.SUB_PHASES[kind]}) AS p FROM young) WHERE {_USABLE_SQL}"
    value = "100e0 * ns / sum(ns) OVER (PARTITION BY log_id, seq)" if percent else "ns / 1e6"
    where = " QUALIFY sum(ns) OVER (PARTITION BY log_id, seq) > 0" if percent else ""
    return run, f", x AS ({x}), y AS (SELECT log_id, seq, t_sec, series, sum({_NS_SQL.format("sec")}) AS ns FROM x GROUP BY ALL) SELECT log_id, seq, t_sec, series, {value} AS y FROM y{where}"


for _kind in ("pre", "evac", "post", "other"):
    for _percent in (False, True):
        _run, _sql = _sub_phase(_kind, _percent)
        query(f"g1_{_kind}_{'pct' if _percent else 'ms'}", _sql)(_run)


def _regions(side: str, percent: bool):
    sides = {(r, s): f"greatest(coalesce(regions.{r}.{s}, 0), 0)" for r in S.REGIONS for s in ("before", "after")}
    every = " + ".join(sides.values())
    here = " + ".join(sides[r, side] for r in S.REGIONS)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = [F.expr(sides[r, side]).alias(r) for r in S.REGIONS]
        ev = events(spark, sf_dir, [*cols, F.expr(every).alias("every"), F.expr(here).alias("total")], S.G1_PAUSE, F.col("regions").isNotNull(), keep="every > 0")
        if percent:
            return ev.select(*KEYS, *(F.when(F.col("total") > 0, F.lit(100.0) * F.col(r) / F.col("total")).otherwise(F.lit(0.0)).alias(r) for r in S.REGIONS))
        return ev.select(*KEYS, *S.REGIONS)

    value = (lambda r: f"CASE WHEN ({here}) > 0 THEN 100e0 * {sides[r, side]} / ({here}) ELSE 0e0 END") if percent else (lambda r: sides[r, side])
    return run, f"SELECT log_id, seq, t_sec, {', '.join(f'{value(r)} AS {r}' for r in S.REGIONS)} FROM ev WHERE event_class IN {S.sql_in(S.G1_PAUSE)} AND regions IS NOT NULL AND {every} > 0"


for _side in ("before", "after"):
    for _percent in (False, True):
        _run, _sql = _regions(_side, _percent)
        query(f"g1_regions_{_side}{'_pct' if _percent else ''}", _sql)(_run)


# ---- tenuring ----------------------------------------------------------------------------------------------------


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "survivor_records").filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL")
    return once(rows, ["log_id", "seq"], ONCE in rows.columns)


def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sv = survivors(spark, sf_dir).select("log_id", "seq", "t_us", "desired_occupancy", F.posexplode("bytes_at_age").alias("age", "bytes"))
    return sv.filter("age >= 1 AND bytes IS NOT NULL")


_AGES_SQL = """, ages AS (
  SELECT log_id, seq, t_us, desired_occupancy, unnest(range(0, len(bytes_at_age))) AS age, unnest(bytes_at_age) AS bytes FROM sv),
a AS (SELECT * FROM ages WHERE age >= 1 AND bytes IS NOT NULL)
"""


@query(
    "tenuring_headline",
    _AGES_SQL
    + """, run AS (SELECT *, sum(bytes) OVER (PARTITION BY log_id, seq ORDER BY age) AS total FROM a),
over AS (SELECT log_id, t_us, seq, min(age) AS age FROM run WHERE total > desired_occupancy GROUP BY ALL),
first AS (SELECT log_id, CAST(arg_min(age, (t_us, seq)) AS INTEGER) AS exceeded_at_age FROM over GROUP BY log_id),
agg AS (
  SELECT log_id, count(*) AS collections, max(max_threshold) AS max_threshold, arg_max(desired_occupancy, (t_us, seq)) FILTER (desired_occupancy IS NOT NULL) AS desired_occupancy,
         count(*) FILTER (calculated_threshold < max_threshold) AS premature FROM sv GROUP BY log_id)
SELECT log_id, collections, max_threshold, desired_occupancy, premature, 100e0 * premature / collections AS premature_pct, exceeded_at_age FROM agg LEFT JOIN first USING (log_id)""",
)
def tenuring_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age at which a record's survivors first exceed the wish is found inside its array."""
    sv = survivors(spark, sf_dir)
    step = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("age"))
    add = lambda a, x: F.struct(
        F.when(a["i"] >= 1, a["total"] + F.coalesce(x, F.lit(0).cast("bigint"))).otherwise(a["total"]).alias("total"),
        (a["i"] + 1).alias("i"),
        F.coalesce(a["age"], F.when((a["i"] >= 1) & x.isNotNull() & (a["total"] + x > F.col("desired_occupancy")), a["i"])).alias("age"),
    )
    sv = sv.withColumn("age", F.aggregate("bytes_at_age", step, add, lambda a: a["age"]))
    order = F.struct("t_us", "seq")
    agg = sv.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("collections"),
        F.max("max_threshold").alias("max_threshold"),
        F.max_by("desired_occupancy", F.when(F.col("desired_occupancy").isNotNull(), order)).alias("desired_occupancy"),
        F.count_if(F.col("calculated_threshold") < F.col("max_threshold")).alias("premature"),
        F.min_by("age", F.when(F.col("age").isNotNull(), order)).alias("exceeded_at_age"),
    )
    return agg.withColumn("premature_pct", F.lit(100.0) * F.col("premature") / F.col("collections"))


@query("tenuring_breakdown", _AGES_SQL + "SELECT log_id, CAST(age AS INTEGER) AS age, CAST(sum(bytes) // count(*) AS BIGINT) AS avg_bytes, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(bytes) AS max_bytes FROM a GROUP BY log_id, age")
def tenuring_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _ages(spark, sf_dir).groupBy("log_id", "age").agg(F.sum("bytes").alias("total_bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("max_bytes"))
    return got.select("log_id", "age", F.expr("total_bytes div n").alias("avg_bytes"), "total_bytes", "max_bytes")


@query(
    "tenuring_threshold_dist",
    """, m AS (SELECT log_id, unnest(range(1, max(max_threshold) + 1)) AS threshold FROM sv GROUP BY log_id),
c AS (SELECT log_id, calculated_threshold AS threshold, count(*) AS n FROM sv GROUP BY ALL)
SELECT log_id, CAST(threshold AS INTEGER) AS threshold, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (log_id, threshold)""",
)
def tenuring_threshold_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = survivors(spark, sf_dir).groupBy("log_id", "calculated_threshold").agg(F.count(F.lit(1)).alias("n"), F.max("max_threshold").alias("most"))
    per = counted.groupBy("log_id").agg(F.max("most").alias("most"), F.map_from_entries(F.collect_list(F.when(F.col("calculated_threshold").isNotNull(), F.struct("calculated_threshold", "n")))).alias("seen"))
    per = per.filter("most >= 1").select("log_id", "seen", F.explode(F.sequence(F.lit(1), "most")).alias("threshold"))
    return per.select("log_id", "threshold", F.coalesce(F.try_element_at("seen", F.col("threshold")), F.lit(0)).cast("bigint").alias("n"))


@query("tenuring_volume", _AGES_SQL + "SELECT log_id, CAST(age AS INTEGER) AS age, CAST(sum(bytes) AS DOUBLE) / count(*) / 1024e0 AS avg_kb FROM a GROUP BY log_id, age")
def tenuring_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _ages(spark, sf_dir).groupBy("log_id", "age").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    return got.select("log_id", "age", (F.col("b").cast("double") / F.col("n") / F.lit(1024.0)).alias("avg_kb"))


@query("tenuring_threshold", "SELECT log_id, seq, t_us / 1e6 AS t_sec, calculated_threshold FROM sv WHERE calculated_threshold IS NOT NULL")
def tenuring_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(spark, sf_dir).filter("calculated_threshold IS NOT NULL").select("log_id", "seq", (F.col("t_us") / F.lit(1e6)).alias("t_sec"), "calculated_threshold")


@query("tenuring_over_time", _AGES_SQL + "SELECT log_id, seq, t_us / 1e6 AS t_sec, CAST(age AS INTEGER) AS age, bytes / 1024e0 AS kb FROM a WHERE bytes > 0")
def tenuring_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ages(spark, sf_dir).filter("bytes > 0").select("log_id", "seq", (F.col("t_us") / F.lit(1e6)).alias("t_sec"), "age", (F.col("bytes") / F.lit(1024.0)).alias("kb"))


# ---- causes, references, safepoints ------------------------------------------------------------------------------


@query(
    "gc_cause",
    """, c AS (SELECT log_id, coalesce(gc_type, 'Unknown') AS gc_type, coalesce(gc_cause, 'Unknown') AS gc_cause, count(*) AS n, min((t_us, seq)) AS f FROM ev GROUP BY ALL),
ty AS (SELECT log_id, gc_type, row_number() OVER (PARTITION BY log_id ORDER BY min(f)) AS type_ord FROM c GROUP BY log_id, gc_type),
ca AS (SELECT log_id, gc_cause, row_number() OVER (PARTITION BY log_id ORDER BY min(f), gc_cause) AS cause_ord FROM c GROUP BY log_id, gc_cause)
SELECT ty.log_id, ty.gc_type, ca.gc_cause, CAST(type_ord AS INTEGER) AS type_ord, CAST(cause_ord AS INTEGER) AS cause_ord, coalesce(n, 0) AS n
FROM ty JOIN ca ON ty.log_id = ca.log_id LEFT JOIN c ON c.log_id = ty.log_id AND c.gc_type = ty.gc_type AND c.gc_cause = ca.gc_cause""",
)
def gc_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: every type by every cause of the log.  The counts, at most types x causes a log, are spread out inside the log's row."""
    label = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    cells = events(spark, sf_dir, [label("gc_type"), label("gc_cause")]).groupBy("log_id", "gc_type", "gc_cause").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t_us", "seq")).alias("f"))
    from pyspark.sql import Window

    by_type, by_cause = Window.partitionBy("log_id", "gc_type"), Window.partitionBy("log_id", "gc_cause")
    cells = cells.withColumns({"ft": F.min("f").over(by_type), "fc": F.min("f").over(by_cause)})
    per = cells.groupBy("log_id").agg(
        F.array_sort(F.collect_set(F.struct("ft", "gc_type"))).alias("types"),
        F.array_sort(F.collect_set(F.struct("fc", "gc_cause"))).alias("causes"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("gc_type", "gc_cause"), "n"))).alias("counts"),
    )
    wide = per.select("log_id", "counts", "causes", F.posexplode("types").alias("ti", "ty")).select("log_id", "counts", "ti", F.col("ty.gc_type").alias("gc_type"), F.posexplode("causes").alias("ci", "ca"))
    n = F.try_element_at("counts", F.struct(F.col("gc_type"), F.col("ca.gc_cause").alias("gc_cause")))
    return wide.select("log_id", "gc_type", F.col("ca.gc_cause").alias("gc_cause"), (F.col("ti") + 1).alias("type_ord"), (F.col("ci") + 1).alias("cause_ord"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


def _references(what: str):
    field, scale = ("n", 1) if what == "count" else ("sec", 1e3)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = events(spark, sf_dir, [F.col(f"refs.{r}.{field}").alias(r) for r in S.REFERENCES], S.GG)
        return long_form(ev, KEYS, {r: POSITIVE(F.col(r) if field == "n" else F.col(r) * F.lit(1e3)) for r in S.REFERENCES})

    series = {r: (f"CASE WHEN refs.{r}.n > 0 THEN refs.{r}.n END" if field == "n" else f"CASE WHEN refs.{r}.sec > 0 THEN refs.{r}.sec * {scale} END") for r in S.REFERENCES}
    return run, sql_long("gg", "log_id, seq, t_sec", series)


for _what in ("count", "time"):
    _run, _sql = _references(_what)
    query(f"reference_{_what}", _sql)(_run)


def safepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "safepoints").filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL")
    return once(rows, ["log_id", "seq"], ONCE in rows.columns)


@query("safepoint_duration", "SELECT log_id, seq, t_us / 1e6 AS t_sec, duration_us / 1e3 AS ms FROM sp WHERE duration_us > 0")
def safepoint_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safepoints(spark, sf_dir).filter("duration_us > 0").select("log_id", "seq", (F.col("t_us") / F.lit(1e6)).alias("t_sec"), (F.col("duration_us") / F.lit(1e3)).alias("ms"))


@query("safepoint_cause", "SELECT log_id, vm_operation, count(*) AS n, CAST(row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, vm_operation) AS INTEGER) AS ord FROM sp WHERE vm_operation IS NOT NULL GROUP BY log_id, vm_operation")
def safepoint_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = safepoints(spark, sf_dir).filter("vm_operation IS NOT NULL").groupBy("log_id", "vm_operation").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("n"), "vm_operation")))


# ---- ZGC ---------------------------------------------------------------------------------------------------------


def _live(side: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = events(spark, sf_dir, [F.col(f"zgc.live.live_relocate_{side}").alias("b")], S.ZGC, keep="b IS NOT NULL")
        return ev.select(*KEYS, category().alias("category"), (F.col("b") / F.lit(1048576.0)).alias("mb"))

    return run, f"SELECT log_id, seq, t_sec, category, zgc.live.live_relocate_{side} / 1048576e0 AS mb FROM zg WHERE zgc.live.live_relocate_{side} IS NOT NULL"


for _side in ("start", "end"):
    _run, _sql = _live(_side)
    query(f"zgc_live_{_side}", _sql)(_run)


def _zgc_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, [F.col(f"zgc.concurrent.{p}").alias(p) for p in S.ZGC_CONCURRENT], S.ZGC)


@query("zgc_concurrent_phases", sql_long("zg", "log_id, seq, t_sec", {p: f"CASE WHEN zgc.concurrent.{p} > 0 THEN zgc.concurrent.{p} * 1e3 END" for p in S.ZGC_CONCURRENT}))
def zgc_concurrent_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(_zgc_concurrent(spark, sf_dir), KEYS, {p: POSITIVE(F.col(p) * F.lit(1e3)) for p in S.ZGC_CONCURRENT})


@query("zgc_cycle_pct", sql_long("zg WHERE duration_us > 0", "log_id, seq, t_sec", {p: f"CASE WHEN zgc.concurrent.{p} > 0 THEN 100 * zgc.concurrent.{p} / (duration_us / 1e6) END" for p in S.ZGC_CONCURRENT}))
def zgc_cycle_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _zgc_concurrent(spark, sf_dir).filter("duration_us > 0")
    return long_form(ev, KEYS, {p: POSITIVE(F.lit(100) * F.col(p) / (F.col("duration_us") / F.lit(1e6))) for p in S.ZGC_CONCURRENT})


@query("zgc_cycle_durations", "SELECT log_id, seq, t_sec, replace(replace(event_class, 'ZGC', ''), 'Collection', '') AS series, duration_us / 1e6 AS sec FROM zg WHERE duration_us > 0")
def zgc_cycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir, (), S.ZGC, F.col("duration_us") > 0)
    return ev.select(*KEYS, F.regexp_replace("event_class", "ZGC|Collection", "").alias("series"), (F.col("duration_us") / F.lit(1e6)).alias("sec"))


@query(
    "zgc_durations_intervals",
    """, l AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY log_id ORDER BY t_us, seq) AS dt FROM zg)
SELECT log_id, seq, t_sec, 'duration' AS series, duration_us / 1e6 AS y FROM l WHERE duration_us > 0
UNION ALL SELECT log_id, seq, t_sec, 'interval', dt / 1e6 FROM l WHERE dt > 0""",
)
def zgc_durations_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = with_previous(events(spark, sf_dir, (), S.ZGC, ordered=True), F.col("t_us"), "prev")
    return long_form(ev, KEYS, {"duration": POSITIVE(F.col("duration_us") / F.lit(1e6)), "interval": POSITIVE((F.col("t_us") - F.col("prev")) / F.lit(1e6))})


@query("zgc_pause_time", " UNION ALL ".join(f"SELECT log_id, seq, t_us / 1e6 AS t_sec, '{p}' AS series, dur_us / 1e3 AS ms FROM pauses WHERE event_class LIKE 'ZGC%' AND sub = {i}" for i, p in enumerate(S.ZGC_PAUSES)))
def zgc_pause_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pauses(spark, sf_dir).filter(F.col("event_class").isin(list(S.ZGC)))
    name = F.element_at(F.array(*(F.lit(x) for x in S.ZGC_PAUSES)), F.col("sub") + 1)
    return p.select("log_id", "seq", (F.col("t_us") / F.lit(1e6)).alias("t_sec"), name.alias("series"), (F.col("dur_us") / F.lit(1e3)).alias("ms"))


@query("zgc_system_load", sql_long("zg", "log_id, seq, t_sec", {k: f"CASE WHEN zgc.load[{i + 1}] >= 0 THEN zgc.load[{i + 1}] END" for i, k in enumerate(("load1", "load5", "load15"))}))
def zgc_system_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir, [F.col("zgc.load").alias("load")], S.ZGC)
    at = lambda i: F.get("load", F.lit(i))
    return long_form(ev, KEYS, {k: F.when(at(i) >= 0, at(i)) for i, k in enumerate(("load1", "load5", "load15"))})


# ---- order of series ---------------------------------------------------------------------------------------------

_TYPE_ORD = "CASE event_class WHEN 'G1Mixed' THEN 2 WHEN 'G1YoungInitialMark' THEN 3 ELSE 1 END"
_SERIES_ARRAYS = {"phase": "phases", **S.SUB_PHASES}
_SERIES_SQL = (
    ", x AS ("
    + " UNION ALL ".join(f"SELECT log_id, '{k}' AS family, t_us, seq, {_TYPE_ORD} AS ty, unnest({a}) AS p, unnest(range(0, len({a}))) AS pos FROM young" for k, a in _SERIES_ARRAYS.items())
    + f"""), s AS (
  SELECT log_id, family, p.name AS name, CASE WHEN family = 'phase' THEN 0 ELSE ty END AS ty, (t_us, seq, pos) AS place FROM x WHERE {_USABLE_SQL}
  UNION ALL SELECT log_id, 'concurrent', event_class, 0, (t_us, seq, 0) FROM ev WHERE event_class IN {S.sql_in(_CONCURRENT)} AND duration_us > 0),
n AS (SELECT log_id, family, name, ty, min(min(place)) OVER (PARTITION BY log_id, family, name) AS f FROM s GROUP BY log_id, family, name, ty)
SELECT log_id, family, CASE ty WHEN 0 THEN name WHEN 1 THEN name || '::Young' WHEN 2 THEN name || '::Mixed' ELSE name || '::InitialMark' END AS series,
       CAST(row_number() OVER (PARTITION BY log_id, family ORDER BY f, name, ty) AS INTEGER) AS ord FROM n"""
)


@query("series_order", _SERIES_SQL)
def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, family, series, ord): named series in the order in which their names first appear, then Young, Mixed, InitialMark.

    The minimum of each name is taken before anything is ordered, so that only a row a series is sorted.
    """
    from pyspark.sql import Window

    arrays = F.array(*(F.struct(F.lit(k).alias("family"), _usable(a).alias("p")) for k, a in _SERIES_ARRAYS.items()))
    # the place in the array as it came, so that the filter for usable entries does not matter
    ev = events(spark, sf_dir, [F.expr(_TYPE_ORD).alias("ty"), arrays.alias("a")], S.G1_YOUNG).select("log_id", "t_us", "seq", "ty", F.explode("a").alias("a"))
    named = ev.select("log_id", F.col("a.family").alias("family"), "t_us", "seq", "ty", F.posexplode("a.p").alias("pos", "x"))
    ty = F.when(F.col("family") == "phase", 0).otherwise(F.col("ty"))
    named = named.select("log_id", "family", F.col("x.name").alias("name"), ty.alias("ty"), F.struct("t_us", "seq", "pos").alias("at"))
    conc = events(spark, sf_dir, (), _CONCURRENT, F.col("duration_us") > 0)
    conc = conc.select("log_id", F.lit("concurrent").alias("family"), F.col("event_class").alias("name"), F.lit(0).alias("ty"), F.struct("t_us", "seq", F.lit(0).alias("pos")).alias("at"))
    first = named.unionByName(conc).groupBy("log_id", "family", "name", "ty").agg(F.min("at").alias("f"))
    first = first.withColumn("f", F.min("f").over(Window.partitionBy("log_id", "family", "name")))
    suffix = F.when(F.col("ty") == 0, "").when(F.col("ty") == 1, "::Young").when(F.col("ty") == 2, "::Mixed").otherwise("::InitialMark")
    order = Window.partitionBy("log_id", "family").orderBy("f", "name", "ty")
    return first.select("log_id", "family", F.concat("name", suffix).alias("series"), F.row_number().over(order).alias("ord"))
