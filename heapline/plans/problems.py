"""Queries over the general data operators (grid, schema drift, log templates) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import table
from ..operators import log_templates, regular_grid, schema_drift


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid.missing_slots(table(spark, sf_dir, "window_stats"))


def p2_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = regular_grid.regular_grid(table(spark, sf_dir, "window_stats"))
    # to millionths, in the way that both engines round alike
    return got.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("throughput_pct", "stw_sec")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = schema_drift.changes(table(spark, sf_dir, "harvest_records"))
    return got.select(F.col("file").alias("file_id"), "field_name", "change_kind")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unify(table(spark, sf_dir, "harvest_records"))


def p3_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified phase times as rows: (file_id, line_no, field, name, sec)."""
    u = p3_unified(spark, sf_dir)
    parts = [u.select("file_id", "line_no", F.lit(c).alias("field"), F.explode(c).alias("name", "sec")) for c in ("phase_seconds", "sub_phase_seconds")]
    return parts[0].unionByName(parts[1]).filter("sec IS NOT NULL").select("file_id", "line_no", "field", "name", F.round("sec", 9).alias("sec"))


def p3_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.lifespans(schema_drift.footers(table(spark, sf_dir, "harvest_records")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.entry_heads(table(spark, sf_dir, "raw_log_lines"), table(spark, sf_dir, "log_meta"))


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.entries(table(spark, sf_dir, "raw_log_lines"), table(spark, sf_dir, "log_meta"))


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.templates(table(spark, sf_dir, "raw_log_lines"))


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, lines): lines with a token by the kind of time that their template carries."""
    return p4_templates(spark, sf_dir).groupBy("kind").agg(F.sum("lines").alias("lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, p2_series, p3_found, p3_unified, p3_seconds, p3_lifespans, p4_found, p4_entries, p4_templates, p4_kinds)
    return {f.__name__: f for f in found}


P2_FOUND_SQL = """
WITH u AS (
  SELECT DISTINCT probe_id, CAST(floor(start_sec / step_sec) AS BIGINT) AS slot FROM window_stats
  WHERE probe_id IS NOT NULL AND step_sec > 0 AND start_sec IS NOT NULL AND NOT isnan(start_sec) AND abs(start_sec) < 1e15
    AND throughput_pct IS NOT NULL AND NOT isnan(throughput_pct) AND throughput_pct BETWEEN 0 AND 100
    AND stw_sec IS NOT NULL AND NOT isnan(stw_sec) AND stw_sec >= 0 AND NOT isinf(stw_sec)),
g AS (SELECT probe_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM u GROUP BY probe_id)
SELECT probe_id, slot FROM g ANTI JOIN u USING (probe_id, slot)
"""


_P3_FIELDS_SQL = """files AS (
  SELECT feed_id, file_id, row_number() OVER (PARTITION BY feed_id ORDER BY min(written_at), file_id) AS ord, count(*) OVER (PARTITION BY feed_id) AS files
  FROM harvest_records GROUP BY feed_id, file_id),
kv AS (
  SELECT feed_id, file_id, j.key AS field, j.type AS t, j.value AS v
  FROM (SELECT * FROM harvest_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') h, json_each(h.payload) AS j
  WHERE j.type <> 'NULL'),
typed AS (
  SELECT feed_id, file_id, field,
    CASE WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean'
         WHEN t = 'ARRAY' THEN 'array'
         WHEN regexp_matches(CAST(v AS VARCHAR), ':\\s*"') THEN 'object<string>' ELSE 'object<number>' END AS kind
  FROM kv),
f AS (
  SELECT feed_id, file_id, field, arg_max(kind, (n, kind)) AS kind
  FROM (SELECT feed_id, file_id, field, kind, count(*) AS n FROM typed GROUP BY ALL) GROUP BY ALL)"""


def _p3_lifespans_sql() -> str:
    return f"""WITH {_P3_FIELDS_SQL},
fo AS (SELECT feed_id, field, kind, ord, files, ord - row_number() OVER (PARTITION BY feed_id, field, kind ORDER BY ord) AS island FROM f JOIN files USING (feed_id, file_id))
SELECT feed_id AS producer, field, kind, CAST(min(ord) AS INTEGER) AS first_ord, CAST(max(ord) AS INTEGER) AS last_ord, CAST(max(files) AS INTEGER) AS files FROM fo GROUP BY feed_id, field, kind, island"""


def _p3_found_sql() -> str:
    alias = ", ".join(f"('{n}', '{c}')" for c, (_, names) in schema_drift.ALIASES.items() for n in dict.fromkeys((*names, c)))
    return f"""
WITH alias(name, family) AS (VALUES {alias}),
{_P3_FIELDS_SQL},
fo AS (SELECT feed_id, file_id, ord, field, kind, coalesce(family, '~' || regexp_replace(lower(field), '[^a-z0-9]', '', 'g')) AS family
       FROM f JOIN files USING (feed_id, file_id) LEFT JOIN alias ON alias.name = f.field),
nxt AS (SELECT a.feed_id, a.ord AS ord, b.file_id FROM files a JOIN files b ON a.feed_id = b.feed_id AND b.ord = a.ord + 1),
ended AS (SELECT n.file_id, n.feed_id, n.ord, fo.field, fo.kind, fo.family FROM fo JOIN nxt n ON n.feed_id = fo.feed_id AND n.ord = fo.ord),
begun AS (SELECT fo.file_id, n.feed_id, n.ord, fo.field, fo.kind, fo.family FROM fo JOIN nxt n ON n.file_id = fo.file_id),
same AS (SELECT e.file_id, e.field AS field_name, 'retyped' AS change_kind FROM ended e JOIN begun b ON e.file_id = b.file_id AND e.field = b.field AND e.kind <> b.kind),
gone AS (SELECT e.*, row_number() OVER (PARTITION BY e.file_id, e.family ORDER BY e.field) AS i
         FROM ended e LEFT JOIN begun b ON e.file_id = b.file_id AND e.field = b.field WHERE b.field IS NULL),
come AS (SELECT b.*, row_number() OVER (PARTITION BY b.file_id, b.family ORDER BY b.field) AS i
         FROM begun b LEFT JOIN ended e ON e.file_id = b.file_id AND e.field = b.field WHERE e.field IS NULL)
SELECT * FROM same
UNION ALL
SELECT coalesce(g.file_id, c.file_id), coalesce(g.field, c.field),
       CASE WHEN g.field IS NULL THEN 'added' WHEN c.field IS NULL THEN 'removed' ELSE 'renamed' END
FROM gone g FULL JOIN come c ON g.file_id = c.file_id AND g.family = c.family AND g.i = c.i
"""


# Layouts as regular expressions, with the groups of time, level and component (0: none).
_LAYOUTS = (
    ("iso", r"^\[(\d{4}-\d\d-\d\dT[^\]]+)\]\[[\d.]+s\]\[(\w+) *\]\[([^\]]*?) *\]", 1, 2, 3),
    ("up", r"^\[(\d+\.\d+)s\]\[(\w+) *\]\[([^\]]*?) *\]", 1, 2, 3),
    ("iso", r"^time=(\S+) level=(\w+) component=(\S+)", 1, 2, 3),
    ("ms", r'^\{"ts": (\d+), "level": "(\w+)", "logger": "([^"]+)"', 1, 2, 3),
    ("iso", r'^\{"@timestamp": "([^"]+)", "severity": "(\w+)", "logger": "([^"]+)"', 1, 2, 3),
    ("iso", r"^(\d{4}-\d\d-\d\dT\S+): [\d.]+: \[", 1, 0, 0),
    ("letter", r"^([A-Z]\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ ([\w.]+):\d+\]", 1, 1, 2),
    ("iso", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) (\w+) +\[[^\]]*\] (\S+) -", 1, 2, 3),
    ("iso", r"^(\d{4}-\d\d-\d\dT\S+) \[([^\]]*)\] (\w+):", 1, 3, 2),
    ("month", r"^([A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d) \S+ ([^\[ ]+)\[\d+\]: <(\w+)>", 1, 3, 2),
)


def _p4_sql(message: bool) -> str:
    levels = ", ".join(f"('{k}', '{v}')" for k, v in log_templates.SEVERITIES.items())

    def stamp(x: str) -> str:
        zoned = f"regexp_replace(replace({x}, ',', '.'), '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2')"
        return f"epoch_us(CAST(CASE WHEN regexp_matches({zoned}, '(Z|[+-]\\d\\d:\\d\\d)$') THEN {zoned} ELSE {zoned} || 'Z' END AS TIMESTAMPTZ)) // 1000"

    rows = []
    for kind, pattern, ts, level, comp in _LAYOUTS:
        q = pattern.replace("'", "''")
        got = lambda i, q=q: f"regexp_extract(t, '{q}', {i})"
        at = {
            "iso": stamp(got(ts)),
            "ms": f"CAST({got(ts)} AS BIGINT)",
            "up": f"epoch_ms(started_at) + CAST(floor(CAST({got(ts)} AS DECIMAL(18, 6)) * 1000) AS BIGINT)",
            "letter": stamp(f"(year(started_at) || '-' || substr({got(ts)}, 2, 2) || '-' || substr({got(ts)}, 4, 2) || ' ' || substr({got(ts)}, 7))"),
            "month": f"epoch_ms(strptime(year(started_at) || ' ' || regexp_replace({got(ts)}, ' +', ' ', 'g'), '%Y %b %-d %H:%M:%S'))",
        }[kind]
        word = f"lower(substr({got(ts)}, 1, 1))" if kind == "letter" else f"lower({got(level)})" if level else "'-'"
        rows.append(f"SELECT log_path, line_no, {at} AS ts_ms, {word} AS word, {got(comp) if comp else repr('-')} AS component FROM l WHERE regexp_matches(t, '{q}')")
    return f"""
WITH sev(word, severity) AS (VALUES {levels}),
l AS (
  SELECT DISTINCT log_path, line_no, started_at, regexp_replace(regexp_replace(line, '\\x1B\\[[0-9;]*m', '', 'g'), '^\\x{{FEFF}}|[\\r\\n]+$', '', 'g') AS t
  FROM raw_log_lines LEFT JOIN log_meta USING (log_path)),
h AS ({" UNION ALL ".join(rows)}),
n AS (SELECT l.log_path, l.line_no, l.t, h.line_no IS NOT NULL AS begins, count(h.line_no) OVER (PARTITION BY l.log_path ORDER BY l.line_no) AS entry
      FROM l LEFT JOIN h USING (log_path, line_no)),
e AS (SELECT log_path, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(t, chr(10) ORDER BY line_no) AS message FROM n WHERE entry > 0 GROUP BY log_path, entry)
SELECT e.log_path, first_line, last_line, ts_ms, coalesce(severity, '-') AS severity, component{", message" if message else ""}
FROM e JOIN h ON h.log_path = e.log_path AND h.line_no = e.first_line LEFT JOIN sev USING (word)
"""


def _p4_kinds_sql() -> str:
    named = {"ms": "epoch", "up": "uptime", "letter": "letter_date", "month": "month_day"}
    whens = []
    for kind, pattern, *_ in _LAYOUTS:
        name = named.get(kind, "date_clock" if r"\d\d \d\d" in pattern else "stamp")
        whens.append("WHEN regexp_matches(t, '" + pattern.replace("'", "''") + f"') THEN '{name}'")
    return f"""
WITH l AS (
  SELECT DISTINCT ON (log_path, line_no) regexp_replace(regexp_replace(line, '\\x1B\\[[0-9;]*m', '', 'g'), '^\\x{{FEFF}}|[\\r\\n]+$', '', 'g') AS t
  FROM raw_log_lines WHERE log_path IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL)
SELECT CASE {" ".join(whens)} ELSE '' END AS kind, count(*) AS lines FROM l WHERE regexp_matches(t, '\\S') GROUP BY 1
"""


_P2_CTES = """
WITH r AS (
  SELECT DISTINCT probe_id, CAST(step_sec AS DOUBLE) AS step, CAST(floor(start_sec / step_sec) AS BIGINT) AS slot, reading_id, start_sec AS t, throughput_pct AS a, stw_sec AS b FROM window_stats
  WHERE probe_id IS NOT NULL AND step_sec > 0 AND start_sec IS NOT NULL AND NOT isnan(start_sec) AND abs(start_sec) < 1e15
    AND throughput_pct IS NOT NULL AND NOT isnan(throughput_pct) AND throughput_pct BETWEEN 0 AND 100
    AND stw_sec IS NOT NULL AND NOT isnan(stw_sec) AND stw_sec >= 0 AND NOT isinf(stw_sec)),
o AS (SELECT probe_id, slot, min(step) AS step, count(*) AS n, avg(t) AS t, avg(a) AS a, avg(b) AS b FROM r GROUP BY probe_id, slot),
l AS (SELECT *, lead(slot) OVER w AS qs, lead(t) OVER w AS qt, lead(a) OVER w AS qa, lead(b) OVER w AS qb,
        lead(slot) OVER w - slot - 1 <= 12 AS joined, slot - lag(slot) OVER w - 1 <= 12 AS joined_before, lead(t) OVER w - t AS h, t - lag(t) OVER w AS hb,
        (lead(a) OVER w - a) / (lead(t) OVER w - t) AS da, (a - lag(a) OVER w) / (t - lag(t) OVER w) AS dab,
        (lead(b) OVER w - b) / (lead(t) OVER w - t) AS db, (b - lag(b) OVER w) / (t - lag(t) OVER w) AS dbb
      FROM o WINDOW w AS (PARTITION BY probe_id ORDER BY slot)),
"""


def _p2_slope(d: str, before: str, fwd2: str, back2: str) -> str:
    """Slope at a point of a segment: weighted harmonic mean inside, limited three-point formula at its ends, the chord where it has two points."""

    def end(h0: str, h1: str, d0: str, d1: str) -> str:
        raw = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
        return f"CASE WHEN {raw} * {d0} <= 0 THEN 0e0 WHEN {d0} * {d1} < 0 AND abs({raw}) > abs(3 * {d0}) THEN 3 * {d0} ELSE {raw} END"

    inner = f"CASE WHEN {before} * {d} <= 0 THEN 0e0 ELSE ((2 * h + hb) + (h + 2 * hb)) / ((2 * h + hb) / {before} + (h + 2 * hb) / {d}) END"
    return f"""CASE WHEN coalesce(joined_before, false) AND coalesce(joined, false) THEN {inner}
      WHEN coalesce(joined, false) THEN CASE WHEN coalesce(joined2, false) THEN {end("h", "h2", d, fwd2)} ELSE {d} END
      WHEN coalesce(joined_before, false) THEN CASE WHEN coalesce(joined_b2, false) THEN {end("hb", "hb2", before, back2)} ELSE {before} END END"""


P2_SERIES_SQL = (
    _P2_CTES
    + f"""m AS (SELECT *, lead(joined) OVER w AS joined2, lead(h) OVER w AS h2, lead(da) OVER w AS da2, lead(db) OVER w AS db2,
        lag(joined_before) OVER w AS joined_b2, lag(hb) OVER w AS hb2, lag(dab) OVER w AS dab2, lag(dbb) OVER w AS dbb2
      FROM l WINDOW w AS (PARTITION BY probe_id ORDER BY slot)),
s AS (SELECT *, {_p2_slope("da", "dab", "da2", "dab2")} AS ma, {_p2_slope("db", "dbb", "db2", "dbb2")} AS mb FROM m),
e AS (SELECT *, lead(ma) OVER w AS ma1, lead(mb) OVER w AS mb1 FROM s WINDOW w AS (PARTITION BY probe_id ORDER BY slot)),
c AS (SELECT *, unnest(generate_series(0, coalesce(qs - slot - 1, 0))) AS k FROM e),
x AS (SELECT *, ((slot + k + 0.5e0) * step - t) / h AS u FROM c)
SELECT probe_id, slot + k AS slot, (slot + k) * step AS slot_start_sec, CASE WHEN k = 0 THEN 'observed' WHEN joined THEN 'filled' ELSE 'gap' END AS status,
       CASE WHEN k = 0 THEN n ELSE 0 END AS n_readings, """
    + ", ".join(
        f"""floor((CASE WHEN k = 0 THEN {v} WHEN joined THEN least(greatest({v}, q{v}), greatest(least({v}, q{v}),
         (1 + 2 * u) * (1 - u) * (1 - u) * {v} + u * (1 - u) * (1 - u) * h * m{v} + u * u * (3 - 2 * u) * q{v} + u * u * (u - 1) * h * m{v}1)) END) * 1e6 + 0.5e0) / 1e6 AS {name}"""
        for v, name in (("a", "throughput_pct"), ("b", "stw_sec"))
    )
    + " FROM x"
)


def _p3_seconds_sql() -> str:
    """Every form that a field of phase times may have, by name, read apart and the first with a value in alias order taken."""
    names = [(c, i, n, schema_drift.DriftSpec().factor(n)) for c in ("phase_seconds", "sub_phase_seconds") for i, n in enumerate(schema_drift.ALIASES[c][1])]
    rows = ", ".join(f"('{c}', {i}, '{n}', {f!r}e0)" for c, i, n, f in names).replace("e-06e0", "e-6").replace("1e-3e0", "1e-3")
    return f"""
WITH a(field, pri, key, factor) AS (VALUES {rows}),
h AS (SELECT DISTINCT ON (feed_id, file_id, line_no) feed_id, file_id, line_no, payload FROM harvest_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
v AS (SELECT file_id, feed_id, line_no, a.field, pri, factor, j.value AS raw, j.type AS t FROM h, json_each(h.payload) AS j JOIN a ON a.key = j.key WHERE j.type <> 'NULL'),
w AS (SELECT *, CASE WHEN t = 'VARCHAR' AND json_valid(raw ->> '$') THEN CAST(raw ->> '$' AS JSON) ELSE CAST(raw AS JSON) END AS doc FROM v),
o AS (SELECT * FROM w WHERE json_type(doc) IN ('OBJECT', 'ARRAY') QUALIFY pri = min(pri) OVER (PARTITION BY feed_id, file_id, line_no, field)),
p AS (
  SELECT feed_id, file_id, line_no, field, factor, e.key AS name, TRY_CAST(e.value ->> '$' AS DOUBLE) AS sec, 0 AS pos FROM (SELECT * FROM o WHERE json_type(doc) = 'OBJECT') x, json_each(x.doc) AS e
  UNION ALL
  SELECT feed_id, file_id, line_no, field, factor, e.value ->> '$.name', TRY_CAST(e.value ->> '$.sec' AS DOUBLE), CAST(e.key AS INTEGER) FROM (SELECT * FROM o WHERE json_type(doc) = 'ARRAY') x, json_each(x.doc) AS e),
d AS (SELECT * FROM p WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feed_id, file_id, line_no, field, name ORDER BY pos DESC) = 1)
SELECT file_id, line_no, field, name, round(sec * factor, 9) AS sec FROM d WHERE sec IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_FOUND_SQL, "p2_series": P2_SERIES_SQL, "p3_found": _p3_found_sql(), "p3_lifespans": _p3_lifespans_sql(), "p3_seconds": _p3_seconds_sql(),
        "p4_found": _p4_sql(False), "p4_entries": _p4_sql(True), "p4_kinds": _p4_kinds_sql(),
    }
