"""Queries over the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import table
from . import bpe_tree, dyadic, langid, leak, runs

QS, QNAMES = (0.5, 0.9, 0.99, 0.999), ("p50", "p90", "p99", "p999")
GROUPS = ("collection_type", "sub_phase")


def _g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "g1_event_rows").withColumn("kind", runs.collection_kind())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.collapse_runs(_g1(spark, sf_dir))
    return got.filter("n_events >= 2").select("log_id", "first_seq", "last_seq")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identical events: bursts further divided where the total phase time changes its order of magnitude."""
    sec = lambda x: F.when(x["sec"].isNull() | F.isnan(x["sec"]) | (x["sec"] < 0), 0.0).otherwise(x["sec"])
    total = F.aggregate("phase_seconds", F.lit(1e-6), lambda a, x: a + sec(x))
    rows = _g1(spark, sf_dir).withColumn("log_total", F.log(total))
    return runs.collapse_runs(rows, runs.RunSpec(features=("log_total",), penalty=2.0))


def p1_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts further divided wherever the number of phases changes, which is dearer than any number of runs."""
    n = F.coalesce(F.when(F.col("phase_seconds").isNotNull(), F.size("phase_seconds")), F.lit(0))
    return runs.collapse_runs(_g1(spark, sf_dir).withColumn("phases", n), runs.RunSpec(features=("phases",), penalty=1e-3))


def _sub_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dyadic.sub_phase_values(table(spark, sf_dir, "g1_event_rows"))


def p5_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dyadic.quantiles(dyadic.build_sketch(_sub_phases(spark, sf_dir), GROUPS, "sec"), GROUPS, QS, QNAMES)


def p5_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the sum of one sketch a day."""
    days = dyadic.build_sketch(_sub_phases(spark, sf_dir), ("day", *GROUPS), "sec")
    return dyadic.quantiles(dyadic.merge(days, GROUPS), GROUPS, QS, QNAMES)


def _within(values: DataFrame, got: DataFrame) -> DataFrame:
    """(groups, percentile, n_values, within): whether the ranks of the value found, widened by its error, enclose the wanted one up to the stated error."""
    stack = ", ".join(f"'{name}', CAST({q} AS DOUBLE), {name}" for name, q in zip(QNAMES, QS, strict=True))
    long = got.select(*GROUPS, "n_values", "rank_error", "value_error", F.expr(f"stack({len(QS)}, {stack}) AS (percentile, q, found)"))
    bounds = long.groupBy(*GROUPS).agg(F.collect_list(F.struct("percentile", "q", "found", "n_values", "rank_error", "value_error")).alias("b"))
    pairs = values.join(bounds, list(GROUPS)).select(*GROUPS, "sec", F.explode("b").alias("b"))
    slack = F.abs(F.col("b.found")) * F.col("b.value_error") * 1.01
    ranks = pairs.groupBy(*GROUPS, "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sec") < F.col("b.found") - slack).alias("below"), F.count_if(F.col("sec") <= F.col("b.found") + slack).alias("upto")
    )
    wanted = F.ceil(F.col("b.q") * F.col("n"))
    room = F.col("b.rank_error") * F.col("n") + 1
    ok = (F.col("b.n_values") == F.col("n")) & (F.col("below") < wanted + room) & (F.col("upto") >= wanted - room)
    return ranks.select(*GROUPS, F.col("b.percentile").alias("percentile"), F.col("n").alias("n_values"), ok.alias("within"))


def p5_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the sketch against exact ranks of all values."""
    return _within(_sub_phases(spark, sf_dir), p5_quantiles(spark, sf_dir))


def p5_days_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the merged days."""
    return _within(_sub_phases(spark, sf_dir), p5_merged_days(spark, sf_dir))


def p5_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of even logs added and taken away again: the percentiles of the odd ones, against their exact ranks."""
    values = _sub_phases(spark, sf_dir)
    even = values.filter("log_id % 2 = 0")
    both = values.withColumn("w", F.lit(1)).unionByName(even.withColumn("w", F.lit(-1)))
    got = dyadic.quantiles(dyadic.build_sketch(both, GROUPS, "sec", "w"), GROUPS, QS, QNAMES)
    return _within(values.filter("log_id IS NULL OR log_id % 2 <> 0"), got)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, langid.Models]:
    docs = table(spark, sf_dir, "documents")
    return docs, langid.train(table(spark, sf_dir, "lang_samples"), docs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_labels(*_models(spark, sf_dir)).select("doc_id", "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.segments(*_models(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.documents(*_models(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_runs, p1_alike, p5_quantiles, p5_merged_days, p5_within, p5_days_within, p5_deleted, p6_ids, p7_found, p7_spans, p8_found, p8_segments, p8_documents)
    return {f.__name__: f for f in found}


P1_FOUND_SQL = """
WITH e AS (
  SELECT DISTINCT log_id, seq, t_sec,
         regexp_replace(regexp_replace(lower(collection_type), '[^a-z0-9]', '', 'g'), '^g1', '') AS kind
  FROM g1_event_rows
  WHERE log_id IS NOT NULL AND seq IS NOT NULL AND t_sec IS NOT NULL AND NOT isnan(t_sec) AND collection_type IS NOT NULL),
b AS (
  SELECT *, CASE WHEN kind = lag(kind) OVER w AND t_sec - lag(t_sec) OVER w <= 1.0e0 THEN 0 ELSE 1 END AS new
  FROM e WHERE kind IN ('young', 'mixed', 'initialmark')
  WINDOW w AS (PARTITION BY log_id ORDER BY t_sec, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY t_sec, seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT log_id, arg_min(seq, (t_sec, seq)) AS first_seq, arg_max(seq, (t_sec, seq)) AS last_seq
FROM r GROUP BY log_id, run HAVING count(*) >= 2
"""


P1_ALIKE_SQL = """
WITH e AS (
  SELECT DISTINCT log_id, seq, t_sec, regexp_replace(regexp_replace(lower(collection_type), '[^a-z0-9]', '', 'g'), '^g1', '') AS kind, coalesce(len(phase_seconds), 0) AS phases
  FROM g1_event_rows
  WHERE log_id IS NOT NULL AND seq IS NOT NULL AND t_sec IS NOT NULL AND NOT isnan(t_sec) AND collection_type IS NOT NULL),
b AS (
  SELECT *, CASE WHEN kind = lag(kind) OVER w AND phases = lag(phases) OVER w AND t_sec - lag(t_sec) OVER w <= 1.0e0 THEN 0 ELSE 1 END AS new
  FROM e WHERE kind IN ('young', 'mixed', 'initialmark')
  WINDOW w AS (PARTITION BY log_id ORDER BY t_sec, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY t_sec, seq ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT log_id, CASE any_value(kind) WHEN 'young' THEN 'Young' WHEN 'mixed' THEN 'Mixed' ELSE 'InitialMark' END AS kind,
       arg_min(seq, (t_sec, seq)) AS first_seq, arg_max(seq, (t_sec, seq)) AS last_seq, count(*) AS n_events,
       min(t_sec) AS start_t, max(t_sec) AS end_t, max(t_sec) - min(t_sec) AS duration
FROM r GROUP BY log_id, run
"""


def _p5_sql(where: str = "true") -> str:
    rows = ", ".join(f"('{name}')" for name in QNAMES)
    return f"""
WITH r AS (
  SELECT DISTINCT ON (log_id, seq) log_id, regexp_replace(regexp_replace(lower(collection_type), '[^a-z0-9]', '', 'g'), '^g1', '') AS kind, sub_phase_seconds
  FROM g1_event_rows WHERE log_id IS NOT NULL AND seq IS NOT NULL
  UNION ALL
  SELECT log_id, regexp_replace(regexp_replace(lower(collection_type), '[^a-z0-9]', '', 'g'), '^g1', ''), sub_phase_seconds
  FROM g1_event_rows WHERE log_id IS NULL OR seq IS NULL),
x AS (SELECT kind, unnest(sub_phase_seconds) AS p FROM r WHERE kind IN ('young', 'mixed', 'initialmark') AND {where}),
n AS (
  SELECT CASE kind WHEN 'young' THEN 'Young' WHEN 'mixed' THEN 'Mixed' ELSE 'InitialMark' END AS collection_type, p.name AS sub_phase, count(*) AS n_values
  FROM x WHERE p.name IS NOT NULL AND p.sec IS NOT NULL AND NOT isnan(p.sec) AND p.sec >= 0 GROUP BY ALL)
SELECT collection_type, sub_phase, percentile, n_values, true AS within FROM n, (VALUES {rows}) AS v(percentile)
"""


def oracle_sql() -> dict[str, str]:
    odd = _p5_sql("(log_id IS NULL OR log_id % 2 <> 0)")
    return {"p1_found": P1_FOUND_SQL, "p1_alike": P1_ALIKE_SQL, "p5_within": _p5_sql(), "p5_days_within": _p5_sql(), "p5_deleted": odd}
