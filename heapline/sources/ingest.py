"""Log files to the tables of the views: read, parse by mined templates, and lay out as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cluster import shared_checkpoint
from ..operators import log_templates
from .text import event_class, facts_of_entries, raw_lines, zgc_details


def _as_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of the table, null where it has none."""
    want = df.sparkSession.createDataFrame([], S.DDL[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def _numbered(paths: DataFrame) -> DataFrame:
    """(log_path, log_id): dense numbers over the sorted paths; a task numbers its range, one summary row a task gives the offsets."""
    parts = shared_checkpoint(paths.repartitionByRange("log_path").withColumn("part", F.spark_partition_id()))
    sooner = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("log_path"))
    return parts.withColumn("i", inside).join(offsets, "part").select("log_path", (F.col("i") + F.col("offset")).cast("int").alias("log_id"))


def _family() -> Column:
    pairs = [(c, S.family(c)) for c in (*S.GG, *S.G1_CONCURRENT, *S.CMS_CONCURRENT, *S.ZGC)]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), F.col("event_class"))


def _details(facts: DataFrame) -> DataFrame:
    """One row for each (log, GC number): what its lines beside the event's own say."""
    regions = F.map_from_entries(F.collect_list(F.when(F.col("region").isNotNull(), F.struct(F.col("region.name"), F.struct("region.before", "region.after")))))
    return facts.filter("gc_id IS NOT NULL").groupBy("log_path", "gc_id").agg(
        F.first("cpu", ignorenulls=True).alias("cpu"),
        F.first("metaspace", ignorenulls=True).alias("meta"),
        regions.alias("named"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("phase").isNotNull(), F.struct("seq", "phase")))), lambda x: x["phase"]).alias("phases"),
        F.first("load", ignorenulls=True).alias("load"),
        *zgc_details(facts),
    )


def _events(facts: DataFrame) -> DataFrame:
    """The events with the details of their GC number; those of a number that has several events stay without."""
    rows = facts.withColumn("event_class", event_class(F.col("log_collector"), F.col("title"))).filter("event_class IS NOT NULL AND duration_us IS NOT NULL")
    own = rows.groupBy("log_path", "gc_id").agg(F.count(F.lit(1)).alias("own"))
    details = _details(facts).join(own.filter("own = 1 AND gc_id IS NOT NULL").drop("own"), ["log_path", "gc_id"])
    got = rows.drop("cpu", "metaspace", "load", "phase", "region").join(details, ["log_path", "gc_id"], "left")
    z = F.col("log_collector") == "zgc"
    # the last line of a cycle carries its end; an event's time is its beginning
    begun = F.col("t_us") - F.when(z, F.col("duration_us")).otherwise(F.lit(0))
    kb = lambda c: F.col(c) * 1024
    used = F.struct(F.lit(True).alias("valid"), F.col("meta.used").alias("occ_before"), F.col("meta.used").alias("occ_after"), F.col("meta.committed").alias("size_before"), F.col("meta.committed").alias("size_after"))
    none = F.lit(None)
    zgc = F.struct(
        "pauses",
        "concurrent",
        F.when(F.col("heap").isNotNull(), F.struct(kb("heap.occ_before").alias("occ_before"), kb("heap.occ_after").alias("occ_after"))).alias("memory"),
        none.cast("struct<max_capacity:bigint>").alias("capacity"),
        none.cast("struct<live_relocate_start:bigint,live_relocate_end:bigint>").alias("live"),
        F.when(F.col("meta").isNotNull(), F.struct("meta.used", "meta.committed")).alias("metaspace"),
        "load",
    )
    at = lambda r: F.try_element_at("named", F.lit(r)).alias(r)
    return got.select(
        "log_id",
        "seq",
        begun.alias("t_us"),
        (begun / F.lit(1e6)).alias("t_sec"),
        "event_class",
        _family().alias("family"),
        F.regexp_replace("event_class", "^(G1|ZGC)(?=[A-Z])|Collection$", "").alias("gc_type"),
        F.col("cause").alias("gc_cause"),
        "duration_us",
        F.when(~z, F.col("heap")).alias("heap"),
        F.when(~z & F.col("meta").isNotNull(), used).alias("metaspace"),
        "cpu",
        F.when(F.size("named") > 0, F.struct(*(at(r) for r in S.REGIONS))).alias("regions"),
        F.when(F.size("phases") > 0, F.col("phases")).alias("phases"),
        F.lit(False).alias("aborted"),
        F.col("title").contains("Evacuation Failure").alias("to_space_exhausted"),
        F.when(z, zgc).alias("zgc"),
        F.timestamp_millis("ts_ms").alias("arrived_at"),
    )


def ingest(spark: SparkSession, logs: str, target: str, meta: DataFrame | None = None) -> None:
    """Write the event tables of the unified logs under ``logs``, of any of the five collectors, to ``target``.

    A log's collector is the one it says it uses.  Times count from the log's first
    entry.  Collections, concurrent phases and their heap, causes, processor
    times, regions, phases, metaspace and loads become gc_events, safepoints and
    survivor ages tables of their own.  ``unparsed`` counts for each log the
    entries of collections that gave no event or detail; a log of an unknown
    collector has no events, and all its entries of collections are counted there.
    ``meta`` (log_path, started_at) is needed for layouts without a date; without
    it their uptimes count from 1970.
    """
    lines = raw_lines(spark, logs)
    if meta is None:
        meta = lines.select("log_path").distinct().withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    facts = shared_checkpoint(facts_of_entries(log_templates.entries(lines, meta)).filter("ts_ms IS NOT NULL"))
    about = facts.groupBy("log_path").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.min_by("collector", F.when(F.col("collector").isNotNull(), F.col("seq"))).alias("log_collector"))
    about = shared_checkpoint(about.join(_numbered(facts.select("log_path").distinct()), "log_path"))
    facts = facts.join(about.select("log_path", "log_id", "start_ms", "log_collector"), "log_path")
    facts = facts.withColumn("t_us", (F.col("ts_ms") - F.col("start_ms")) * 1000)
    _as_table(_events(facts), "gc_events").write.mode("overwrite").parquet(f"{target}/gc_events.parquet")
    safe = facts.filter("safepoint IS NOT NULL").select("log_id", "seq", "t_us", F.col("safepoint.us").alias("duration_us"), F.col("safepoint.operation").alias("vm_operation"))
    _as_table(safe, "safepoints").write.mode("overwrite").parquet(f"{target}/safepoints.parquet")
    ages = facts.filter("gc_id IS NOT NULL AND (threshold IS NOT NULL OR age IS NOT NULL)").groupBy("log_id", "gc_id").agg(
        F.min("seq").alias("seq"), F.min("t_us").alias("t_us"), F.first("threshold", ignorenulls=True).alias("th"),
        F.map_from_entries(F.collect_set(F.when(F.col("age").isNotNull(), F.struct("age.age", "age.bytes")))).alias("at"),
    ).filter("th IS NOT NULL")
    most = F.greatest(F.col("th.most"), F.coalesce(F.array_max(F.map_keys("at")), F.lit(0)))
    by_age = F.transform(F.sequence(F.lit(0).cast("bigint"), most), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("bigint")))
    survivors = ages.select("log_id", "seq", "t_us", F.col("th.calculated").alias("calculated_threshold"), F.col("th.most").alias("max_threshold"), F.col("th.desired").alias("desired_occupancy"), by_age.alias("bytes_at_age"))
    _as_table(survivors, "survivor_records").write.mode("overwrite").parquet(f"{target}/survivor_records.parquet")
    logs_of = about.select(
        "log_id", "log_path", F.element_at(F.split("log_path", "/"), -1).alias("filename"), F.col("log_collector").alias("collector"),
        F.timestamp_millis("start_ms").alias("started_at"), ((F.col("end_ms") - F.col("start_ms")) / 1e3).alias("estimated_runtime_sec"), F.current_timestamp().alias("created_at"),
    )
    _as_table(logs_of, "log_meta").write.mode("overwrite").parquet(f"{target}/log_meta.parquet")
    said = F.coalesce(*(F.col(c).isNotNull().cast("int") for c in ("cpu",)))
    for c in ("metaspace", "region", "phase", "load", "safepoint", "threshold", "age"):
        said = F.greatest(said, F.col(c).isNotNull().cast("int"))
    event = event_class(F.col("log_collector"), F.col("title")).isNotNull() & F.col("duration_us").isNotNull()
    known = (F.col("log_collector").isNotNull() & (event | (said == 1) | (F.col("log_collector") == "zgc") & F.col("title").rlike("^([YO]: )?(Pause|Concurrent) "))) | F.col("collector").isNotNull()
    # a line that announces what a later line tells with its duration is no loss
    known |= F.col("component").rlike("start") | (F.col("title").rlike("^(Pause|Concurrent|M(in|aj)or)") & F.col("duration_us").isNull() & F.col("log_collector").isNotNull())
    counts = facts.filter(F.col("component").rlike("^(gc|safepoint)")).groupBy("log_id", "log_path", "log_collector").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unparsed"))
    counts.withColumnRenamed("log_collector", "collector").write.mode("overwrite").parquet(f"{target}/unparsed.parquet")
