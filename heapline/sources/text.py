"""Log files and parsed log entries as sources of events.

``raw_lines`` reads text files into the table that the log-template operator
takes; ``facts_of_entries`` turns the messages of unified logs of all five
collectors into typed facts, from which ``ingest`` makes the event tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a log names its collector.
COLLECTORS = {
    "g1": r"^Using G1\b",
    "parallel": r"^Using Parallel\b",
    "serial": r"^Using Serial\b",
    "cms": r"^Using Concurrent Mark Sweep\b",
    "zgc": r"^(Using|Initializing) The Z Garbage Collector\b",
}
# What a line calls an event, by collector, and the class of event it is; the first that fits counts.
_CLASSES = {
    "g1": (
        (r"^Pause Young \(Mixed\)", "G1Mixed"),
        (r"^Pause Young \((Concurrent Start|Initial Mark)\)", "G1YoungInitialMark"),
        (r"^Pause (Young|Initial)", "G1Young"),
        (r"^Pause Remark", "G1Remark"),
        (r"^Pause Cleanup", "G1Cleanup"),
        (r"^(Pause )?Full .*\(System\.gc\(\)\)", "G1SystemGC"),
        (r"^(Pause )?Full", "G1FullGC"),
        (r"^Concurrent Mark Reset For Overflow", "G1ConcurrentMarkResetForOverflow"),
        (r"^Concurrent Mark( \(.*\))? [0-9]", "G1ConcurrentMark"),
    ),
    "parallel": ((r"^Pause Young", "PSYoungGen"), (r"^Pause Full .*\(System\.gc\(\)\)", "SystemGC"), (r"^Pause Full", "PSFullGC")),
    "serial": ((r"^Pause Young", "DefNew"), (r"^Pause Full .*\(System\.gc\(\)\)", "SystemGC"), (r"^Pause Full", "FullGC")),
    "cms": (
        (r"^Pause Young", "ParNew"),
        (r"^Pause Initial Mark", "InitialMark"),
        (r"^Pause Remark", "CMSRemark"),
        (r"^Pause Full .*\(System\.gc\(\)\)", "SystemGC"),
        (r"^Pause Full", "FullGC"),
        (r"^Concurrent Mark( \(.*\))? [0-9]", "ConcurrentMark"),
        (r"^Concurrent Preclean( \(.*\))? [0-9]", "ConcurrentPreClean"),
        (r"^Concurrent Abortable Preclean( \(.*\))? [0-9]", "AbortablePreClean"),
        (r"^Concurrent Sweep( \(.*\))? [0-9]", "ConcurrentSweep"),
        (r"^Concurrent Reset( \(.*\))? [0-9]", "ConcurrentReset"),
    ),
    "zgc": ((r"^Minor Collection", "ZGCYoungCollection"), (r"^Major Collection", "ZGCFullCollection"), (r"^(O: )?Old Generation", "ZGCOldCollection")),
}
# Causes as logs write them.
_CAUSES = {
    "System.gc()": "JAVA_LANG_SYSTEM", "Metadata GC Threshold": "METADATA_GENERATION_THRESHOLD", "GCLocker Initiated GC": "GC_LOCKER",
    "Heap Dump Initiated GC": "HEAP_DUMP", "Heap Inspection Initiated GC": "HEAP_INSPECTION", "JvmtiEnv ForceGarbageCollection": "JVMTI_FORCE_GC",
    "Allocation Stall": "ALLOC_STALL",
}
# Phases of a G1 collection, and the concurrent phases of a ZGC cycle with their columns.
_G1_PHASE = r"^(Pre Evacuate Collection Set|Merge Heap Roots|Evacuate Collection Set|Post Evacuate Collection Set|Other): ([0-9.,]+)ms"
_ZGC_PHASES = {
    "Concurrent Mark": "mark", "Concurrent Mark Continue": "mark_continue", "Concurrent Mark Free": "mark_free",
    "Concurrent Process Non-Strong": "process_non_strong_references", "Concurrent Reset Relocation Set": "reset_relocation_set",
    "Concurrent Select Relocation Set": "select_relocation_set", "Concurrent Relocate": "relocate", "Concurrent Remap Roots": "remap_roots",
}
_ZGC_PAUSES = {"Pause Mark Start": "mark_start", "Pause Mark End": "mark_end", "Pause Relocate Start": "relocate_start"}
_HEAP = r"(\d+)([KMG])(?:\(\d+%\))?->(\d+)([KMG])(?:\((\d+)([KMG])\))?"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_path, line_id, line_no, line): lines of all files under ``path``.

    A large file is read in blocks by many tasks: a line's number is its place
    in its block plus the lines of the blocks before, of which there is one
    summary row each.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("log_path", "block").orderBy("at")))
    sooner = Window.partitionBy("log_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("log_path", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = blocks.select("log_path", "block", F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("offset"))
    got = numbered.join(offsets, ["log_path", "block"]).withColumn("line_no", (F.col("i") + F.col("offset")).cast("int"))
    return got.select("log_path", F.xxhash64("log_path", "line_no").alias("line_id"), "line_no", "line")


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def _kb(number: Column, unit: Column) -> Column:
    return number.try_cast("bigint") * F.when(unit == "G", 1048576).when(unit == "M", 1024).otherwise(1)


def _picked(text: Column, pattern: str, names: list[str], kind: str = "double") -> Column:
    """Struct of the groups of a pattern, null where it does not fit."""
    parts = [F.regexp_replace(F.regexp_extract(text, pattern, i + 1), ",", ".").try_cast(kind).alias(n) for i, n in enumerate(names)]
    return F.when(text.rlike(pattern), F.struct(*parts))


def facts_of_entries(entries: DataFrame) -> DataFrame:
    """One row for each entry: log_path, seq, ts_ms, gc_id and what its message says, null where it says nothing of the kind.

    collector, title (the message without decorations), duration_us, cause,
    heap, cpu, metaspace (used, committed), region (name, before, after), phase
    (name, sec), load, safepoint (operation, us), threshold (desired, calculated,
    most) and age (age, bytes).  ``entries`` has log_path, first_line, ts_ms,
    component and message.
    """
    bare = F.regexp_replace(F.split("message", "\n")[0], r"^(\[[^\]]*\]){1,12}\s*", "")
    got = entries.select("log_path", F.col("first_line").cast("bigint").alias("seq"), "ts_ms", "component", bare.alias("bare"))
    got = got.withColumns(
        {
            "gc_id": F.regexp_extract("bare", r"^GC\((\d+)\)", 1).try_cast("bigint"),
            "title": F.trim(F.regexp_replace("bare", r"^GC\(\d+\)\s*", "")),
        }
    )
    t = F.col("title")
    collector = F.lit(None).cast("string")
    for name, pattern in COLLECTORS.items():
        collector = F.when(t.rlike(pattern), name).otherwise(collector)
    part = lambda i: F.regexp_extract(t, _HEAP, i)
    size = F.when(part(5) != "", _kb(part(5), part(6)))
    heap = F.struct(
        F.lit(True).alias("valid"), _kb(part(1), part(2)).alias("occ_before"), _kb(part(3), part(4)).alias("occ_after"), size.alias("size_before"), size.alias("size_after")
    )
    ms, sec = F.regexp_extract(t, r"([0-9]+[.,][0-9]+)ms$", 1), F.regexp_extract(t, r"([0-9]+[.,][0-9]+) ?s(?:ecs)?$", 1)
    said = F.regexp_extract(t, r"\(((?:[^()]|\(\))+)\)(?: [0-9]+[KMG](?:\(\d+%\))?->.*| [0-9.,]+m?s)?$", 1)
    said = F.when(said.rlike(r"^(\d+[KMG]?|Normal|Mixed|Prepare Mixed|Concurrent Start|Initial Mark)$"), F.lit("")).otherwise(said)
    cause = F.try_element_at(F.create_map(*(F.lit(x) for kv in _CAUSES.items() for x in kv)), said)
    own = F.upper(F.regexp_replace(F.trim(F.regexp_replace(said, "[^A-Za-z0-9]+", " ")), " ", "_"))
    age = _picked(t, r"^- age\s+(\d+):\s+(\d+) bytes", ["age", "bytes"], "bigint")
    operation = F.regexp_extract(t, r'^Safepoint "([^"]*)"', 1)
    total_ns = F.regexp_extract(t, r"Total:\s*(\d+) ns", 1).try_cast("bigint")
    return got.select(
        "log_path",
        "seq",
        "ts_ms",
        "gc_id",
        "component",
        "title",
        collector.alias("collector"),
        F.round(F.coalesce(_number(ms) * 1e3, _number(sec) * 1e6)).cast("bigint").alias("duration_us"),
        F.when(said != "", F.coalesce(cause, own)).alias("cause"),
        F.when(part(1) != "", heap).alias("heap"),
        _picked(t, r"^User=([0-9.,]+)s Sys=([0-9.,]+)s Real=([0-9.,]+)s", ["user", "kernel", "wall"]).alias("cpu"),
        _picked(t, r"^Metaspace: \d+K(?:\(\d+K\))?->(\d+)K\((\d+)K\)", ["used", "committed"], "bigint").alias("metaspace"),
        F.when(t.rlike(r"^(Eden|Survivor|Old|Humongous|Archive) regions: "), F.struct(
            F.lower(F.regexp_extract(t, r"^(\w+)", 1)).alias("name"),
            F.regexp_extract(t, r": (\d+)->", 1).try_cast("int").alias("before"), F.regexp_extract(t, r"->(\d+)", 1).try_cast("int").alias("after"),
        )).alias("region"),
        F.when(t.rlike(_G1_PHASE), F.struct(F.regexp_extract(t, _G1_PHASE, 1).alias("name"), (_number(F.regexp_extract(t, _G1_PHASE, 2)) / 1e3).alias("sec"))).alias("phase"),
        F.when(t.rlike("^Load: "), F.transform(F.slice(F.split(F.regexp_replace(t, r"^Load: |\([^)]*\)", ""), "[/ ]+"), 1, 3), lambda x: x.try_cast("double"))).alias("load"),
        F.when(operation != "", F.struct(operation.alias("operation"), F.floor(total_ns / 1000).cast("bigint").alias("us"))).alias("safepoint"),
        _picked(t, r"^Desired survivor size (\d+) bytes, new threshold (\d+) \(max(?:imum)? threshold (\d+)\)", ["desired", "calculated", "most"], "bigint").alias("threshold"),
        age.alias("age"),
    )


def event_class(collector: Column, title: Column) -> Column:
    """Class of event of a line in a log of that collector; null for a line that is none, or of an unknown collector."""
    kind = F.lit(None).cast("string")
    for name, patterns in _CLASSES.items():
        for pattern, cls in reversed(patterns):
            kind = F.when((collector == name) & title.rlike(pattern), cls).otherwise(kind)
    return kind


def zgc_details(rows: DataFrame) -> list[Column]:
    """Aggregates of a ZGC cycle's lines: ``pauses`` and ``concurrent`` as in the event schema, times relative to ``t_us``."""
    title = F.regexp_replace("title", "^[YO]: ", "")
    young = ~F.col("title").startswith("O: ")
    at = lambda name: young & title.rlike(f"^{name}( \\(.*\\))? [0-9]")
    pauses = [
        F.struct(F.min(F.when(at(name), F.col("t_us"))).alias("t_us"), F.min_by(F.when(at(name), F.col("duration_us")), F.when(at(name), F.col("t_us"))).alias("dur_us")).alias(column)
        for name, column in _ZGC_PAUSES.items()
    ]
    concurrent = [F.sum(F.when(title.rlike(f"^{name}( \\(.*\\))? [0-9]"), F.col("duration_us") / 1e6)).alias(column) for name, column in _ZGC_PHASES.items()]
    return [F.struct(*pauses).alias("pauses"), F.struct(*concurrent).alias("concurrent")]
