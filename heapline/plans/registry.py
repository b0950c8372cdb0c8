"""The 48 views by id: title, query, shape and axes; an engine that serves them for a folder of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import only_logs, ship_package
from .catalogue import queries


@dataclass(frozen=True)
class View:
    id: str
    title: str
    queries: tuple[str, ...]
    shape: str  # scatter, xy, stacked, category, summary or analytics
    y: str = ""
    unit: str = ""


def _v(id_: str, title: str, query: str | tuple[str, ...], shape: str, y: str = "", unit: str = "") -> tuple[str, View]:
    return id_, View(id_, title, (query,) if isinstance(query, str) else query, shape, y, unit)


# Ids, titles, axes and units of the views.
VIEWS: dict[str, View] = dict([
    _v("heap-occupancy", "Heap size and occupancy after collection", "heap_occupancy", "scatter", "heap (MB)", "MB"),
    _v("heap-occupancy-before", "Heap size and occupancy before collection", "heap_occupancy_before", "scatter", "heap (MB)", "MB"),
    _v("heap-occupancy-before-percent", "% heap occupancy before collection", "heap_occupancy_before_pct", "scatter", "% heap occupancy", "%"),
    _v("heap-occupancy-after-percent", "% heap occupancy after collection", "heap_occupancy_after_pct", "scatter", "% heap occupancy", "%"),
    _v("tenured-occupancy", "Tenured size and occupancy after collection", "tenured_occupancy", "scatter", "tenured (MB)", "MB"),
    _v("tenured-occupancy-before", "Tenured size and occupancy before collection", "tenured_occupancy_before", "scatter", "tenured (MB)", "MB"),
    _v("metaspace-occupancy", "Metaspace size and occupancy after collection", "metaspace_occupancy", "scatter", "metaspace (MB)", "MB"),
    _v("pause-time", "Stop-the-world pause time", "pause_time", "scatter", "pause (ms)", "ms"),
    _v("percent-time-in-gc", "% time in GC over time", "percent_time_in_gc", "scatter", "% time in GC", "%"),
    _v("mmu", "Minimum mutator utilization", "mmu", "xy", "% mutator", "%"),
    _v("concurrent-phase-duration", "Concurrent phase durations", "concurrent_phase", "xy", "duration (ms)", "ms"),
    _v("cpu-breakouts", "CPU breakouts", "cpu_breakouts", "xy", "CPU time (s)", "s"),
    _v("allocation-rate", "Application allocation rate", "allocation_rate", "scatter", "allocation rate (MB/s)", "MB/s"),
    _v("allocation-per-collection", "Allocated between collections", "allocation_per_collection", "scatter", "allocated (MB)", "MB"),
    _v("recovered", "Recovered by each collection", "recovered", "scatter", "recovered (MB)", "MB"),
    _v("summary", "Log summary", ("summary_stw_table", "summary_headline", "summary_notes"), "summary"),
    _v("g1-phases", "G1 phase breakout", "g1_phases", "stacked", "duration (ms)", "ms"),
    _v("g1-phase-percent", "G1 phase breakout (% of pause)", "g1_phase_pct", "stacked", "% of pause", "%"),
    _v("g1-pre-collection", "G1 Pre-Collection sub-phases", "g1_pre_ms", "xy", "duration (ms)", "ms"),
    _v("g1-pre-collection-percent", "G1 Pre-Collection sub-phases (% of phase)", "g1_pre_pct", "xy", "% of phase", "%"),
    _v("g1-collection", "G1 Collection sub-phases", "g1_evac_ms", "xy", "duration (ms)", "ms"),
    _v("g1-collection-percent", "G1 Collection sub-phases (% of phase)", "g1_evac_pct", "xy", "% of phase", "%"),
    _v("g1-post-collection", "G1 Post-Collection sub-phases", "g1_post_ms", "xy", "duration (ms)", "ms"),
    _v("g1-post-collection-percent", "G1 Post-Collection sub-phases (% of phase)", "g1_post_pct", "xy", "% of phase", "%"),
    _v("g1-other-collection", "G1 Other sub-phases", "g1_other_ms", "xy", "duration (ms)", "ms"),
    _v("g1-other-collection-percent", "G1 Other sub-phases (% of phase)", "g1_other_pct", "xy", "% of phase", "%"),
    _v("g1-regions-before", "G1 regions before collection", "g1_regions_before", "stacked", "regions", "regions"),
    _v("g1-regions-after", "G1 regions after collection", "g1_regions_after", "stacked", "regions", "regions"),
    _v("g1-regions-before-percent", "G1 regions before collection (% of total)", "g1_regions_before_pct", "stacked", "% of regions", "%"),
    _v("g1-regions-after-percent", "G1 regions after collection (% of total)", "g1_regions_after_pct", "stacked", "% of regions", "%"),
    _v("tenuring-summary", "Tenuring distribution summary", ("tenuring_headline", "tenuring_breakdown", "tenuring_threshold_dist"), "summary"),
    _v("tenuring-volume", "Tenuring distribution", "tenuring_volume", "xy", "Avg volume (KBytes)", "KB"),
    _v("tenuring-threshold", "Calculated tenuring thresholds", "tenuring_threshold", "xy", "Tenuring threshold"),
    _v("tenuring-over-time", "Tenuring over time", "tenuring_over_time", "xy", "Surviving bytes (KBytes)", "KB"),
    _v("gc-cause", "GC cause by collection type", "gc_cause", "category", "count", "events"),
    _v("reference-count", "Reference processing count", "reference_count", "xy", "reference count"),
    _v("reference-time", "Reference processing time", "reference_time", "xy", "duration (ms)", "ms"),
    _v("safepoint-duration", "Safepoint duration", "safepoint_duration", "xy", "duration (ms)", "ms"),
    _v("safepoint-cause", "Safepoint cause counts", "safepoint_cause", "category", "count"),
    _v("zgc-live-at-relocate-start", "Live at relocate start", "zgc_live_start", "scatter", "live (MB)", "MB"),
    _v("zgc-live-at-relocate-end", "Live at relocate end", "zgc_live_end", "scatter", "live (MB)", "MB"),
    _v("zgc-concurrent-phase-durations", "ZGC concurrent phase durations", "zgc_concurrent_phases", "xy", "duration (ms)", "ms"),
    _v("zgc-cycle-durations", "ZGC cycle durations", "zgc_cycle_durations", "xy", "cycle duration (s)", "s"),
    _v("zgc-cycle-time-percent", "% of cycle time per concurrent phase", "zgc_cycle_pct", "xy", "% of cycle", "%"),
    _v("zgc-pause-time", "ZGC pause time (sub-pauses)", "zgc_pause_time", "xy", "pause (ms)", "ms"),
    _v("zgc-cycle-durations-and-intervals", "ZGC cycle durations and intervals", "zgc_durations_intervals", "xy", "seconds", "s"),
    _v("zgc-system-load", "System load (1m / 5m / 15m)", "zgc_system_load", "xy", "load avg"),
    _v("analytics", "Analytics", "an_findings", "analytics"),
])


class Engine:
    """Views over the tables of one folder; a log is dropped by leaving it out of every later view."""

    def __init__(self, spark: SparkSession, folder: str):
        ship_package(spark)
        self.spark, self.folder = spark, folder
        self._dropped: set[int] = set()

    @classmethod
    def load_log(cls, spark: SparkSession, logs: str, target: str) -> Engine:
        """An engine over the log files under ``logs``, whose tables are written to ``target``."""
        from ..sources.ingest import ingest

        ship_package(spark)
        ingest(spark, logs, target)
        return cls(spark, target)

    def views(self) -> list[str]:
        return list(VIEWS)

    def drop(self, log_id: int) -> None:
        self._dropped.add(log_id)

    def view(self, view_id: str, log_id: int | None = None) -> DataFrame | dict[str, DataFrame]:
        """The view's DataFrame, or one per part of a summary; KeyError for an unknown view.  With a log, only its rows are read."""
        view = VIEWS[view_id]
        got = {q: self._run(q, log_id) for q in view.queries}
        return got if len(got) > 1 else next(iter(got.values()))

    def status(self, log_id: int | None = None) -> DataFrame:
        return self._run("view_status", log_id)

    def json(self, view_id: str, log_id: int) -> DataFrame:
        """Rows of the view as JSON lines, each with the view's id, title, shape and unit; one column ``json``."""
        view = VIEWS[view_id]
        out = None
        for query in view.queries:
            df = self._run(query, log_id)
            head = [F.lit(x).alias(k) for k, x in (("view", view.id), ("title", view.title), ("shape", view.shape), ("part", query), ("unit", view.unit))]
            one = df.select(F.to_json(F.struct(*head, F.struct(*df.columns).alias("row"))).alias("json"))
            out = one if out is None else out.unionByName(one)
        return out

    def _run(self, query: str, log_id: int | None) -> DataFrame:
        with only_logs(log_id, frozenset(self._dropped)):
            return queries()[query](self.spark, self.folder)
