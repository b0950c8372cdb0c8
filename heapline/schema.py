"""Event classes, categories and how they relate."""

from __future__ import annotations

# Event classes by family and role.
G1_YOUNG = ("G1Young", "G1Mixed", "G1YoungInitialMark")
G1_FULL = ("G1FullGC", "G1SystemGC", "G1FullGCNES")
G1_PAUSE = (*G1_YOUNG, *G1_FULL, "G1Remark", "G1Cleanup")
G1_CONCURRENT = ("G1ConcurrentMark", "G1ConcurrentMarkResetForOverflow")
GEN_YOUNG = ("DefNew", "ParNew", "ParNewPromotionFailed", "PSYoungGen", "YoungGC")
GEN_FULL = ("FullGC", "PSFullGC", "SystemGC", "ConcurrentModeFailure", "ConcurrentModeInterrupted")
CMS_PAUSE = ("InitialMark", "CMSRemark", "ConcurrentModeFailure", "ConcurrentModeInterrupted")
GEN_PAUSE = (*GEN_YOUNG, *GEN_FULL, "InitialMark", "CMSRemark")
CMS_CONCURRENT = ("ConcurrentMark", "ConcurrentSweep", "ConcurrentPreClean", "AbortablePreClean", "ConcurrentReset")
ZGC = ("ZGCYoungCollection", "ZGCOldCollection", "ZGCFullCollection")
#: Pauses with the heap structure of KB pools.
GG = (*G1_PAUSE, *GEN_PAUSE)
#: Classes whose pause counts as full-collection time of the summary.
SUMMARY_FULL = ("FullGC", "PSFullGC", "G1FullGC", "SystemGC", "ConcurrentModeFailure", "ConcurrentModeInterrupted")

# Category of each class; None of them for concurrent phases.
CATEGORY: dict[str, tuple[str, ...]] = {
    "YOUNG": ("G1Young", *GEN_YOUNG, "ZGCYoungCollection"),
    "YOUNG_INITIAL_MARK": ("G1YoungInitialMark",),
    "MIXED": ("G1Mixed",),
    "TENURED": ("G1Remark", "G1Cleanup", "InitialMark", "CMSRemark", "ZGCOldCollection"),
    "FULL": (*G1_FULL, *GEN_FULL, "ZGCFullCollection"),
}
REGIONS = ("eden", "survivor", "old", "humongous", "archive")
REFERENCES = ("soft", "weak", "final", "phantom")
OTHER_PHASES = ("code_root_fixup", "code_root_migration", "code_root_purge", "clear_ct", "expand_heap", "string_dedup")
ZGC_CONCURRENT = (
    "mark", "mark_continue", "mark_free", "process_non_strong_references",
    "reset_relocation_set", "select_relocation_set", "relocate", "remap_roots",
)
ZGC_PAUSES = ("mark_start", "mark_end", "relocate_start")
#: (column prefix, series) of the sub-phase views.
SUB_PHASES = {"pre": "pre_phases", "evac": "evac_phases", "post": "post_phases"}


def family(event_class: str) -> str:
    return "ZGC" if event_class in ZGC else "G1GC" if event_class in (*G1_PAUSE, *G1_CONCURRENT) else "GENERATIONAL"


def sql_in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def sql_category(column: str = "event_class") -> str:
    whens = " ".join(f"WHEN {column} IN {sql_in(classes)} THEN '{cat}'" for cat, classes in CATEGORY.items())
    return f"CASE {whens} END"


_POOL = "struct<valid:boolean,occ_before:bigint,occ_after:bigint,size_before:bigint,size_after:bigint>"
_SUB = "array<struct<name:string,sec:double>>"
_SPAN = "struct<t_us:bigint,dur_us:bigint>"
#: Tables that the views read, in DDL.
DDL: dict[str, str] = {
    "gc_events": ", ".join([
        "log_id int, seq bigint, t_us bigint, t_sec double, event_class string, family string, gc_type string, gc_cause string, duration_us bigint",
        f"heap {_POOL}, tenured {_POOL}, metaspace {_POOL}, cpu struct<user:double,kernel:double,wall:double>",
        "refs struct<" + ",".join(f"{r}:struct<n:int,sec:double>" for r in REFERENCES) + ">",
        "regions struct<" + ",".join(f"{r}:struct<before:int,after:int>" for r in REGIONS) + ">",
        f"phases {_SUB}, pre_phases {_SUB}, evac_phases {_SUB}, post_phases {_SUB}",
        "other_phases struct<" + ",".join(f"{k}:double" for k in OTHER_PHASES) + ">",
        "aborted boolean, to_space_exhausted boolean",
        "zgc struct<pauses:struct<" + ",".join(f"{p}:{_SPAN}" for p in ZGC_PAUSES) + ">,concurrent:struct<" + ",".join(f"{c}:double" for c in ZGC_CONCURRENT) + ">"
        ",memory:struct<occ_before:bigint,occ_after:bigint>,capacity:struct<max_capacity:bigint>,live:struct<live_relocate_start:bigint,live_relocate_end:bigint>"
        ",metaspace:struct<used:bigint,committed:bigint>,load:array<double>>",
        "arrived_at timestamp",
    ]),
    "safepoints": "log_id int, seq bigint, t_us bigint, duration_us bigint, vm_operation string",
    "survivor_records": "log_id int, seq bigint, t_us bigint, calculated_threshold int, max_threshold int, desired_occupancy bigint, bytes_at_age array<bigint>",
    "log_meta": "log_id int, estimated_runtime_sec double, filename string, log_path string, collector string, started_at timestamp, created_at timestamp",
}
