"""Grid, drift and log templates against brute force, and their edge cases."""

import json
import math
import random
from datetime import datetime

import numpy as np

from heapline.operators import log_templates as lt
from heapline.operators import regular_grid as rg
from heapline.operators import schema_drift as sd

STATS = "reading_id bigint, probe_id string, step_sec int, start_sec double, throughput_pct double, stw_sec double, shard int, slot string"


def pchip(x, y, at):
    """Monotone cubic interpolation, written independently of the operator."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if v * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(v) > abs(3 * d0) else v

    if len(x) == 2:
        m[:] = d[0]
    else:
        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = min(max(int(np.searchsorted(x, at)) - 1, 0), len(x) - 2)
    s = (at - x[i]) / h[i]
    return (1 + 2 * s) * (1 - s) ** 2 * y[i] + s * (1 - s) ** 2 * h[i] * m[i] + s * s * (3 - 2 * s) * y[i + 1] + s * s * (s - 1) * h[i] * m[i + 1]


def test_grid_equals_a_serial_fold(spark):
    rng = random.Random(3)
    rows, slots = [], {}
    for p in ("a", "b"):
        slot = -7
        for k in range(150):
            slot += rng.choice([1, 1, 1, 2, 3, 6, 9])
            t, v = (slot + rng.random() * 0.99) * 5, rng.random() * 100
            rows.append((k, p, 5, t, v, v / 50, 1, "x"))
            slots.setdefault(p, []).append((slot, t, v))
    spec = rg.GridSpec(max_gap_slots=4, shard_slots=8)
    got = {(r.probe_id, r.slot): r for r in rg.regular_grid(spark.createDataFrame(rows, STATS), spec).collect()}
    n = 0
    for p, pts in slots.items():
        segments, cur = [], [pts[0]]
        for a, b in zip(pts, pts[1:]):
            if b[0] - a[0] - 1 > 4:
                segments.append(cur)
                cur = []
            cur.append(b)
        segments.append(cur)
        for seg in segments:
            x, y = np.array([s[1] for s in seg]), np.array([s[2] for s in seg])
            own = {s[0] for s in seg}
            for s in range(seg[0][0], seg[-1][0] + 1):
                r = got[p, s]
                n += 1
                if s in own:
                    assert r.status == "observed"
                else:
                    assert r.status == "filled" and abs(r.throughput_pct - pchip(x, y, (s + 0.5) * 5)) < 1e-8
        gaps = [s for a, b in zip(segments, segments[1:]) for s in range(a[-1][0] + 1, b[0][0])]
        assert all(got[p, s].status == "gap" and got[p, s].throughput_pct is None for s in gaps)
        n += len(gaps)
    assert n == len(got)


def test_grid_edge_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, "a", 10, 5.0, 50.0, 0.0, 1, "x"), (1, "a", 10, 5.0, 50.0, 0.0, 1, "x"), (2, "a", 10, 6.0, 70.0, 0.0, 1, "x"),
        (3, "a", 10, 35.0, 50.0, 0.0, 1, "x"), (4, "a", 10, 99.0, 101.0, 0.0, 1, "x"), (5, "a", 10, 99.0, 1.0, -1.0, 1, "x"),
        (6, "a", 10, nan, 1.0, 1.0, 1, "x"), (7, "a", 10, inf, 1.0, 1.0, 1, "x"), (8, None, 10, 1.0, 1.0, 1.0, 1, "x"),
        (9, "b", 0, 1.0, 1.0, 1.0, 1, "x"), (10, "b", None, 1.0, 1.0, 1.0, 1, "x"), (11, "c", 10, None, 1.0, 1.0, 1, "x"), (12, "d", 10, -1.0, 1.0, 1.0, 1, "x"),
    ]
    got = sorted((r.probe_id, r.slot, r.status, r.n_readings, r.throughput_pct) for r in rg.regular_grid(spark.createDataFrame(rows, STATS)).collect())
    assert got[0] == ("a", 0, "observed", 2, 60.0) and [g[:3] for g in got[1:4]] == [("a", 1, "filled"), ("a", 2, "filled"), ("a", 3, "observed")]
    assert got[4][:3] == ("d", -1, "observed") and len(got) == 5
    assert rg.regular_grid(spark.createDataFrame([], STATS)).count() == 0


DRIFT = "feed_id string, file_id int, written_at timestamp, line_no int, payload string, ord int, producer string"


def _files(*payload_lists):
    return [("f", i, datetime(2031, 1, 1 + i), k, p if isinstance(p, str | None) else json.dumps(p), 7, "x") for i, ps in enumerate(payload_lists) for k, p in enumerate(ps)]


def test_drift_kinds(spark):
    rows = _files(
        [{"tSec": 1.5, "workers": 4, "phaseSeconds": {"a": 1}}],
        [{"t_sec": 1.5, "workers": "4", "phaseSeconds": {"a": 1}}, {"workers": None, "odd": True}],
        [{"t_sec": 2, "workers": "4", "phaseMillis": {"a": 5.0}, "odd": True}],
        ["{broken", None, "[1]"],
    )
    got = {(r.file, r.field_name, r.change_kind) for r in sd.changes(spark.createDataFrame(rows, DRIFT)).collect()}
    assert got == {
        (1, "tSec", "renamed"), (1, "workers", "retyped"), (1, "odd", "added"), (2, "phaseSeconds", "renamed"),
        (3, "t_sec", "removed"), (3, "workers", "removed"), (3, "phaseMillis", "removed"), (3, "odd", "removed"),
    }


def test_drift_unify(spark):
    rows = _files(
        [{"tSec": "1.5", "workers": 4, "phaseSeconds": {"a": 1}}, {"subPhases": [{"name": "x", "sec": 2.0}, {"name": "x", "sec": 3.0}]}],
        [{"phaseMillis": {"a": "500"}, "exhausted": "true"}, {"phaseMillis": json.dumps({"a": 250})}, "nope"],
    )
    got = {(r.file_id, r.line_no): r for r in sd.unify(spark.createDataFrame([*rows, rows[0]], DRIFT)).collect()}
    assert len(got) == 4 and got[0, 0].t_sec == 1.5 and got[0, 0].workers == 4
    assert got[0, 1].sub_phase_seconds == {"x": 3.0} and got[1, 0].phase_seconds == {"a": 0.5} and got[1, 0].to_space_exhausted is True
    assert got[1, 1].phase_seconds == {"a": 0.25}
    empty = spark.createDataFrame([], DRIFT)
    assert sd.unify(empty).count() == 0 and sd.changes(empty).count() == 0


LINES = "line_id bigint, log_path string, line_no int, line string, shard int, text string"
META = "log_path string, started_at timestamp, path string"


def _log(spark, files, started=datetime(2031, 3, 1, 12)):
    rows = [(i, p, n + 1, t, 0, "x") for p, ts in files.items() for i, (n, t) in enumerate(enumerate(ts))]
    return spark.createDataFrame(rows, LINES), spark.createDataFrame([(p, started, "x") for p in files], META)


def test_log_layouts_and_continuations(spark):
    files = {
        "u": ["noise first", "[2031-03-01T12:00:01.500+0000][1.500s][info   ][gc,heap  ] one", "  cont [2.0s]", "", "[2031-03-01T12:00:02.000+0000][2.000s][warning][gc] two"],
        "g": [f"W0301 12:00:0{i}.123456  77 spool.cc:{i}] text {i}\r" for i in range(3)],
        "s": ["Mar  1 12:00:05 host spoold[12]: <crit> boom", "Mar 11 12:00:06 host spoold[12]: <err> bang"],
        "x": ["[0.123s][debug][gc,age ] up", "continued: see [9.9s] above"],
        "j": ['{"ts": 1930000000123, "level": "INFO", "logger": "a.B", "message": "x"}', "{", '  "held": true', "}"],
        "k": ['{"@timestamp": "2031-03-01T12:00:00.5Z", "severity": "error", "logger": "a.C$D", "message": "x"}'],
        "l": ["2031-03-01 12:00:00,250 \x1b[33mINFO \x1b[0m [worker-2] tide.IO - hi", "  | 2031-03-01 12:00:01,250 WARN [w-1] a - quoted"],
        "m": ["2031-03-01T14:00:00.250+02:00 [a.b.C] SEVERE: hi", "\tat a.b(C.java:1)"],
        "o": ["2031-03-01T12:00:00.250+0000: 6.6: [GC pause (G1) (young), 0.1 secs]"],
        "t": ["time=2031-03-01T12:00:00Z level=fatal component=gc-tail msg=\"no\""],
    }
    got = sorted(tuple(r) for r in lt.entry_heads(*_log(spark, files)).collect())
    t0 = 1930132800000 - (1930132800000 - int(datetime(2031, 3, 1, 12).timestamp() * 1000)) if False else int(np.datetime64("2031-03-01T12:00:00", "ms").astype(int))
    assert got == sorted([
        ("u", 2, 4, t0 + 1500, "INFO", "gc,heap"), ("u", 5, 5, t0 + 2000, "WARN", "gc"),
        *[("g", i + 1, i + 1, t0 + 1000 * i + 123, "WARN", "spool.cc") for i in range(3)],
        ("s", 1, 1, t0 + 5000, "FATAL", "spoold"), ("s", 2, 2, t0 + 864006000, "ERROR", "spoold"),
        ("x", 1, 2, t0 + 123, "DEBUG", "gc,age"), ("j", 1, 4, 1930000000123, "INFO", "a.B"),
        ("k", 1, 1, t0 + 500, "ERROR", "a.C$D"), ("l", 1, 2, t0 + 250, "INFO", "tide.IO"),
        ("m", 1, 2, t0 + 250, "ERROR", "a.b.C"), ("o", 1, 1, t0 + 250, "-", "-"), ("t", 1, 1, t0, "FATAL", "gc-tail"),
    ])
    whole = {(r.log_path, r.first_line): r.message for r in lt.entries(*_log(spark, files)).collect()}
    assert whole["j", 1].count("\n") == 3 and whole["u", 2].endswith("[2.0s]\n")


def test_log_entries_across_shards_and_redelivery(spark):
    text = ["[1.000s][info][gc] a", *["more"] * 9, "[2.000s][info][gc] b", "tail"]
    df, meta = _log(spark, {"p": text})
    spec = lt.LogSpec(shard_lines=3)
    twice = df.unionByName(df.filter("line_no % 2 = 0"))
    odd = spark.createDataFrame([(99, None, 1, "[1.0s][info][gc] z", 0, "x"), (98, "p", None, "y", 0, "x"), (97, "p", 50, None, 0, "x")], LINES)
    got = sorted((r.first_line, r.last_line) for r in lt.entry_heads(twice.unionByName(odd), meta, spec).collect())
    assert got == [(1, 10), (11, 12)]
    assert lt.entry_heads(df.limit(0), meta, spec).count() == 0
    assert lt.entries(twice, meta, spec).filter("first_line = 1").first().message.count("more") == 9


LOGS = {
    "g1": """[0.005s][info][gc] Using G1
[1.000s][info][gc,start] GC(0) Pause Young (Normal) (G1 Evacuation Pause)
[1.001s][info][gc,age] GC(0) Desired survivor size 1048576 bytes, new threshold 7 (max threshold 15)
[1.001s][info][gc,age] GC(0) - age   1:     524288 bytes,     524288 total
[1.001s][info][gc,age] GC(0) - age   2:       1024 bytes,     525312 total
[1.002s][info][gc,phases] GC(0)   Pre Evacuate Collection Set: 0.1ms
[1.002s][info][gc,phases] GC(0)   Evacuate Collection Set: 2.9ms
[1.002s][info][gc,heap] GC(0) Eden regions: 10->0(12)
[1.002s][info][gc,heap] GC(0) Old regions: 3->4
[1.003s][info][gc,metaspace] GC(0) Metaspace: 3801K(4096K)->3802K(4096K) NonClass: 3K(4K)->3K(4K)
[1.003s][info][gc] GC(0) Pause Young (Normal) (G1 Evacuation Pause) 24M->4M(256M) 3.250ms
[1.003s][info][gc,cpu] GC(0) User=0.02s Sys=0.01s Real=0.01s
[2.000s][info][gc] GC(1) Pause Young (Concurrent Start) (Metadata GC Threshold) 30M->5M(256M) 2.000ms
[2.100s][info][gc,marking] GC(2) Concurrent Mark 12.500ms
[2.200s][info][gc] GC(2) Pause Remark 6M->6M(256M) 1.000ms
[2.300s][info][gc] GC(2) Pause Cleanup 6M->6M(256M) 0.100ms
[3.000s][info][gc] GC(3) Pause Young (Mixed) (G1 Evacuation Pause) 30M->5M(256M) 2.000ms
[4.000s][info][gc] GC(4) Pause Full (System.gc()) 30M->5M(256M) 20.000ms
[4.100s][info][safepoint] Safepoint "G1CollectFull", Time since last: 900 ns, Reaching safepoint: 100 ns, At safepoint: 20000000 ns, Total: 20100000 ns
[4.200s][info][gc,odd] GC(4) what is this""",
    "parallel": """[0.005s][info][gc] Using Parallel
[1.000s][info][gc] GC(0) Pause Young (Allocation Failure) 24M->4M(256M) 3.250ms
[2.000s][info][gc] GC(1) Pause Full (Ergonomics) 30M->5M(256M) 0.020s""",
    "serial": """[0.005s][info][gc] Using Serial
[1.000s][info][gc] GC(0) Pause Young (Allocation Failure) 24M->4M(256M) 3.250ms
[2.000s][info][gc] GC(1) Pause Full (System.gc()) 30M->5M(256M) 20.000ms""",
    "cms": """[0.005s][info][gc] Using Concurrent Mark Sweep
[1.000s][info][gc] GC(0) Pause Young (Allocation Failure) 24M->4M(256M) 3.250ms
[2.000s][info][gc] GC(1) Pause Initial Mark 30M->30M(256M) 1.000ms
[2.100s][info][gc] GC(1) Concurrent Mark 5.000ms
[2.200s][info][gc] GC(1) Concurrent Preclean 1.000ms
[2.300s][info][gc] GC(1) Pause Remark 30M->30M(256M) 2.000ms
[2.400s][info][gc] GC(1) Concurrent Sweep 4.000ms""",
    "zgc": """[0.005s][info][gc,init] Initializing The Z Garbage Collector
[1.000s][info][gc] GC(0) Minor Collection (Allocation Rate)
[1.001s][info][gc,phases] GC(0) Y: Pause Mark Start 0.010ms
[1.010s][info][gc,phases] GC(0) Y: Concurrent Mark 8.000ms
[1.011s][info][gc,phases] GC(0) Y: Pause Mark End 0.012ms
[1.020s][info][gc,phases] GC(0) Y: Pause Relocate Start 0.009ms
[1.030s][info][gc,phases] GC(0) Y: Concurrent Relocate 7.000ms
[1.031s][info][gc,load] GC(0) Load: 1.50 (10%) / 1.25 (9%) / 1.00 (8%)
[1.031s][info][gc] GC(0) Minor Collection (Allocation Rate) 128M(2%)->64M(1%) 0.031s""",
    "unknown": """[1.000s][info][gc] GC(0) Pause Young (Allocation Failure) 24M->4M(256M) 3.250ms
[1.500s][info][gc] GC(1) Pause Young (Allocation Failure) 24M->4M(256M) 3.250ms""",
}


def test_engine_over_logs_of_all_collectors(spark, tmp_path, sf_dir):
    from heapline.plans.registry import Engine
    from heapline.schema import DDL

    for name, ddl in DDL.items():
        want = spark.createDataFrame([], ddl).schema
        assert [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(f"{sf_dir}/{name}.parquet").schema if f.name in want.fieldNames()] == [(f.name, f.dataType.simpleString()) for f in want]
    (tmp_path / "in").mkdir()
    for name, text in LOGS.items():
        (tmp_path / "in" / f"{name}.log").write_text(text + "\n")
    engine = Engine.load_log(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    about = {r.filename.removesuffix(".log"): r for r in spark.read.parquet(f"{tmp_path}/out/log_meta.parquet").collect()}
    assert sorted(r.log_id for r in about.values()) == [1, 2, 3, 4, 5, 6] and {k: r.collector for k, r in about.items() if k != "unknown"} == {k: k for k in LOGS if k != "unknown"}
    ev = {}
    for r in spark.read.parquet(f"{tmp_path}/out/gc_events.parquet").orderBy("log_id", "seq").collect():
        ev.setdefault(r.log_id, []).append(r)
    classes = {k: [r.event_class for r in ev.get(about[k].log_id, [])] for k in LOGS}
    assert classes == {
        "g1": ["G1Young", "G1YoungInitialMark", "G1ConcurrentMark", "G1Remark", "G1Cleanup", "G1Mixed", "G1SystemGC"],
        "parallel": ["PSYoungGen", "PSFullGC"], "serial": ["DefNew", "SystemGC"],
        "cms": ["ParNew", "InitialMark", "ConcurrentMark", "ConcurrentPreClean", "CMSRemark", "ConcurrentSweep"],
        "zgc": ["ZGCYoungCollection"], "unknown": [],
    }
    young = ev[about["g1"].log_id][0]
    assert (young.gc_cause, young.duration_us, young.t_us, young.heap.occ_before, young.heap.size_after) == ("G1_EVACUATION_PAUSE", 3250, 998000, 24576, 262144)
    assert (young.cpu.user, young.cpu.wall, young.regions.eden.before, young.regions.old.after, young.metaspace.occ_after) == (0.02, 0.01, 10, 4, 3802)
    assert [(p.name, p.sec) for p in young.phases] == [("Pre Evacuate Collection Set", 0.0001), ("Evacuate Collection Set", 0.0029)]
    assert [r.gc_cause for r in ev[about["g1"].log_id][1:]] == ["METADATA_GENERATION_THRESHOLD", None, None, None, "G1_EVACUATION_PAUSE", "JAVA_LANG_SYSTEM"]
    assert ev[about["parallel"].log_id][1].duration_us == 20000
    (z,) = ev[about["zgc"].log_id]
    assert (z.t_us, z.duration_us, z.gc_cause) == (995000, 31000, "ALLOCATION_RATE") and z.zgc.load == [1.5, 1.25, 1.0]
    assert (z.zgc.pauses.mark_end.dur_us, z.zgc.pauses.relocate_start.t_us, z.zgc.concurrent.mark, z.zgc.concurrent.relocate) == (12, 1015000, 0.008, 0.007)
    assert z.zgc.memory.occ_before == 128 << 20 and z.heap is None
    log = about["g1"].log_id
    assert [(r.calculated_threshold, r.max_threshold, r.bytes_at_age[:4]) for r in spark.read.parquet(f"{tmp_path}/out/survivor_records.parquet").collect()] == [(7, 15, [0, 524288, 1024, 0])]
    assert [(r.series if "series" in r else r.vm_operation, r.n) for r in engine.view("safepoint-cause", log).collect()] == [("G1CollectFull", 1)]
    unparsed = {r.log_id: (r.entries, r.unparsed) for r in spark.read.parquet(f"{tmp_path}/out/unparsed.parquet").collect()}
    assert {k: unparsed[r.log_id][1] for k, r in about.items()} == {"g1": 1, "parallel": 0, "serial": 0, "cms": 0, "zgc": 0, "unknown": 2}
    assert sorted(round(r.pause_ms if "pause_ms" in r else r.ms, 3) for r in engine.view("pause-time", log).collect()) == [0.1, 1.0, 2.0, 2.0, 3.25, 20.0]
    assert sorted(r.ms for r in engine.view("zgc-pause-time", about["zgc"].log_id).collect()) == [0.009, 0.01, 0.012]
    plan = engine.view("pause-time", log)._jdf.queryExecution().toString()
    assert f"EqualTo(log_id,{log})" in plan
    assert {r.status for r in engine.status(log).filter("view_id = 'summary'").collect()} == {"OK"}


def test_very_long_lines(spark):
    text = ["[1.000s][info][gc] " + "a." * 300000, "b-" * 200000, "[2.000s][info][gc] " + "word " * 100000]
    df, meta = _log(spark, {"p": text})
    assert sorted((r.first_line, r.last_line) for r in lt.entry_heads(df, meta).collect()) == [(1, 2), (3, 3)]


def test_templates_cover_the_whole_line(spark):
    def line(level, name, message):
        return f'{{"@timestamp": "2031-03-01T12:00:00Z", "severity": "{level}", "logger": "{name}", "message": "{message}"}}'

    messages = ["queue depth is low", "user said stop now", "slot was given back"]
    text = [line(level, name, m) for level in ("info", "warn", "error") for name in ("a.B", "c.D") for m in messages]
    df, _ = _log(spark, {"p": text})
    got = {(r.template, r.tokens, r.lines, r.kind) for r in lt.templates(df).collect()}
    assert got == {(f'{{ " @ timestamp " : " 0-0-0T0:0:0Z " , " severity " : " <*> " , " logger " : " <*> " , " message " : " {m} " }}', 37, 6, "stamp") for m in messages}


def test_templates_split_until_none_splits(spark):
    """Shapes that differ in several places, also behind token 24, or in a word that another one decides."""
    words = [f"{'a b ' * i}x{chr(97 + i)} y{chr(97 + i)} {'z z ' * (9 - i)}" for i in range(9)]
    df, _ = _log(spark, {"p": [f"[1.000s][info][gc] {w}" for w in words]})
    assert sorted(r.template for r in lt.templates(df).collect()) == sorted(f"[ 0.0s ] [ info ] [ gc ] {w.strip()}" for w in words)
    many, _ = _log(spark, {"p": ["[1.000s][info][gc] a b c", "[1.000s][info][gc] a d e", "[1.000s][info][gc] f d g"]})
    assert {r.template.split("] ")[-1] for r in lt.templates(many).collect()} == {"a b c", "a d e", "f d g"}
    assert lt.templates(df.limit(0)).count() == 0


def test_drift_unify_keeps_unknown_fields(spark):
    rows = _files([{"tSec": 1.5, "evacParts": {"a": 1, "b": "x"}, "note": "4", "n": 4, "gone": None}], [{"tSec": 2.5}])
    got = {r.file_id: r for r in sd.unify(spark.createDataFrame(rows, DRIFT)).collect()}
    assert {k: json.loads(x) for k, x in got[0].other_fields.items()} == {"evacParts": {"a": 1, "b": "x"}, "note": "4", "n": 4, "gone": None}
    assert got[0].t_sec == 1.5 and got[1].other_fields == {}


def test_time_behind_a_long_message(spark):
    """The key of the time comes last, behind messages of different lengths that look like keys themselves."""
    rng = random.Random(7)
    words = ["time: 5", "level = warn", "a", "bc", "{x}", "[y], z", '\\"q\\"', "done"]
    text = []
    for i in range(40):
        message = " ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 200])))
        text.append(f'{{"message": "{message}", "level": "INFO", "logger": "x.y", "held": {{"ts": "no", "n": [1, 2]}}, "ts": {1700000000000 + i}}}')
    got = sorted(tuple(r) for r in lt.entry_heads(*_log(spark, {"p": text})).collect())
    assert got == [("p", i + 1, i + 1, 1700000000000 + i, "INFO", "x.y") for i in range(40)]


def test_indented_heads_and_quotations(spark):
    text = ["   1.123: [GC pause (young) 1.0 secs]", "  12.250: [GC pause (young) 1.0 secs]", " | 13.000: [GC pause quoted]", " 123.500: [GC pause (young) 1.0 secs]"]
    t0 = int(np.datetime64("2031-03-01T12:00:00", "ms").astype(int))
    got = sorted(tuple(r) for r in lt.entry_heads(*_log(spark, {"p": text})).collect())
    assert got == [("p", 1, 1, t0 + 1123, "-", "-"), ("p", 2, 3, t0 + 12250, "-", "-"), ("p", 4, 4, t0 + 123500, "-", "-")]


def test_layouts_that_only_their_own_shape_shows(spark):
    """Heads among free text of as many tokens are found one by one."""
    rng = random.Random(3)
    free = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(8)) for _ in range(30)]
    text = ["[1.000s][info][gc] x", *free, "[2.000s][warning][gc] y", "[3.000s][info][gc] z"]
    got = sorted((r.first_line, r.severity) for r in lt.entry_heads(*_log(spark, {"p": text})).collect())
    assert got == [(1, "INFO"), (32, "WARN"), (33, "INFO")]


def test_drift_unify_keeps_lines_without_a_full_key(spark):
    rows = [("f", 1, datetime(2031, 1, 1), None, json.dumps({"tSec": float(i)}), 7, "x") for i in range(5)]
    rows += [(None, 1, datetime(2031, 1, 1), 0, json.dumps({"tSec": 9.0}), 7, "x")] * 2 + [("f", 1, datetime(2031, 1, 1), 3, json.dumps({"tSec": 7.0}), 7, "x")] * 2
    assert sorted(r.t_sec for r in sd.unify(spark.createDataFrame(rows, DRIFT)).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 7.0, 9.0, 9.0]


def test_drift_with_other_aliases(spark):
    spec = sd.DriftSpec(aliases={"length_sec": ("double", ("length", "lengthCs"))}, units={"cs": 1e-2})
    rows = _files([{"length": 1.5, "tSec": 2}], [{"lengthCs": 250, "t_sec": 2}])
    df = spark.createDataFrame(rows, DRIFT)
    assert sorted((r.file_id, r.length_sec, sorted(r.other_fields)) for r in sd.unify(df, spec).collect()) == [(0, 1.5, ["tSec"]), (1, 2.5, ["t_sec"])]
    assert {(r.field_name, r.change_kind, r.new_name) for r in sd.changes(df, spec).collect()} == {("length", "renamed", "lengthCs"), ("tSec", "renamed", "t_sec")}
