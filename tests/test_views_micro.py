"""Edge semantics on hand-written events."""

import json

import pytest

from heapline.plans import catalogue
from heapline.plans.base import REGISTRY

POOL = "struct<valid:boolean,occ_before:bigint,occ_after:bigint,size_before:bigint,size_after:bigint>"


@pytest.fixture(scope="module")
def schemas(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").schema for t in ("gc_events", "log_meta", "survivor_records", "safepoints")}


def tables(spark, schemas, tmp_path, **rows):
    for name, schema in schemas.items():
        lines = [json.dumps(r) for r in rows.get(name, [])]
        spark.read.schema(schema).json(spark.sparkContext.parallelize(lines, 1)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def ev(seq, sec, cls="G1Young", dur_ms=10.0, **more):
    us = round(sec * 1e6)
    family = "ZGC" if cls.startswith("ZGC") else "G1GC" if cls.startswith("G1") else "GENERATIONAL"
    return {"log_id": 1, "seq": seq, "t_us": us, "t_sec": us / 1e6, "event_class": cls, "family": family, "duration_us": round(dur_ms * 1e3), **more}


def heap(before, after, size=10240):
    return {"heap": {"valid": True, "occ_before": before, "occ_after": after, "size_before": size, "size_after": size}}


def run(spark, name, folder):
    return REGISTRY[name].run(spark, folder).collect()


def test_empty_tables(spark, schemas, tmp_path):
    folder = tables(spark, schemas, tmp_path)
    for name in REGISTRY:
        assert run(spark, name, folder) == [], name


def test_single_event_has_no_interval(spark, schemas, tmp_path):
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0, **heap(100, 50))])
    assert run(spark, "percent_time_in_gc", folder) == [] and run(spark, "allocation_rate", folder) == []
    (row,) = run(spark, "summary_stw_table", folder)
    assert row.interval_s is None and row.n == 1


def test_zero_duration_pause(spark, schemas, tmp_path):
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0), ev(2, 2.0, dur_ms=0.0)])
    assert [r.seq for r in run(spark, "pause_time", folder)] == [1]
    assert [(r.seq, r.pct) for r in run(spark, "percent_time_in_gc", folder)] == [(2, 0.0)]


def test_same_time_gives_a_point_but_no_rate(spark, schemas, tmp_path):
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0, **heap(2048, 1024)), ev(2, 1.0, **heap(2048, 1024))])
    assert run(spark, "allocation_rate", folder) == []
    assert [r.mb for r in run(spark, "allocation_per_collection", folder)] == [1.0]


@pytest.mark.parametrize(("drops", "status"), [(5, "OK"), (6, "WARNING")])
def test_allocation_rate_warns_beyond_five_drops(spark, schemas, tmp_path, drops, status):
    rows, t = [ev(0, 0.5, **heap(100, 100))], 1.0
    for i in range(drops):
        rows += [ev(2 * i + 1, t, **heap(50, 40)), ev(2 * i + 2, t + 0.5, **heap(100, 100))]
        t += 1
    folder = tables(spark, schemas, tmp_path, gc_events=rows)
    got = {r.view_id: r.status for r in run(spark, "view_status", folder)}
    assert got["allocation-rate"] == status and got["allocation-per-collection"] == "WARNING"


def test_all_heaps_invalid_is_empty(spark, schemas, tmp_path):
    bad = {"heap": {"valid": False, "occ_before": 1, "occ_after": 1, "size_before": 1, "size_after": 1}}
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0, **bad), ev(2, 2.0, **bad)])
    got = {r.view_id: r.status for r in run(spark, "view_status", folder)}
    assert got["heap-occupancy"] == "EMPTY" and got["zgc-pause-time"] == "ERROR" and got["pause-time"] == "OK"


def test_resize_and_back_to_back_limits_are_strict(spark, schemas, tmp_path):
    rows = [ev(1, 1.0, **heap(10, 5, 10240)), ev(2, 1.02, **heap(10, 5, 10240 + 512)), ev(3, 5.0, **heap(10, 5, 10240 + 1025))]
    (note,) = run(spark, "summary_notes", tables(spark, schemas, tmp_path, gc_events=rows))
    assert note.heap_resized == 1 and note.back_to_back == 0
    rows[1]["t_us"] -= 1
    (note,) = run(spark, "summary_notes", tables(spark, schemas, tmp_path / "b", gc_events=rows))
    assert note.back_to_back == 1


def test_redelivered_and_keyless_rows(spark, schemas, tmp_path):
    rows = [ev(1, 1.0), ev(1, 1.0), ev(2, 2.0), {**ev(3, 3.0), "log_id": None}, {**ev(4, 4.0), "event_class": None}]
    folder = tables(spark, schemas, tmp_path, gc_events=rows)
    assert sorted(r.seq for r in run(spark, "pause_time", folder)) == [1, 2]


def test_mixed_runs(spark, schemas, tmp_path):
    seq = ["G1Mixed", "G1YoungInitialMark", "G1Mixed", "G1Mixed", "G1YoungInitialMark", "G1YoungInitialMark", "G1Mixed"]
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(i, float(i), c) for i, c in enumerate(seq)])
    assert sorted((r.mixed, r.runs) for r in run(spark, "an_mixed_runs", folder)) == [(0, 1), (2, 1)]


@pytest.mark.parametrize(("calls", "found"), [(5, 1), (4, 0)])
def test_periodic_calls(spark, schemas, tmp_path, calls, found):
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(i, 60.0 * i, "G1FullGC", gc_cause="JAVA_LANG_SYSTEM") for i in range(calls)])
    assert len(run(spark, "an_periodic_gc", folder)) == found
    assert run(spark, "an_system_gc", folder)[0].system_gcs == calls


def test_trend_verdicts(spark, schemas, tmp_path):
    few = [ev(i, float(i), **heap(900, 500)) for i in range(19)]
    (row,) = run(spark, "an_heap_stability", tables(spark, schemas, tmp_path / "a", gc_events=few))
    assert row.verdict == "not enough"
    same = [ev(i, float(i), **heap(900, 500)) for i in range(20)]
    (row,) = run(spark, "an_heap_stability", tables(spark, schemas, tmp_path / "b", gc_events=same))
    assert row.verdict == "constant"
    leak = [ev(i, float(i), **heap(9000, 1024 * i)) for i in range(40)]
    (row,) = run(spark, "an_heap_stability", tables(spark, schemas, tmp_path / "c", gc_events=leak))
    assert row.verdict == "leaking" and abs(row.mb_per_hour - 3600) < 1e-6


def test_exceeded_age_is_that_of_the_first_record(spark, schemas, tmp_path):
    def sv(seq, ages, **more):
        return {"log_id": 1, "seq": seq, "t_us": seq, "max_threshold": 3, "desired_occupancy": 10, "bytes_at_age": [0, *ages], **more}

    rows = [sv(1, [1, 1, 20], calculated_threshold=0), sv(2, [20, 1, 1], calculated_threshold=3)]
    folder = tables(spark, schemas, tmp_path, survivor_records=rows, gc_events=[ev(1, 1.0)])
    (head,) = run(spark, "tenuring_headline", folder)
    assert head.exceeded_at_age == 3 and head.premature == 1
    assert sorted((r.threshold, r.n) for r in run(spark, "tenuring_threshold_dist", folder)) == [(1, 0), (2, 0), (3, 1)]


def test_regions_with_empty_before(spark, schemas, tmp_path):
    zero = {r: {"before": 0, "after": 0} for r in ("eden", "survivor", "old", "humongous", "archive")}
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0, regions={**zero, "old": {"before": 0, "after": 4}}), ev(2, 2.0, regions=zero)])
    (row,) = run(spark, "g1_regions_before_pct", folder)
    assert row.seq == 1 and row.old == 0.0
    (row,) = run(spark, "g1_regions_after_pct", folder)
    assert row.old == 100.0


def test_mmu_of_a_short_log_is_empty(spark, schemas, tmp_path):
    folder = tables(spark, schemas, tmp_path, gc_events=[ev(1, 1.0), ev(2, 30.0)])
    assert run(spark, "mmu", folder) == []


def test_mmu_clips_pauses(spark, schemas, tmp_path):
    rows = [ev(1, 0.0, dur_ms=1000.0), ev(2, 55.0, dur_ms=10000.0), ev(3, 130.0)]
    got = {(r.series, r.t_sec): r.mutator_pct for r in run(spark, "mmu", tables(spark, schemas, tmp_path, gc_events=rows))}
    assert abs(got["1m", 60.0] - 100 * (60 - 6) / 60) < 1e-9 and abs(got["1m", 120.0] - 100 * (60 - 5) / 60) < 1e-9


def test_sharded_order_equals_a_plain_window(spark, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from heapline.functions.ordered import with_previous, with_running_sum
    from heapline.plans.base import events

    df = events(spark, sf_dir)
    w = Window.partitionBy("log_id").orderBy("t_us", "seq")
    for shard in (1_000_000, 60_000_000):
        got = with_running_sum(with_previous(df, F.col("seq"), "p", shard_us=shard), F.lit(1), "n", shard_us=shard)
        bad = got.join(df.select("log_id", "seq", F.lag("seq").over(w).alias("q"), F.row_number().over(w).alias("m")), ["log_id", "seq"])
        assert bad.filter("NOT (p <=> q) OR n <> m").count() == 0 and bad.count() == df.count()
    assert catalogue.queries()


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from heapline.functions.cluster import shared_checkpoint

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_checkpoint(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc, conf=conf)))
