from heapline.plans.catalogue import queries
from heapline.streaming import live


def _stream(spark, sf_dir, tmp_path):
    src = f"{sf_dir}/gc_events.parquet"
    spark.read.parquet(src).repartition(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(src).schema).parquet(f"{tmp_path}/in")


def _drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_pauses_as_a_stream(spark, sf_dir, tmp_path):
    events = _stream(spark, sf_dir, tmp_path)
    got = _drain(live.pause_time(live.once(events)), tmp_path, "live_pauses")
    want = queries()["pause_time"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/gc_events.parquet").select("log_id", "seq", "family").distinct(), ["log_id", "seq"])
    assert got.count() == want.filter("family <> 'ZGC'").count()
    pct = _drain(live.percent_time_in_gc(live.once(_stream(spark, sf_dir, tmp_path / "b"))), tmp_path, "live_pct")
    assert 0 < pct.count() < got.count() + 100


def test_pause_rate(spark, sf_dir):
    got = live.pause_rate(spark.read.parquet(f"{sf_dir}/gc_events.parquet")).collect()
    assert sum(r.n for r in got) % 10 == 0
