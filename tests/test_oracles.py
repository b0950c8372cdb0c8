import pytest

from heapline.plans import catalogue

from .oracle import compare, connect

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(catalogue.queries()[name](spark, sf_dir), connect(sf_dir).sql(SQL[name]))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "log_id"
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_view_has_its_queries(spark, sf_dir):
    from heapline.plans.registry import VIEWS, Engine

    assert len(VIEWS) == 48
    assert {q for v in VIEWS.values() for q in v.queries} <= set(catalogue.queries())
    eng = Engine(spark, sf_dir)
    assert {r.view_id for r in eng.status().select("view_id").distinct().collect()} == set(VIEWS)
    log = eng.view("pause-time").first().log_id
    assert '"view":"pause-time"' in eng.json("pause-time", log).first().json
    eng.drop(log)
    assert eng.view("pause-time", log).count() == 0
    with pytest.raises(KeyError):
        eng.view("no-such-view")


def test_views_over_prepared_tables(spark, sf_dir, tmp_path):
    from heapline.sources.prepare import prepare

    prepare(spark, sf_dir, str(tmp_path))
    con = connect(sf_dir)
    for name in ("pause_time", "allocation_rate", "summary_stw_table", "tenuring_breakdown", "safepoint_cause", "zgc_pause_time", "g1_evac_pct", "view_status"):
        compare(catalogue.queries()[name](spark, str(tmp_path)), con.sql(SQL[name]))
    plan = catalogue.queries()["zgc_pause_time"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "PartitionFilters: [family" in plan
