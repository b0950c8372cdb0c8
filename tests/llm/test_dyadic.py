import math
import random
from datetime import datetime

import numpy as np
import pytest

from heapline.llm import dyadic

SCHEMA = "g string, day int, v double, w bigint, code int, sketch string"
QS, NAMES = (0.5, 0.9, 0.99, 0.999), ("p50", "p90", "p99", "p999")
SMALL = dyadic.SketchSpec(few=64)


def test_codes_keep_the_order_of_all_doubles():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.ldexp(rng.random(20000) + 0.5, rng.integers(-1070, 1023, 20000)), rng.random(20000) * 100, [0.0, 5e-324, 1.7e308, math.inf]])
    v = np.unique(np.concatenate([-v, v]))
    codes = dyadic.encode(v)
    assert (np.diff(codes) >= 0).all() and codes.min() == 0 and codes.max() == (1 << 32) - 1
    for x, c in zip(v.tolist(), codes.tolist()):
        got = dyadic.decode(c)
        assert got == x or abs(got - x) <= abs(x) * dyadic.code_error(c)
    assert dyadic.code_error(int(dyadic.encode(np.array([0.25]))[0])) < 3e-8
    assert dyadic.SketchSpec().counters * 1000 < 1 << 32


def within(values, row):
    a = np.sort(values)
    for q, name in zip(QS, NAMES):
        slack = 1.01 * row.value_error * abs(row[name])
        low, high = np.searchsorted(a, row[name] - slack, "left") / len(a), np.searchsorted(a, row[name] + slack, "right") / len(a)
        assert low - row.rank_error - 1 / len(a) <= q <= high + row.rank_error + 1 / len(a)


@pytest.mark.parametrize("spec", [dyadic.SketchSpec(), SMALL])
def test_quantiles_within_stated_error(spark, spec):
    rng = np.random.default_rng(2)
    data = {"ln": np.exp(rng.normal(-6, 1.5, 30000)), "signs": rng.normal(0, 5, 30000), "ties": rng.choice([0.0, 0.0, 0.0, 0.25, 3.0], 5000), "one": np.array([7.0]), None: np.array([1.0, 2.0])}
    rows = [(g, i % 3, float(v), 1, 0, "x") for g, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.g: r for r in dyadic.quantiles(dyadic.build_sketch(df, ["g"], "v", spec=spec), ["g"], QS, NAMES, spec).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g].n_values == len(vs) and got[g].rank_error < 0.03
        within(vs, got[g])
    assert got["one"].rank_error == 0 and got["ln"].rank_error > 0


@pytest.mark.parametrize("spec", [dyadic.SketchSpec(), SMALL, dyadic.SketchSpec(few=64, task_bytes=1)])
def test_sketches_add_up_and_take_deletions(spark, spec):
    rng = random.Random(4)
    rows = [("a", i % 5, rng.expovariate(3.0), 1, 0, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)

    def counters(sketch):
        return [dyadic.Sketch.unpack(bytes(r.sketch), spec).dense().tolist() for r in sketch.collect()]

    whole = counters(dyadic.build_sketch(df, ["g"], "v", spec=spec))
    days = dyadic.build_sketch(df, ["g", "day"], "v", spec=spec)
    assert days.count() == 5 and counters(dyadic.merge(days, ["g"], spec)) == whole
    gone = [(g, d, v, -1, 0, "x") for g, d, v, *_ in rows if d == 4]
    without = dyadic.build_sketch(spark.createDataFrame(rows + gone, SCHEMA), ["g"], "v", "w", spec)
    kept = dyadic.build_sketch(df.filter("day < 4"), ["g"], "v", spec=spec)
    assert counters(without) == counters(kept)
    none = dyadic.build_sketch(df.unionByName(df.withColumn("w", -df.w)), ["g"], "v", "w", spec)
    (row,) = dyadic.quantiles(none, ["g"], QS, NAMES, spec).collect()
    assert row.n_values == 0 and row.p50 is None


def test_unusable_values_and_empty(spark):
    rows = [("a", 1, v, 1, 0, "x") for v in (None, math.nan, -1.0, math.inf, 0.0)]
    got = dyadic.quantiles(dyadic.build_sketch(spark.createDataFrame(rows, SCHEMA), ["g"], "v"), ["g"], QS, NAMES).collect()
    assert got[0].n_values == 3 and got[0].p50 == 0.0 and got[0].p999 == math.inf
    assert dyadic.build_sketch(spark.createDataFrame([], SCHEMA), ["g"], "v").count() == 0
    assert dyadic.quantiles(dyadic.build_sketch(spark.createDataFrame([], SCHEMA), ["g"], "v"), ["g"], QS, NAMES).count() == 0


def test_sub_phase_values_count_redelivered_rows_once(spark):
    schema = "log_id int, seq bigint, collection_type string, sub_phase_seconds array<struct<name:string,sec:double>>, arrived_at timestamp, sec double"
    at = datetime(2031, 1, 1)
    rows = [(1, 1, "Young", [("x", 1.0), ("x", None), (None, 1.0), ("y", -1.0)], at, 0.0)] * 2 + [(1, 2, None, [("x", 1.0)], at, 0.0), (1, 3, "G1 mixed", None, at, 0.0)]
    rows += [(1, None, "Mixed", [("x", 2.0)], at, 0.0)] * 2
    got = sorted((r.collection_type, r.sub_phase, r.sec) for r in dyadic.sub_phase_values(spark.createDataFrame(rows, schema)).collect())
    assert got == [("Mixed", "x", 2.0), ("Mixed", "x", 2.0), ("Young", "x", 1.0)]


def test_extreme_values_keep_their_order(spark):
    data = {"inf": [1.0] * 6 + [math.inf] * 4, "big": [1.0] * 6 + [5e200] * 4, "tiny": [1e-300] * 6 + [1.0] * 4, "zero": [0.0, -0.0] * 3 + [1.0] * 4}
    df = spark.createDataFrame([(g, 1, v, 1, 0, "x") for g, vs in data.items() for v in vs], SCHEMA)
    got = {r.g: r for r in dyadic.quantiles(dyadic.build_sketch(df, ["g"], "v"), ["g"], QS, NAMES).collect()}
    for g, vs in data.items():
        for q, name in zip(QS, NAMES):
            want = sorted(vs)[math.ceil(q * 10) - 1]
            assert got[g][name] == want or abs(got[g][name] - want) <= got[g].value_error * want
        assert got[g].value_error < 1e-5
