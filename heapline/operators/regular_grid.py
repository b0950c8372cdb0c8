"""Irregular readings onto a regular grid (one row for every step of a source).

Method: shape-preserving monotone cubic (Fritsch-Carlson/Butland) interpolation
inside each source segment.  A source is cut into time shards of
``shard_slots`` steps so that a hot source is spread over many tasks; each
shard receives the observed reading before it and the two after it ("halo
readings"), which is all that the cubic Hermite intervals it owns need, so
sharding does not change the result.  Gaps longer than ``max_gap_slots`` split a source into segments: they
are left unfilled and marked.

Everything is built from column expressions: one shuffle of the usable
readings by (source, shard), plus a window over at most three edge rows a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, FILLED, GAP = "observed", "filled", "gap"
#: A longer run of missing slots is exploded in blocks of this many, so that no row holds an unbounded array.
_EXPLODE_BLOCK = 8192


@dataclass(frozen=True)
class GridSpec:
    source: str = "probe_id"
    reading: str | None = "reading_id"
    step: str = "step_sec"
    time: str = "start_sec"
    value_bounds: tuple[tuple[str, float, float], ...] = (
        ("throughput_pct", 0.0, 100.0),
        ("stw_sec", 0.0, float("inf")),
    )
    max_gap_slots: int = 12
    shard_slots: int = 4096

    @property
    def values(self) -> list[str]:
        return [v for v, _, _ in self.value_bounds]


def usable_readings(df: DataFrame, spec: GridSpec) -> DataFrame:
    """Rows with a source, a positive step, a finite time and every value present and within its bounds."""
    present = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    ok = F.col(spec.source).isNotNull() & (F.col(spec.step) > 0)
    ok &= present(spec.time) & (F.abs(F.col(spec.time)) < F.lit(1e15))
    for name, low, high in spec.value_bounds:
        ok &= present(name) & (F.col(name) >= F.lit(low))
        ok &= F.col(name) <= F.lit(high) if high != float("inf") else F.col(name) < F.lit(float("inf"))
    return df.filter(ok)


def _observed(df: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per occupied slot: number of readings, mean time and mean values."""
    rows = usable_readings(df, spec).select(
        F.col(spec.source).alias("source"),
        F.col(spec.step).cast("double").alias("step"),
        F.floor(F.col(spec.time) / F.col(spec.step)).cast("bigint").alias("slot"),
        (F.col(spec.reading) if spec.reading else F.lit(None)).alias("reading"),
        F.col(spec.time).alias("t"),
        *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(spec.values)),
    )
    rows = rows.withColumn("shard", F.floor(F.col("slot") / F.lit(spec.shard_slots)).cast("bigint"))
    rows = rows.repartition("source", "shard")
    values = [f"v{i}" for i in range(len(spec.values))]
    # every column is a key, so that both uses of the rows share one shuffle, whatever they need of them later
    once = rows.dropDuplicates(["source", "shard", "step", "slot", "reading", "t", *values])
    return once.groupBy("source", "shard", "slot").agg(
        F.min("step").alias("step"),
        F.count(F.lit(1)).alias("n"),
        F.avg("t").alias("t"),
        *(F.avg(v).alias(v) for v in values),
    )


def _halo(obs: DataFrame, values: list[str]) -> DataFrame:
    """(source, shard, before, after1, after2): for each shard the observed point before it and the two after it."""
    inside = Window.partitionBy("source", "shard").orderBy("slot")
    point = F.struct("slot", "t", *values)
    edges = obs.select(
        "source",
        "shard",
        "slot",
        point.alias("point"),
        F.lag("slot", 1).over(inside).isNull().alias("first"),
        F.lag("slot", 2).over(inside).isNull().alias("early"),
        F.lead("slot", 1).over(inside).isNull().alias("last"),
    ).filter("early OR last")
    across = Window.partitionBy("source").orderBy("slot")
    near = edges.select(
        "source",
        "shard",
        F.when(F.col("first"), F.lag("point", 1).over(across)).alias("before"),
        F.when(F.col("last"), F.lead("point", 1).over(across)).alias("after1"),
        F.when(F.col("last"), F.lead("point", 2).over(across)).alias("after2"),
    )
    return near.groupBy("source", "shard").agg(*(F.max(c).alias(c) for c in ("before", "after1", "after2")))


def _interior(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))


def _end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point end slope, limited so that the interval stays monotone."""
    raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    limited = F.when((d0 * d1 < 0) & (F.abs(raw) > F.abs(3 * d0)), 3 * d0).otherwise(raw)
    return F.when(raw * d0 <= 0, F.lit(0.0)).otherwise(limited)


def regular_grid(df: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    """One row per (source, slot) from its first to its last slot with a usable reading.

    Columns: source, ``slot``, ``slot_start_sec``, ``status`` ('observed',
    'filled' or 'gap'), ``n_readings`` and each value.  Observed slots carry the
    mean of their distinct readings; filled slots the interpolated value at the
    slot's middle; slots of a gap longer than ``max_gap_slots`` are null.

    Unusable rows (nulls, NaN, out-of-bounds values, null source, step that is
    null or not positive) are left out; re-delivered readings count once; ties in
    time fall into one slot; an empty table yields an empty result; other columns
    of the input are ignored, so clashing names are harmless.
    """
    values = [f"v{i}" for i in range(len(spec.values))]
    obs = _observed(df, spec)
    w = Window.partitionBy("source", "shard").orderBy("slot")
    point = F.struct("slot", "t", *values)
    near = obs.withColumns({"p0": F.lag(point, 1).over(w), "q0": F.lead(point, 1).over(w), "r0": F.lead(point, 2).over(w)})
    seq = near.join(_halo(obs, values), ["source", "shard"], "left").withColumns(
        {
            "p": F.coalesce("p0", "before"),
            "q": F.coalesce("q0", "after1"),
            "r": F.coalesce("r0", F.when(F.col("q0").isNotNull(), F.col("after1")).otherwise(F.col("after2"))),
        }
    )
    short = lambda a, b: (F.col(b) - F.col(a) - 1) <= spec.max_gap_slots
    has_p = F.coalesce(short("p.slot", "slot"), F.lit(False))
    has_r = F.coalesce(short("q.slot", "r.slot"), F.lit(False))
    joined = short("slot", "q.slot")
    h0, h1, h2 = F.col("t") - F.col("p.t"), F.col("q.t") - F.col("t"), F.col("r.t") - F.col("q.t")
    slopes = []
    for v in values:
        d0, d1, d2 = (F.col(v) - F.col(f"p.{v}")) / h0, (F.col(f"q.{v}") - F.col(v)) / h1, (F.col(f"r.{v}") - F.col(f"q.{v}")) / h2
        left = F.when(has_p, _interior(h0, h1, d0, d1)).when(has_r, _end(h1, h2, d1, d2)).otherwise(d1)
        right = F.when(has_r, _interior(h1, h2, d1, d2)).when(has_p, _end(h1, h0, d1, d0)).otherwise(d1)
        gap_here = F.col("q.slot") > F.col("slot") + 1
        slopes += [F.when(gap_here & joined, left).alias(f"l_{v}"), F.when(gap_here & joined, right).alias(f"m_{v}")]
    seq = seq.select("source", "slot", "step", "n", "t", "q", *values, *slopes, joined.alias("joined"))

    observed = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi")))
    missing = F.coalesce(F.col("q.slot") - F.col("slot") - 1, F.lit(0))
    blocks = F.when(
        missing > 0,
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.floor((missing - 1) / F.lit(_EXPLODE_BLOCK)).cast("bigint")),
            lambda b: F.struct(
                (b * _EXPLODE_BLOCK + 1).cast("bigint").alias("lo"),
                F.least(missing, (b + 1) * _EXPLODE_BLOCK).cast("bigint").alias("hi"),
            ),
        ),
    )
    cells = (
        seq.withColumn("block", F.explode(F.concat(observed, F.coalesce(blocks, F.expr("array()").cast("array<struct<lo:bigint,hi:bigint>>")))))
        .withColumn("k", F.explode(F.sequence(F.col("block.lo"), F.col("block.hi"))))
    )
    at = (F.col("slot") + F.col("k") + F.lit(0.5)) * F.col("step")
    h = F.col("q.t") - F.col("t")
    s = (at - F.col("t")) / h
    out = []
    for v, name in zip(values, spec.values, strict=True):
        y = (
            (1 + 2 * s) * (1 - s) * (1 - s) * F.col(v)
            + s * (1 - s) * (1 - s) * h * F.col(f"l_{v}")
            + s * s * (3 - 2 * s) * F.col(f"q.{v}")
            + s * s * (s - 1) * h * F.col(f"m_{v}")
        )
        low, high = F.least(F.col(v), F.col(f"q.{v}")), F.greatest(F.col(v), F.col(f"q.{v}"))
        out.append(F.when(F.col("k") == 0, F.col(v)).when(F.col("joined"), F.least(high, F.greatest(low, y))).alias(name))
    return cells.select(
        F.col("source").alias(spec.source),
        (F.col("slot") + F.col("k")).alias("slot"),
        ((F.col("slot") + F.col("k")) * F.col("step")).alias("slot_start_sec"),
        F.when(F.col("k") == 0, OBSERVED).when(F.col("joined"), FILLED).otherwise(GAP).alias("status"),
        F.when(F.col("k") == 0, F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_readings"),
        *out,
    )


def missing_slots(df: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    """The (source, slot) pairs of the grid that have no usable reading."""
    return regular_grid(df, spec).filter(F.col("status") != OBSERVED).select(spec.source, "slot")
