"""Order-dependent functions that do not put a hot key into one task.

Rows of a key are cut into time shards; a window runs inside (key, shard), and
what crosses the shards' borders travels as one summary row a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a shard: one hour of a log.
SHARD_US = 3_600_000_000


def with_shard(df: DataFrame, shard_us: int = SHARD_US) -> DataFrame:
    """``_shard``: number of the time shard of ``t_us``."""
    return df.withColumn("_shard", F.floor(F.col("t_us") / F.lit(shard_us)).cast("bigint"))


def sharded_once(df: DataFrame, shard_us: int = SHARD_US) -> DataFrame:
    """Each row once, in the partitioning by (log_id, _shard) that the ordered functions need.

    The rows of one event are the same in all columns but their arrival, so all
    columns are the key: whatever later steps need of them, they share this one
    scan and shuffle.
    """
    return with_shard(df, shard_us).repartition("log_id", "_shard").dropDuplicates()


def with_last(df: DataFrame, values: dict[str, tuple[Column, Column | None]], by: Sequence[str] = ("log_id",), shard_us: int = SHARD_US) -> DataFrame:
    """For each name: the value of the last row before this one, in the order (t_us, seq) of its key, that meets the condition (None: any); null without one."""
    df = df if "_shard" in df.columns else with_shard(df, shard_us)
    boxed = {k: F.struct(v.alias("v")) if c is None else F.when(c, F.struct(v.alias("v"))) for k, (v, c) in values.items()}
    place = F.struct("t_us", "seq")
    sooner = Window.partitionBy(*by, "_shard").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"_in_{k}": F.last(x, ignorenulls=True).over(sooner) for k, x in boxed.items()})
    ends = df.groupBy(*by, "_shard").agg(*(F.max_by(x, F.when(x.isNotNull(), place)).alias(f"_end_{k}") for k, x in boxed.items()))
    across = Window.partitionBy(*by).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_shard", *(F.last(f"_end_{k}", ignorenulls=True).over(across).alias(f"_carry_{k}") for k in boxed))
    joined = rows.join(carry, [*by, "_shard"], "left")
    return joined.withColumns({k: F.coalesce(f"_in_{k}", f"_carry_{k}")["v"] for k in boxed}).drop(*(f"{a}{k}" for a in ("_in_", "_carry_") for k in boxed))


def with_previous(df: DataFrame, value: Column, name: str, by: Sequence[str] = ("log_id",), shard_us: int = SHARD_US) -> DataFrame:
    """``name``: ``value`` of the row before this one in the order (t_us, seq) of its key; null in the first row."""
    return with_last(df, {name: (value, None)}, by, shard_us)


def with_running_sum(df: DataFrame, value: Column, name: str, by: Sequence[str] = ("log_id",), shard_us: int = SHARD_US) -> DataFrame:
    """``name``: sum of ``value`` over the rows up to and including this one in the order (t_us, seq) of its key."""
    df = df if "_shard" in df.columns else with_shard(df, shard_us)
    w = Window.partitionBy(*by, "_shard").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_sum", F.sum(value).over(w))
    ends = df.groupBy(*by, "_shard").agg(F.sum(value).alias("_total"))
    sooner = Window.partitionBy(*by).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_shard", F.coalesce(F.sum("_total").over(sooner), F.lit(0)).alias("_carry"))
    joined = rows.join(carry, [*by, "_shard"], "left")
    return joined.withColumn(name, F.col("_sum") + F.col("_carry")).drop("_sum", "_carry")
