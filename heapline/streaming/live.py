"""Structured Streaming twins of views: they take a streaming (or static) DataFrame of gc_events.

Re-delivered rows are removed within the watermark; per-log state is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..plans.base import category


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (log_id, seq) once, as long as its copies arrive within ``late``."""
    usable = events.filter("log_id IS NOT NULL AND seq IS NOT NULL AND t_us IS NOT NULL AND event_class IS NOT NULL")
    return usable.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["log_id", "seq"])


def pause_time(events: DataFrame) -> DataFrame:
    """Stateless: (log_id, seq, arrived_at, category, t_sec, pause_ms) of the pauses with a heap of pools."""
    p = events.filter(F.col("event_class").isin(list(S.GG)) & (F.col("duration_us") > 0))
    return p.select("log_id", "seq", "arrived_at", category().alias("category"), "t_sec", (F.col("duration_us") / F.lit(1e3)).alias("pause_ms"))


def pause_rate(events: DataFrame, width: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Sliding windows over arrival time: pauses and their total per log and window."""
    p = pause_time(events)
    return p.groupBy("log_id", F.window("arrived_at", width, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum("pause_ms").alias("stw_ms"))


_STATE = "last_us bigint"
_OUT = "log_id int, seq bigint, t_us bigint, pct double"


def percent_time_in_gc(events: DataFrame) -> DataFrame:
    """100 * pause / time since the pause before, per log, in order of arrival batches; late events are not compared with later ones."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values(["t_us", "seq"])
            before = f["t_us"].shift(1)
            if last is not None and len(before):
                before.iloc[0] = last
            gap = f["t_us"] - before
            good = gap > 0
            last = int(max(f["t_us"].max(), last if last is not None else f["t_us"].max()))
            yield pd.DataFrame({"log_id": f["log_id"], "seq": f["seq"], "t_us": f["t_us"], "pct": 100.0 * f["dur_us"].clip(lower=0) / gap})[good]
        if last is not None:
            state.update((last,))

    p = events.filter(F.col("event_class").isin(list(S.GG))).select("log_id", "seq", "t_us", F.col("duration_us").alias("dur_us"))
    return p.groupBy("log_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
