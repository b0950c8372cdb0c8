"""Percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded into 32 order-preserving bits that cover all doubles, negative
and infinite ones included (relative error below 3e-8 for sizes from 2**-33 to
2**32, below 1e-6 beyond).  For each binary resolution of the code (level j:
``code >> j``) there is one signed sketch of ``depth`` rows by ``width`` counters;
the first level of at most ``exact_nodes`` nodes holds exact counters, and the
coarser ones are sums of them, made when a sketch is read.  That is about a
hundred thousand counters for a universe of four billion codes.

Sketches are linear: they merge by addition (of partitions, logs or days) and take
deletions as negative weights.  A sketch of at most ``few`` codes is kept as these
codes, of which its counters are a function: many small groups then cost what
their values cost, and their percentiles are exact up to the code.

A percentile is found by descending the levels: at each node the counts of both
children are estimated (median over the rows, then fitted to the parent's
count), and the side that holds the wanted rank is entered.  The rank is off by
at most about ``rank_error`` (a share of n), computed from the sketch itself as
three standard errors of its estimates.

Values go from their scan straight into the sketch of their task; what is
shuffled is one packed sketch for each group and task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- codes -------------------------------------------------------------------------------------------------------

#: Exponents (of frexp) whose values get the finer codes, and the bits of mantissa inside and outside of them.
_FINE, _FINE_BITS, _COARSE_BITS = (-32, 32), 24, 19
_EXPONENTS = np.arange(-1073, 1025)
_BITS = np.where((_EXPONENTS >= _FINE[0]) & (_EXPONENTS < _FINE[1]), _FINE_BITS, _COARSE_BITS)
_OFFSET = np.concatenate([[0], np.cumsum(np.int64(1) << _BITS)])
_ZERO, _TOP = 1 << 31, (1 << 32) - 1


def encode(v: np.ndarray) -> np.ndarray:
    """Codes of doubles without NaN: order-preserving, zero in the middle, the infinities at both ends."""
    size = np.abs(v)
    finite = np.isfinite(size)
    m, e = np.frexp(np.where(finite, size, 1.0))
    at = np.clip(e - _EXPONENTS[0], 0, len(_EXPONENTS) - 1)
    bits = _BITS[at]
    place = _OFFSET[at] + np.floor((m * 2 - 1) * (np.int64(1) << bits)).astype(np.int64)
    code = np.where(v > 0, _ZERO + 1 + place, _ZERO - 1 - place)
    code = np.where(size == 0, _ZERO, code)
    return np.where(finite, code, np.where(v > 0, _TOP, 0)).astype(np.int64)


def decode(code: int) -> float:
    """Middle of the values of a code."""
    if code in (_ZERO, _TOP, 0):
        return {_ZERO: 0.0, _TOP: math.inf, 0: -math.inf}[code]
    place = code - _ZERO - 1 if code > _ZERO else _ZERO - 1 - code
    at = int(np.searchsorted(_OFFSET, place, "right")) - 1
    m = (place - int(_OFFSET[at]) + 0.5) / (1 << int(_BITS[at]))
    return math.copysign(math.ldexp((1 + m) / 2, int(_EXPONENTS[at])), code - _ZERO)


def code_error(code: int) -> float:
    """Relative error of the decoded value; none for zero and the infinities, 1 below the smallest normal doubles."""
    if code in (_ZERO, _TOP, 0):
        return 0.0
    at = int(np.searchsorted(_OFFSET, code - _ZERO - 1 if code > _ZERO else _ZERO - 1 - code, "right")) - 1
    return 2.0 ** -(int(_BITS[at]) + 1) if _EXPONENTS[at] > -1021 else 1.0


# ---- sketches ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SketchSpec:
    width: int = 1024
    depth: int = 5
    exact_nodes: int = 4096
    #: A sketch of at most this many codes is kept as its codes.
    few: int = 4096
    #: Counters that a task holds at once, in bytes; what is beyond goes on as partial sketches.
    task_bytes: int = 128 << 20

    @property
    def exact(self) -> int:
        """The level whose counters are kept exactly."""
        return 32 - (self.exact_nodes.bit_length() - 1)

    @property
    def counters(self) -> int:
        return self.exact * self.depth * self.width + self.exact_nodes


def _places(node: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each node in one row of a level."""
    with np.errstate(over="ignore"):
        x = node.astype(np.uint64) ^ np.uint64((level * 64 + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return (x % np.uint64(width)).astype(np.int64), 1 - 2 * (x >> np.uint64(63)).astype(np.int64)


class Sketch:
    """Codes with their weights while they are few, counters when they are not."""

    def __init__(self, spec: SketchSpec):
        self.spec = spec
        self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.table: np.ndarray | None = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((codes, weights))
        self.waiting += len(codes)
        if self.waiting > 4 * self.spec.few:
            self.settle()

    def settle(self) -> None:
        """Waiting codes added up, and turned into counters where they are too many."""
        if self.held:
            codes = np.concatenate([self.codes, *(c for c, _ in self.held)])
            weights = np.concatenate([self.weights, *(w for _, w in self.held)])
            self.codes, at = np.unique(codes, return_inverse=True)
            self.weights = np.zeros(len(self.codes), np.int64)
            np.add.at(self.weights, at, weights)
            some = self.weights != 0
            self.codes, self.weights, self.held, self.waiting = self.codes[some], self.weights[some], [], 0
        if len(self.codes) and (self.table is not None or len(self.codes) > self.spec.few):
            self._count()

    def _count(self) -> None:
        s = self.spec
        if self.table is None:
            self.table = np.zeros(s.counters, np.int64)
        for level in range(s.exact):
            node = self.codes >> level
            for row in range(s.depth):
                place, sign = _places(node, level, row, s.width)
                np.add.at(self.table, place + (level * s.depth + row) * s.width, sign * self.weights)
        np.add.at(self.table, (self.codes >> s.exact) + s.exact * s.depth * s.width, self.weights)
        self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def dense(self) -> np.ndarray:
        """The counters, whatever the form."""
        self.settle()
        if self.table is None or len(self.codes):
            self._count()
        return self.table

    def merge(self, other: Sketch) -> None:
        """Add another one; codes wait, as in :meth:`add`, until there are enough of them to be worth adding up."""
        other.settle()
        if other.table is not None:
            if self.table is None:
                self.table = np.zeros(self.spec.counters, np.int64)
            self.table += other.table
        if len(other.codes):
            self.add(other.codes, other.weights)

    def pack(self) -> bytes:
        """Sorted codes and their weights, or counters in the least width that holds them, compressed."""
        self.settle()
        if self.table is None:
            return b"c" + zlib.compress(np.concatenate([np.diff(self.codes, prepend=0), self.weights]).tobytes(), 1)
        most = int(np.abs(self.table).max(initial=0))
        kind = next(k for k in ("i1", "i2", "i4", "i8") if most <= np.iinfo(k).max)
        return kind[1].encode() + zlib.compress(self.table.astype(kind).tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes, spec: SketchSpec) -> Sketch:
        out, raw = cls(spec), zlib.decompress(data[1:])
        if data[:1] == b"c":
            both = np.frombuffer(raw, np.int64)
            half = len(both) // 2
            out.codes, out.weights = np.cumsum(both[:half]), both[half:].copy()
        else:
            out.table = np.frombuffer(raw, "i" + data[:1].decode()).astype(np.int64)
        return out

    # ---- reading

    def inverter(self) -> _Inverter:
        return _Inverter(self)


class _Inverter:
    def __init__(self, sketch: Sketch):
        sketch.settle()
        self.spec = s = sketch.spec
        self.sketch = sketch
        if sketch.table is None:
            self.sums = np.cumsum(sketch.weights)
            self.n = int(self.sums[-1]) if len(self.sums) else 0
            return
        self.signed = sketch.table[: s.exact * s.depth * s.width].reshape(s.exact, s.depth, s.width)
        self.sure = [sketch.table[s.exact * s.depth * s.width :]]
        while len(self.sure[-1]) > 1:
            self.sure.append(self.sure[-1].reshape(-1, 2).sum(axis=1))
        self.n = int(self.sure[-1][0])

    def count(self, level: int, node: int) -> float:
        if level >= self.spec.exact:
            return float(self.sure[level - self.spec.exact][node])
        got, one = [], np.array([node], np.int64)
        for row in range(self.spec.depth):
            place, sign = _places(one, level, row, self.spec.width)
            got.append(int(sign[0]) * int(self.signed[level, row, place[0]]))
        return float(np.median(got))

    def rank_error(self) -> float:
        """Three standard errors of the summed estimates of the sketched levels, as a share of n; the median of the rows costs a factor of pi / 2."""
        if self.sketch.table is None:
            return 0.0
        squares = np.median((self.signed.astype(float) ** 2).sum(axis=2), axis=1)
        return 3 * math.sqrt(float(squares.sum()) / self.spec.width / self.spec.depth * (math.pi / 2)) / max(self.n, 1)

    def quantile(self, q: float) -> int | None:
        """Code of the value."""
        if self.n <= 0:
            return None
        rank, node, here = min(max(math.ceil(q * self.n), 1), self.n), 0, float(self.n)
        if self.sketch.table is None:
            return int(self.sketch.codes[np.searchsorted(self.sums, rank)])
        for level in range(31, -1, -1):
            left, right = self.count(level, 2 * node), self.count(level, 2 * node + 1)
            left = min(max(left + (here - left - right) / 2, 0.0), here)
            if rank <= left or left >= here:
                node, here = 2 * node, left
            else:
                node, here, rank = 2 * node + 1, here - left, rank - left
        return node


# ---- on Spark ----------------------------------------------------------------------------------------------------


def _ddl(df: DataFrame, groups: Sequence[str]) -> list[str]:
    return [f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups]


def _batch(keys: list[tuple], more: list[list], schema: pa.Schema) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(schema) - len(more))]
    cols += [pa.array(m, schema.field(len(cols) + j).type) for j, m in enumerate(more)]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def build_sketch(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Sketch (groups..., sketch binary) of ``value`` per group, one row a group.

    Null and NaN values are left out; negative and infinite ones count;
    ``weight`` (default 1) may be negative.  Null groups are groups.  A hot group
    moves one packed sketch a task.  An empty table gives an empty sketch.
    """
    v = F.col(value).cast("double")
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(*groups, v.alias("_v"), w.alias("_w")).filter("_v IS NOT NULL AND NOT isnan(_v) AND _w <> 0")
    n, held = len(groups), max(spec.task_bytes // (spec.counters * 8), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, Sketch] = {}
        schema = None

        def emit() -> pa.RecordBatch:
            keys = list(open_)
            return _batch(keys, [[open_[k].pack() for k in keys]], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([*(batch.schema.field(i) for i in range(n)), pa.field("sketch", pa.binary())])
            if not batch.num_rows:
                continue
            codes = encode(batch.column(n).to_numpy(zero_copy_only=False))
            weights = batch.column(n + 1).to_numpy(zero_copy_only=False)
            one = np.zeros(batch.num_rows, np.int64)
            for i in range(n):
                at = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                _, one = np.unique(one * (int(at.max()) + 1) + at, return_inverse=True)
            order = np.argsort(one, kind="stable")
            cuts = np.flatnonzero(np.diff(one[order])) + 1
            for part in np.split(order, cuts):
                key = tuple(batch.column(i)[int(part[0])].as_py() for i in range(n))
                if key not in open_:
                    open_[key] = Sketch(spec)
                open_[key].add(codes[part], weights[part])
            size = sum(1.0 if x.table is not None else (x.waiting + len(x.codes)) * 2 / spec.counters for x in open_.values())
            if size > held:
                yield emit()
                open_.clear()
        if open_:
            yield emit()

    parts = rows.mapInArrow(run, ", ".join([*_ddl(df, groups), "sketch binary"]))
    return merge(parts, groups, spec)


def merge(sketches: DataFrame, groups: Sequence[str], spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Sum of sketches over all other columns: the sketch of all their values together.

    The sketches of a group are added one by one as they are read, so that a task
    holds one sum at a time, however many there are.
    """
    n = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, schema = None, None, None
        for batch in batches:
            schema = batch.schema
            done: list[tuple[tuple, bytes]] = []
            for i in range(batch.num_rows):
                k = tuple(batch.column(j)[i].as_py() for j in range(n))
                one = Sketch.unpack(batch.column(n)[i].as_py(), spec)
                if total is not None and k == key:
                    total.merge(one)
                    continue
                if total is not None:
                    done.append((key, total.pack()))
                key, total = k, one
            if done:
                yield _batch([k for k, _ in done], [[x for _, x in done]], schema)
        if total is not None:
            yield _batch([key], [[total.pack()]], schema)

    rows = sketches.select(*groups, "sketch")
    rows = rows.repartition(*groups).sortWithinPartitions(*groups) if groups else rows.coalesce(1)
    return rows.mapInArrow(run, ", ".join([*_ddl(sketches, groups), "sketch binary"]))


def quantiles(sketch: DataFrame, groups: Sequence[str], qs: Sequence[float], names: Sequence[str], spec: SketchSpec = SketchSpec()) -> DataFrame:
    """One row per group: groups, ``n_values``, one column per quantile, ``rank_error`` and ``value_error``; null quantiles where all values are deleted."""
    n = len(groups)
    ddl = ", ".join([*_ddl(sketch, groups), "n_values bigint", *(f"`{x}` double" for x in names), "rank_error double", "value_error double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [pa.field("n_values", pa.int64()), *(pa.field(x, pa.float64()) for x in (*names, "rank_error", "value_error"))]
            schema = pa.schema([*(batch.schema.field(i) for i in range(n)), *kinds])
            keys, out = [], []
            for i in range(batch.num_rows):
                inv = Sketch.unpack(batch.column(n)[i].as_py(), spec).inverter()
                codes = [inv.quantile(q) for q in qs]
                keys.append(tuple(batch.column(j)[i].as_py() for j in range(n)))
                got = [None if c is None else decode(c) for c in codes]
                out.append([inv.n, *got, inv.rank_error(), max((code_error(c) for c in codes if c is not None), default=0.0)])
            yield _batch(keys, [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in kinds], schema)

    return sketch.select(*groups, "sketch").mapInArrow(run, ddl)


def sub_phase_values(df: DataFrame) -> DataFrame:
    """(log_id, day, collection_type, sub_phase, sec): one row per usable sub-phase of a g1_event_rows table.

    Re-delivered rows, i.e. rows with the same (log_id, seq), count once; rows
    without one of the two count each.  Values that are null, NaN or negative
    are left out, as are sub-phases without a name and rows without a type.
    """
    from .runs import collection_kind

    usable = F.filter("sub_phase_seconds", lambda x: x["name"].isNotNull() & x["sec"].isNotNull() & ~F.isnan(x["sec"]) & (x["sec"] >= 0))
    rows = df.select("log_id", "seq", F.to_date("arrived_at").alias("day"), collection_kind().alias("collection_type"), usable.alias("s"))
    rows = rows.filter(F.col("collection_type").isNotNull() & (F.size("s") > 0))
    # rows without a full key get one of their own, so that all rows take one scan and one shuffle
    keyed = F.col("log_id").isNotNull() & F.col("seq").isNotNull()
    rows = rows.withColumn("own", F.when(~keyed, F.monotonically_increasing_id()))
    # copies are few: looking for them before the shuffle would only sort the rows once more
    once = rows.repartition("log_id", "seq", "own").dropDuplicates(["log_id", "seq", "own"])
    return once.select("log_id", "day", "collection_type", F.explode("s").alias("x")).select(
        "log_id", "day", "collection_type", F.col("x.name").alias("sub_phase"), F.col("x.sec").alias("sec")
    )
