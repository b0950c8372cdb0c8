"""Semi-structured log lines into fields, for files of many layouts.

Method: iterative partitioning.  Every line becomes a sequence of tokens whose
digits are masked; the distinct token sequences ("shapes", few against lines)
are partitioned by token count, then by the values at their least variable
positions, then by the bijection or one-to-many relation between the two
positions of the most common cardinality.  Leaf partitions are templates:
positions with one value are constants, the others are variable slots.  The
slots and constants of a template's header decide which of them hold time,
level and component; lines are then parsed through their template.  The
templates themselves (:func:`templates`) are mined over all tokens, by
relations between positions alone, until no leaf splits.

A file is cut into shards of ``shard_lines`` line numbers, so that a hot file
is spread over tasks; what an entry needs from later shards (where the next
entry begins) comes from one summary row a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import broadcast_if_few, shared_checkpoint

# Written severities and the nearest of the six.
SEVERITIES: dict[str, str] = {
    "trace": "TRACE", "finest": "TRACE", "finer": "TRACE", "t": "TRACE", "v": "TRACE", "verbose": "TRACE",
    "debug": "DEBUG", "fine": "DEBUG", "config": "DEBUG", "d": "DEBUG", "dbg": "DEBUG",
    "info": "INFO", "notice": "INFO", "information": "INFO", "i": "INFO", "n": "INFO", "develop": "INFO",
    "warn": "WARN", "warning": "WARN", "w": "WARN",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR", "e": "ERROR",
    "fatal": "FATAL", "crit": "FATAL", "critical": "FATAL", "alert": "FATAL", "emerg": "FATAL", "panic": "FATAL",
    "f": "FATAL", "c": "FATAL",
}
# Names under which key=value and JSON layouts carry the fields.
TIME_KEYS = {"ts", "time", "timestamp", "datetime", "date", "at", "asctime"}
LEVEL_KEYS = {"level", "severity", "lvl", "loglevel", "levelname"}
COMPONENT_KEYS = {"component", "logger", "tag", "module", "program", "name", "logger_name", "category", "source", "file"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

#: Tokens: words that may hold . , : + / - inside, or a single other character.  Possessive, so that the engine loops instead of recursing.
TOKEN = r"[\p{L}\p{N}_$]++(?:[.,:+/-]++[\p{L}\p{N}_$]++)*+|[^\s]"


@dataclass(frozen=True)
class LogSpec:
    path: str = "log_path"
    line_no: str = "line_no"
    line_id: str = "line_id"
    line: str = "line"
    started: str = "started_at"
    shard_lines: int = 4096
    #: A position with more values than this splits no partition (it is a variable slot).
    max_split: int = 48
    #: Tokens behind a placed time among which its level stands; a level word further on belongs to the message.
    level_within: int = 12


def _clean(line: Column) -> Column:
    """Without byte order mark, terminal colours and the line end."""
    bare = F.when(F.contains(line, F.lit("\u001b")), F.regexp_replace(line, "\\x1B\\[[0-9;]*m", "")).otherwise(line)
    return F.ltrim(F.rtrim(bare, F.lit("\r\n")), F.lit("\ufeff"))


def _lines(df: DataFrame, spec: LogSpec) -> DataFrame:
    """(path, no, id, text).  Rows without path, number or text belong to no file and are left out."""
    return df.filter(F.col(spec.path).isNotNull() & F.col(spec.line_no).isNotNull() & F.col(spec.line).isNotNull()).select(
        F.col(spec.path).alias("path"),
        F.col(spec.line_no).alias("no"),
        F.col(spec.line_id).alias("id"),
        _clean(F.col(spec.line)).alias("text"),
    )


def _masked(text: Column) -> Column:
    """The text with each run of digits as 0, which moves no token."""
    return F.regexp_replace(text, "[0-9]+", "0")


def _forms(masked: DataFrame) -> DataFrame:
    """(form_id, shape_id, shape, lines) of every distinct masked text that holds a token.

    Texts that differ in white space only have one shape.  Forms and shapes are
    known by 64-bit hashes; two of a million share one with a probability below 1e-7.
    """
    forms = masked.groupBy("masked").agg(F.count(F.lit(1)).alias("lines"))
    # U+0001 joins tokens below, so it cannot be one
    toks = F.transform(F.regexp_extract_all("masked", F.lit(TOKEN), F.lit(0)), lambda x: F.translate(x, "\u0001", "\ufffd"))
    forms = forms.select(F.xxhash64("masked").alias("form_id"), toks.alias("shape"), "lines").filter(F.size("shape") > 0)
    return forms.select("form_id", F.xxhash64(F.array_join("shape", "\u0001")).alias("shape_id"), "shape", "lines")


def _shapes(forms: DataFrame) -> DataFrame:
    """(shape_id, shape, n, lines, leaf): every distinct shape, in one partition with those of its token count."""
    shapes = forms.groupBy("shape_id", "shape").agg(F.sum("lines").alias("lines"))
    return shapes.select("shape_id", "shape", F.size("shape").alias("n"), "lines", F.size("shape").cast("string").alias("leaf"))


def _with_split(leaves: DataFrame, spec: LogSpec) -> DataFrame:
    """``leaves`` with ``pos``: where each leaf splits, null if it does not; positions with more than ``max_split`` values split nothing.

    Two positions are one-to-one where they group the shapes alike, so a hash of
    the grouping finds them without comparing pairs; the largest such set of a
    leaf is taken.  Without one, of two positions of which one decides the other
    (one-to-many) the decided one is taken, with the fewest values.
    """
    cells = leaves.select("leaf", "shape_id", F.posexplode("shape").alias("pos", "tok"))
    groups = cells.groupBy("leaf", "pos", "tok").agg(F.bit_xor("shape_id").alias("members"))
    slots = groups.groupBy("leaf", "pos").agg(F.count(F.lit(1)).alias("values"), F.bit_xor(F.xxhash64("members")).alias("grouping"))
    slots = slots.filter((F.col("values") > 1) & (F.col("values") <= spec.max_split))
    alike = slots.groupBy("leaf", "values", "grouping").agg(F.count(F.lit(1)).alias("k"), F.min("pos").alias("pos"))
    per = alike.groupBy("leaf").agg(
        F.min(F.when(F.col("k") > 1, F.struct((-F.col("k")).alias("k"), "values", "pos"))).alias("one"),
        F.array_sort(F.collect_list(F.struct("values", "pos"))).alias("open"),
    )
    got = leaves.join(per, "leaf", "left")
    # a row of a leaf holds no more pairs than its line has pairs of tokens
    at = lambda x: F.get("shape", x["pos"])
    pair = lambda a, b: F.struct(a["pos"].alias("pos"), a["values"].alias("values"), b["pos"].alias("by"), b["values"].alias("by_values"), at(a).alias("tok"), at(b).alias("by_tok"))
    pairs = F.flatten(F.transform("open", lambda a: F.transform(F.filter("open", lambda b: b["values"] > a["values"]), lambda b: pair(a, b))))
    pairs = got.filter("one IS NULL AND size(open) > 1").select("leaf", F.explode(pairs).alias("x")).select("leaf", "x.*").distinct()
    decided = pairs.groupBy("leaf", "pos", "values", "by", "by_values").agg(F.count(F.lit(1)).alias("pairs")).filter("pairs = by_values")
    many = decided.groupBy("leaf").agg(F.min(F.struct("values", "pos")).alias("many"))
    got = got.join(many, "leaf", "left")
    return got.withColumn("pos", F.coalesce("one.pos", "many.pos")).drop("one", "many", "open")


def _split_by_relations(leaves: DataFrame, spec: LogSpec) -> DataFrame:
    """Partition again and again, until no leaf holds two positions that depend on each other.

    Positions that vary independently of all others (levels, components, values)
    stay variable slots, as does the only open position of a leaf.
    """
    done = None
    while True:
        leaves = shared_checkpoint(_with_split(leaves, spec))
        stay = leaves.filter("pos IS NULL").drop("pos")
        done = stay if done is None else done.unionByName(stay)
        leaves = leaves.filter("pos IS NOT NULL")
        if leaves.isEmpty():
            return done
        step = F.concat_ws("\u0001", "leaf", F.col("pos").cast("string"), F.get("shape", F.col("pos")))
        leaves = leaves.withColumn("leaf", step).drop("pos")


_KINDS = ("level", "month", "letter_date", "word", "stamp", "date", "clock", "uptime", "num", "plain")
_ROLE_FIELDS = "leaf string, template string, lines bigint, kind string, ts_pos int, level_pos int, comp_pos int"


class _Slots:
    """One template: constant token or None for each position, and what all its values have in common."""

    def __init__(self, cells: list[dict]):
        self.size = max(c["pos"] for c in cells) + 1
        self.const: list[str | None] = [None] * self.size
        self.all = {k: [False] * self.size for k in _KINDS}
        for c in cells:
            if c["one"]:
                self.const[c["pos"]] = c["tok"]
            for k in _KINDS:
                self.all[k][c["pos"]] = c[k]

    def has(self, kind: str, p: int) -> bool:
        return 0 <= p < self.size and self.all[kind][p]

    def at(self, p: int) -> str | None:
        return self.const[p] if 0 <= p < self.size else None


class _Unclear(Exception):
    """A position that decides the structure of a keyed layout is a variable slot."""


def _skip(s: _Slots, p: int, until: tuple[str, ...]) -> int:
    """First position from p that holds one of ``until``; those between must hold none of the structure's characters in any line."""
    while p < s.size:
        tok = s.at(p)
        if tok in until:
            return p
        if tok is None and not s.has("plain", p):
            raise _Unclear
        p += 2 if tok == "\\" else 1
    return p


def _value_end(s: _Slots, p: int) -> int:
    """Position behind the value that begins at p: a quoted text, an object or array, or bare tokens."""
    if s.at(p) == '"':
        return _skip(s, p + 1, ('"',)) + 1
    depth = 0
    while p < s.size:
        tok = s.at(p)
        if tok is None and not s.has("plain", p):
            raise _Unclear
        if tok == '"':
            p = _skip(s, p + 1, ('"',))
        elif tok in ("{", "["):
            depth += 1
        elif tok in ("}", "]", ","):
            if depth == 0:
                return p
            depth -= tok != ","
        p += 1
    return p


def _named_values(s: _Slots) -> Iterator[tuple[str, int]]:
    """(key, first position of its value) of {"key": value, ...} or key=value ..., wherever they stand."""
    if s.at(0) == "{":
        p = 1
        while p < s.size and s.at(p) == '"':
            close = _skip(s, p + 1, ('"',))
            if s.at(close + 1) != ":":
                raise _Unclear
            key, q = s.at(close - 1), close + 2
            if key is not None:
                yield key.lower(), q + (s.at(q) == '"')
            p = _value_end(s, q) + 1
    elif s.at(1) == "=":
        p = 0
        while p < s.size:
            key = s.at(p)
            if key is not None and key[:1].isalpha() and s.at(p + 1) == "=":
                quoted = s.at(p + 2) == '"'
                yield key.lower(), p + 2 + quoted
                p = _skip(s, p + 3, ('"',)) + 1 if quoted else p + 3
            elif key is None and not s.has("plain", p):
                raise _Unclear
            else:
                p = _skip(s, p + 1, ('"',)) + 1 if key == '"' else p + 1


def _keyed(s: _Slots) -> tuple[str, int, int, int] | None:
    """Layouts of named fields; None where there is no time or where it is not the same place in all lines."""
    kind, ts, level, comp = "", -1, -1, -1
    try:
        for key, q in _named_values(s):
            if key in TIME_KEYS and ts < 0:
                ts = q
                kind = "stamp" if s.has("stamp", q) else "date_clock" if s.has("date", q) and s.has("clock", q + 1) else "epoch" if s.has("num", q) else ""
            elif key in LEVEL_KEYS and level < 0:
                level = q
            elif key in COMPONENT_KEYS and comp < 0:
                comp = q
    except _Unclear:
        return None
    return (kind, ts, level, comp) if kind else None


def _placed(s: _Slots, within: int) -> tuple[str, int, int, int] | None:
    """Layouts of placed fields: the time comes first, perhaps in a bracket."""
    p = 1 if s.at(0) in ("[", "(", "<") else 0
    if s.has("letter_date", p) and s.has("clock", p + 1):
        kind, end = "letter_date", p + 2
    elif s.has("stamp", p):
        kind, end = "stamp", p + 1
    elif s.has("date", p) and s.has("clock", p + 1):
        kind, end = "date_clock", p + 2
    elif s.has("month", p) and s.has("num", p + 1) and s.has("clock", p + 2):
        kind, end = "month_day", p + 3
    elif s.has("uptime", p) and (p or s.at(1) in (":", "[", "|", "-")):
        kind, end = "uptime", p + 1
    elif p == 0 and s.has("num", 0) and s.at(1) == ":" and s.at(2) == "[":
        return "uptime", 0, -1, -1
    else:
        return None
    if kind == "letter_date":
        close = next((i for i in range(end, s.size) if s.at(i) == "]"), -1)
        return kind, p, p, (close - 1 if close > end else -1)
    level = next((i for i in range(end, min(s.size, end + within)) if s.has("level", i)), -1)
    if level < 0:
        return kind, p, -1, -1
    comp = -1
    if s.at(level - 1) == "[" and s.at(level + 1) == "]":
        comp = level + 3 if s.at(level + 2) == "[" else -1
    elif s.at(level - 1) == "<":
        colon = next((i for i in range(level - 1, end, -1) if s.at(i) == ":"), level)
        opening = next((i for i in range(colon, end, -1) if s.at(i) == "["), -1)
        comp = (opening if opening > end else colon) - 1
    elif s.at(level + 1) == "[":
        close = next((i for i in range(level + 2, s.size) if s.at(i) == "]"), -1)
        comp = close + 1 if close > 0 and s.at(close + 1) not in (":", "-") else level + 2
    elif s.at(level - 1) == "]":
        comp = level - 2
    elif s.has("word", level + 1):
        comp = level + 1
    return kind, p, level, comp


def _roles(within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaf, lines, cells in zip(*(batch.column(c).to_pylist() for c in ("leaf", "lines", "cells")), strict=True):
                s = _Slots(cells)
                text = " ".join("<*>" if c is None else c for c in s.const)
                out.append((leaf, text, lines, *(_keyed(s) or _placed(s, within) or ("", -1, -1, -1))))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            names = [f.split()[0] for f in _ROLE_FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _facts(tok: Column) -> dict[str, Column]:
    """What a masked token may be."""
    return {
        "level": F.lower(tok).isin([k for k in SEVERITIES if len(k) > 1]),
        "month": tok.isin(list(MONTHS)),
        "letter_date": tok.rlike("^[TDIWEFNCV]0$"),
        "word": tok.rlike("^[\\p{L}_]"),
        "stamp": tok.rlike("^0-0-0T0:0(:0)?([.,]0)?(Z|[+-]0(:0)?)?$"),
        "date": tok.rlike("^0[-/.]0[-/.]0$"),
        "clock": tok.rlike("^0:0:0([.,]0)?(Z|[+-]0(:0)?)?$"),
        "uptime": tok.rlike("^0([.,]0)?(s|ms)$"),
        "num": tok.rlike("^0(\\.0)?$"),
        "plain": ~tok.isin('"', "\\", "{", "}", "[", "]", ",", "="),
    }


def template_roles(mined: DataFrame, spec: LogSpec = LogSpec()) -> DataFrame:
    """One row per leaf: its template and the slots of time, level and component (-1: none).

    What is handed to Python is a cell for each position of a leaf, whatever the leaf's size.
    """
    cells = mined.select("leaf", "lines", F.posexplode("shape").alias("pos", "tok")).groupBy("leaf", "pos", "tok").agg(F.sum("lines").alias("lines"))
    facts = _facts(F.col("tok"))
    stats = cells.groupBy("leaf", "pos").agg(
        F.min("tok").alias("tok"),
        (F.count(F.lit(1)) == 1).alias("one"),
        F.sum("lines").alias("lines"),
        *(F.min(facts[k]).alias(k) for k in _KINDS),
    )
    leaves = stats.groupBy("leaf").agg(F.max("lines").alias("lines"), F.collect_list(F.struct("pos", "tok", "one", *_KINDS)).alias("cells"))
    return leaves.mapInArrow(_roles(spec.level_within), _ROLE_FIELDS)


def _roles_alone(shapes: DataFrame, spec: LogSpec) -> DataFrame:
    """The roles of leaves of one shape each, without a shuffle."""
    cell = lambda tok, i: F.struct(i.alias("pos"), tok.alias("tok"), F.lit(True).alias("one"), *(c.alias(k) for k, c in _facts(tok).items()))
    return shapes.select("leaf", "lines", F.transform("shape", cell).alias("cells")).mapInArrow(_roles(spec.level_within), _ROLE_FIELDS)


def resolved_templates(shapes: DataFrame, spec: LogSpec = LogSpec()) -> tuple[DataFrame, DataFrame]:
    """(shapes of the leaves with a time, roles of all leaves), ``shapes`` as from :func:`_shapes`.

    A leaf in which no time is found may still hold several layouts: each of its
    shapes that carries a time by itself (the finest partition there is) becomes
    a leaf.  What is left begins no entry.
    """
    mined = _split_by_relations(shapes, spec)
    roles = shared_checkpoint(template_roles(mined, spec))
    unclear = mined.join(roles.filter("kind = ''").select("leaf"), "leaf", "left_semi")
    alone = unclear.withColumn("leaf", F.concat_ws("\u0001", "leaf", F.col("shape_id").cast("string")))
    roles_alone = shared_checkpoint(_roles_alone(alone, spec).filter("kind <> ''"))
    own = alone.join(roles_alone.select("leaf"), "leaf", "left_semi")
    timed = mined.join(roles.filter("kind <> ''").select("leaf"), "leaf", "left_semi").unionByName(own)
    if not roles_alone.isEmpty():  # the others of their leaves are described without them
        rest = unclear.join(own.select("shape_id"), "shape_id", "left_anti")
        roles = roles.filter("kind <> ''").unionByName(template_roles(rest, spec))
    return timed, roles.unionByName(roles_alone)


def _slots_of_forms(masked: DataFrame, spec: LogSpec) -> DataFrame:
    """(form_id, kind, ts_pos, level_pos, comp_pos) of the forms that begin an entry."""
    forms = shared_checkpoint(_forms(masked))
    leaves, roles = resolved_templates(_shapes(forms), spec)
    by_shape = leaves.select("shape_id", "leaf").join(roles.filter("kind <> ''").drop("lines", "template"), "leaf").drop("leaf")
    return broadcast_if_few(forms.select("form_id", "shape_id").join(by_shape, "shape_id").drop("shape_id"))


def _time_ms(kind: Column, a: Column, b: Column, c: Column, started: Column) -> Column:
    """UTC epoch milliseconds of the time tokens, cut to milliseconds; null where they are no time."""
    zone = lambda x: F.regexp_replace(F.regexp_replace(x, ",", "."), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    stamp = lambda x: F.unix_millis(F.try_to_timestamp(x))
    year = F.year(started).cast("string")
    day = F.concat_ws("-", year, F.substring(a, 2, 2), F.substring(a, 4, 2))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), a).cast("string")
    month_day = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(b, 2, "0"))
    seconds = F.regexp_replace(F.regexp_extract(a, "^([0-9]+[.,]?[0-9]*)", 1), ",", ".").try_cast("decimal(20,6)")
    uptime = F.floor(F.when(a.endswith("ms"), seconds).otherwise(seconds * 1000))
    number = a.try_cast("decimal(30,6)")
    epoch = F.floor(
        F.when(F.length(F.regexp_extract(a, "^[0-9]+", 0)) >= 18, number / 1000000)
        .when(F.length(F.regexp_extract(a, "^[0-9]+", 0)) >= 15, number / 1000)
        .when(F.length(F.regexp_extract(a, "^[0-9]+", 0)) >= 12, number)
        .otherwise(number * 1000)
    )
    return (
        F.when(kind == "stamp", stamp(zone(a)))
        .when(kind == "date_clock", stamp(zone(F.concat_ws(" ", F.regexp_replace(a, "[/.]", "-"), b))))
        .when(kind == "letter_date", stamp(F.concat_ws(" ", day, b)))
        .when(kind == "month_day", stamp(F.concat_ws(" ", month_day, c)))
        .when(kind == "uptime", F.unix_millis(started) + uptime.try_cast("bigint"))
        .when(kind == "epoch", epoch.try_cast("bigint"))
    )


def parsed_lines(df: DataFrame, meta: DataFrame, spec: LogSpec = LogSpec(), text: bool = False) -> DataFrame:
    """Every line once (path, shard, no, begins, ts_ms, severity, component), with its ``text`` if wanted.

    ``begins``: an entry begins here.  Lines are read twice, for their forms and
    for their fields, and never written; tokens are taken of lines that begin an
    entry only.  A line delivered again counts once, the first id is kept.
    """
    lines = _lines(df, spec)
    slots = _slots_of_forms(lines.select(_masked(F.col("text")).alias("masked")), spec)
    started = meta.filter(F.col(spec.path).isNotNull()).groupBy(F.col(spec.path).alias("path")).agg(F.min(spec.started).alias("started"))
    got = lines.withColumn("form_id", F.xxhash64(_masked(F.col("text")))).join(slots, "form_id", "left").join(started, "path", "left")
    got = got.withColumn("toks", F.when(F.col("kind").isNotNull(), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))))
    tok = lambda p: F.get("toks", p)
    ts = F.col("ts_pos")
    level = F.when(F.col("kind") == "letter_date", F.lower(F.substring(tok(ts), 1, 1))).otherwise(F.lower(tok(F.col("level_pos"))))
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), level)
    component = F.regexp_replace(tok(F.col("comp_pos")), ":[0-9]+$", "")
    begins = F.col("kind").isNotNull() & (F.col("ts_ms").isNotNull() | F.col("kind").isin("letter_date", "month_day", "uptime"))
    got = got.select(
        "path",
        F.floor(F.col("no") / F.lit(spec.shard_lines)).cast("int").alias("shard"),
        "no",
        "id",
        *(["text"] if text else []),
        "kind",
        _time_ms(F.col("kind"), tok(ts), tok(ts + 1), tok(ts + 2), F.col("started")).alias("ts_ms"),
        F.when(F.col("level_pos") < 0, "-").otherwise(F.coalesce(severity, F.lit("-"))).alias("severity"),
        F.when(F.col("comp_pos") < 0, "-").otherwise(F.coalesce(F.nullif(component, F.lit("")), F.lit("-"))).alias("component"),
    )
    got = got.withColumn("begins", begins).drop("kind")
    # every column is a key, so that all uses of the rows share one shuffle, whatever they need of them later
    got = got.filter(F.col("shard").isNotNull()).repartition("path", "shard").dropDuplicates()
    w = Window.partitionBy("path", "shard").orderBy("no", "id", F.desc("begins"), "ts_ms")
    got = got.withColumn("before", F.lag("no").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("no")))
    return got.drop("before", "id")


def _heads_and_lines(got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads with ``last_line``, lines with ``entry``, the first line of the entry they belong to).

    Windows look backwards only, or at heads only: frames that end far ahead cost
    the square of their length.
    """
    w = Window.partitionBy("path", "shard").orderBy("no")
    inside = got.withColumns(
        {
            "prev_no": F.lag("no").over(w),
            "entry": F.last(F.when(F.col("begins"), F.col("no")), ignorenulls=True).over(w),
        }
    )
    summary = inside.groupBy("path", "shard").agg(
        F.min_by(F.struct("prev_no"), F.when(F.col("begins"), F.col("no"))).alias("head"),
        F.max("entry").alias("open"),
        F.max("no").alias("last_no"),
    )
    onward, backward = Window.partitionBy("path").orderBy("shard"), Window.partitionBy("path").orderBy(F.desc("shard"))
    sooner, later = onward.rowsBetween(Window.unboundedPreceding, -1), backward.rowsBetween(Window.unboundedPreceding, -1)
    last_before = F.lag("last_no").over(onward)
    summary = summary.withColumn("head_prev", F.when(F.col("head").isNotNull(), F.coalesce(F.col("head.prev_no"), last_before)))
    summary = summary.select(
        "path",
        "shard",
        F.last("open", ignorenulls=True).over(sooner).alias("carried"),
        F.last("head_prev", ignorenulls=True).over(later).alias("end_before_next"),
        F.max("last_no").over(Window.partitionBy("path")).alias("file_last"),
    )
    heads = inside.filter("begins").withColumn("end_here", F.lead("prev_no").over(w)).join(summary, ["path", "shard"])
    heads = heads.withColumn("last_line", F.coalesce("end_here", "end_before_next", "file_last"))
    lines = inside.join(summary.select("path", "shard", "carried"), ["path", "shard"]).withColumn("entry", F.coalesce("entry", "carried"))
    return heads, lines


def entry_heads(df: DataFrame, meta: DataFrame, spec: LogSpec = LogSpec()) -> DataFrame:
    """(log_path, first_line, last_line, ts_ms, severity, component), one row per log entry.

    Lines before a file's first entry belong to none.  Null paths, numbers or
    lines are left out; a blank line goes on with the entry it is in; a file
    without row in ``meta`` gives null times where the layout needs its start;
    an empty table gives an empty result.
    """
    heads, _ = _heads_and_lines(parsed_lines(df, meta, spec))
    return heads.select(
        F.col("path").alias(spec.path), F.col("no").alias("first_line"), F.col("last_line"), "ts_ms", "severity", "component"
    )


def entries(df: DataFrame, meta: DataFrame, spec: LogSpec = LogSpec()) -> DataFrame:
    """As :func:`entry_heads`, with the whole ``message``: all lines of the entry as they were, joined by line feeds."""
    heads, lines = _heads_and_lines(parsed_lines(df, meta, spec, text=True))
    grouped = lines.filter(F.col("entry").isNotNull()).groupBy("path", "entry").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("all_lines"))
    grouped = grouped.join(heads.select("path", F.col("no").alias("entry"), "last_line", "ts_ms", "severity", "component"), ["path", "entry"])
    return grouped.select(
        F.col("path").alias(spec.path),
        F.col("entry").alias("first_line"),
        "last_line",
        "ts_ms",
        "severity",
        "component",
        F.array_join(F.transform("all_lines", lambda x: x["text"]), "\n").alias("message"),
    )


def templates(df: DataFrame, spec: LogSpec = LogSpec()) -> DataFrame:
    """(template, tokens, lines, kind): the leaf templates from which entries are parsed, and the kind of time they carry."""
    once = _lines(df, spec).select("path", "no", F.struct("id", _masked(F.col("text")).alias("masked")).alias("line"))
    masked = once.groupBy("path", "no").agg(F.min("line").alias("line")).select("line.masked")
    _, roles = resolved_templates(_shapes(_forms(masked)), spec)
    return roles.select("template", F.split("leaf", "\u0001").getItem(0).cast("int").alias("tokens"), "lines", "kind")
