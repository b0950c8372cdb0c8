"""Schemas that drift between files: one catalogue, one report, one table.

Method: a column lifespan catalogue.  The footer of every file (its fields with
a non-null value and their types) is harvested by exploding the payloads as
VARIANT; ``lag`` and gaps-and-islands per (producer, field, type) over the
producer's file ordinal give lifespans; starts and endings of lifespans are
logged and classified; an alias table (name -> canonical column, unit) tells
renames from additions and generates the casts into the one consistent schema.

Rows are touched once, in the JVM; everything after the footer aggregation is
of the size of (files x fields), not of rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import shared_checkpoint

# Canonical column, its target type, and the names it is known by.  A name ending in a unit other
# than seconds has its factor to seconds in UNIT_SUFFIXES.
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "log_id": ("bigint", ("logId", "log_id")),
    "t_sec": ("double", ("tSec", "t_sec", "timeSec", "startSec")),
    "collection_type": ("string", ("collectionType", "collection_type", "gcKind")),
    "gc_cause": ("string", ("gcCause", "gc_cause", "cause")),
    "workers": ("int", ("workers", "workerCount", "n_workers")),
    "wall_sec": ("double", ("wallSec", "cpuWall", "wall_sec")),
    "to_space_exhausted": ("boolean", ("toSpaceExhausted", "to_space_exhausted", "exhausted")),
    "phase_seconds": ("map", ("phaseSeconds", "phase_seconds", "phaseSec", "phases", "phaseDurations", "phaseMillis")),
    "sub_phase_seconds": (
        "map",
        ("subPhaseSeconds", "sub_phase_seconds", "subPhaseSec", "subPhases", "evacSubPhaseSeconds", "subPhaseMillis"),
    ),
}
# Unit suffixes of names and their factor to seconds.
UNIT_SUFFIXES = {"millis": 1e-3, "ms": 1e-3, "micros": 1e-6, "us": 1e-6}


@dataclass(frozen=True)
class DriftSpec:
    producer: str = "feed_id"
    file: str = "file_id"
    written: str = "written_at"
    line: str = "line_no"
    payload: str = "payload"
    #: Canonical columns with their type (a map is of names to seconds) and the names they are known by.
    aliases: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=lambda: ALIASES)
    units: Mapping[str, float] = field(default_factory=lambda: UNIT_SUFFIXES)

    def factor(self, name: str) -> float:
        """What makes seconds of the values under this name."""
        words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)
        return self.units.get(words[-1].lower(), 1.0) if words else 1.0


def _parsed(df: DataFrame, spec: DriftSpec) -> DataFrame:
    """One row per line with the payload as VARIANT; null where it cannot be read or is no object."""
    v = F.try_parse_json(F.col(spec.payload))
    return df.select(
        F.col(spec.producer).alias("producer"),
        F.col(spec.file).alias("file"),
        F.col(spec.written).alias("written"),
        F.col(spec.line).alias("line"),
        F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("v"),
    )


def _kind(schema: Column) -> Column:
    """number, string, boolean, array, object<number> or object<string>; null for a JSON null."""
    number = schema.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    inner_text = schema.rlike(": STRING[,>]")
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(number, "number")
        .when(schema.startswith("OBJECT"), F.when(inner_text, "object<string>").otherwise("object<number>"))
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "BOOLEAN", "boolean")
        .otherwise("string")
    )


def footers(df: DataFrame, spec: DriftSpec = DriftSpec()) -> DataFrame:
    """(producer, file, written, ord, files, field, kind, n): every field of every file; ``field`` is null in a file without any."""
    rows = _parsed(df, spec)
    fields = (
        df.sparkSession.sql(
            "SELECT producer, file, written, e.key AS field, schema_of_variant(e.value) AS s FROM {rows}, LATERAL variant_explode_outer(v) AS e",
            rows=rows,
        )
        .select("producer", "file", "written", "field", _kind(F.col("s")).alias("kind"))
        .groupBy("producer", "file", "field", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.min("written").alias("written"))
    )
    by_file = Window.partitionBy("producer", "file")
    fields = fields.withColumn("written", F.min("written").over(by_file))
    # a field that carries two kinds in one file counts as the more frequent one
    one = (
        fields.withColumn("real", F.col("kind").isNotNull() & F.col("field").isNotNull())
        .groupBy("producer", "file", "written", F.when(F.col("real"), F.col("field")).alias("field"))
        .agg(F.max_by(F.col("kind"), F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"))
    )
    one = shared_checkpoint(one)
    # files are numbered apart from their fields: a busy producer's window holds a row a file
    by_producer = Window.partitionBy("producer")
    files = one.select("producer", "file", "written").distinct()
    files = files.withColumns({"ord": F.row_number().over(by_producer.orderBy("written", "file")), "files": F.count(F.lit(1)).over(by_producer)})
    numbered = files.select(F.col("producer").alias("p"), F.col("file").alias("f"), "ord", F.col("files").cast("int").alias("files"))
    same = F.col("producer").eqNullSafe(F.col("p")) & F.col("file").eqNullSafe(F.col("f"))
    return one.join(numbered, same).drop("p", "f")


def lifespans(foot: DataFrame) -> DataFrame:
    """(producer, field, kind, first_ord, last_ord, files): islands of consecutive files that carry the field in that kind."""
    w = Window.partitionBy("producer", "field", "kind").orderBy("ord")
    islands = (
        foot.filter(F.col("field").isNotNull())
        .withColumn("new", (F.col("ord") - F.coalesce(F.lag("ord").over(w), F.lit(-1)) != 1).cast("int"))
        .withColumn("island", F.sum("new").over(w))
    )
    return islands.groupBy("producer", "field", "kind", "island").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max("files").alias("files")
    ).drop("island")


def _family(name: Column, spec: DriftSpec) -> Column:
    """Canonical column of a name; an unknown name is its own family, whatever its case and punctuation."""
    pairs = [F.lit(x) for canonical, (_, names) in spec.aliases.items() for n in dict.fromkeys((*names, canonical)) for x in (n, canonical)]
    own = F.concat(F.lit("~"), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), own) if pairs else own


def changes(df: DataFrame, spec: DriftSpec = DriftSpec()) -> DataFrame:
    """(file, field_name, change_kind, new_name, old_kind, new_kind): every change of a file against the one before it.

    The first file of a producer has no changes; a file without any readable
    line has no fields.  Null producers or files form a producer of their own;
    re-delivered lines change nothing; an empty table gives an empty report.
    """
    foot = footers(df, spec)
    files = foot.select(F.col("producer").alias("at_producer"), F.col("ord").alias("at_ord"), F.col("file").alias("at_file")).distinct()
    spans = lifespans(foot)
    starts = spans.filter(F.col("first_ord") > 1).select(
        "producer", F.col("first_ord").alias("ord"), "field", F.lit("start").alias("what"), "kind"
    )
    ends = spans.filter(F.col("last_ord") < F.col("files")).select(
        "producer", (F.col("last_ord") + 1).alias("ord"), "field", F.lit("end").alias("what"), "kind"
    )
    per_field = (
        starts.unionByName(ends)
        .groupBy("producer", "ord", "field")
        .agg(
            F.max(F.when(F.col("what") == "start", F.col("kind"))).alias("new_kind"),
            F.max(F.when(F.col("what") == "end", F.col("kind"))).alias("old_kind"),
        )
        .withColumn("family", _family(F.col("field"), spec))
        .withColumn(
            "side",
            F.when(F.col("new_kind").isNotNull() & F.col("old_kind").isNotNull(), "both")
            .when(F.col("new_kind").isNotNull(), "start")
            .otherwise("end"),
        )
    )
    # the i-th ending of a family meets its i-th start: the content goes on under another name
    place = Window.partitionBy("producer", "ord", "family", "side").orderBy("field")
    paired = (
        per_field.withColumn("i", F.row_number().over(place))
        .groupBy("producer", "ord", "family", "i", F.when(F.col("side") == "both", F.col("field")).alias("same"))
        .agg(
            F.max(F.when(F.col("side") != "start", F.col("field"))).alias("old_name"),
            F.max(F.when(F.col("side") != "end", F.col("field"))).alias("new_name"),
            F.max("old_kind").alias("old_kind"),
            F.max("new_kind").alias("new_kind"),
        )
    )
    kind = (
        F.when(F.col("old_name") == F.col("new_name"), "retyped")
        .when(F.col("old_name").isNotNull() & F.col("new_name").isNotNull(), "renamed")
        .when(F.col("new_name").isNotNull(), "added")
        .otherwise("removed")
    )
    report = paired.select(
        "producer",
        "ord",
        F.coalesce("old_name", "new_name").alias("field_name"),
        kind.alias("change_kind"),
        "new_name",
        "old_kind",
        "new_kind",
    )
    same = (F.col("ord") == F.col("at_ord")) & F.col("producer").eqNullSafe(F.col("at_producer"))
    return report.join(files, same).select(
        "producer", F.col("at_file").alias("file"), "field_name", "change_kind", "new_name", "old_kind", "new_kind"
    )


def _as_map(v: Column, path: str, factor: float) -> Column:
    """An object, an array of {name, sec} or either of them written as a string, as map<string, double> in seconds."""

    def read(doc: Column, at: str) -> Column:
        obj = F.try_variant_get(doc, at, "map<string,double>")
        arr = F.try_variant_get(doc, at, "array<struct<name:string,sec:double>>")
        # the last of two entries of one name wins, entries without a name are left out
        named = F.filter(arr, lambda x: x["name"].isNotNull())
        latest = F.aggregate(
            named,
            F.create_map().cast("map<string,double>"),
            lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["name"]), F.create_map(x["name"], x["sec"])),
        )
        return F.coalesce(obj, latest)

    inner = F.try_parse_json(F.try_variant_get(v, path, "string"))
    plain = F.coalesce(read(v, path), read(inner, "$"))
    return plain if factor == 1.0 else F.transform_values(plain, lambda _, x: x * F.lit(factor))


def _other_fields(v: Column, spec: DriftSpec) -> Column:
    """The fields under names that the alias table does not know, with their values as JSON."""
    known = [n for _, names in spec.aliases.values() for n in names]
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(known))
    return F.transform_values(fields, lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))


def unify(df: DataFrame, spec: DriftSpec = DriftSpec()) -> DataFrame:
    """Every readable line in one schema, durations in seconds; a line delivered twice comes out once.

    Lines without producer, file or number are not known to be the same and each come out.

    Unreadable lines are left out; values that cannot be cast are null; when a
    line carries two names of one column, the first in alias order with a value
    is taken.  Fields of names outside the alias table are kept in ``other_fields``,
    a map from name to the value as JSON, empty where there are none.
    """
    rows = _parsed(df, spec).filter(F.col("v").isNotNull())
    v = F.col("v")
    out = []
    for canonical, (target, names) in spec.aliases.items():
        if target == "map":
            got = [_as_map(v, f"$.{n}", spec.factor(n)) for n in names]
        else:
            got = []
            for n in names:
                x = F.try_variant_get(v, f"$.{n}", target)
                got.append(x * F.lit(spec.factor(n)) if target == "double" and spec.factor(n) != 1.0 else x)
        out.append(F.coalesce(*got).alias(canonical))
    out.append(_other_fields(v, spec).alias("other_fields"))
    keyed = F.col("producer").isNotNull() & F.col("file").isNotNull() & F.col("line").isNotNull()
    rows = rows.withColumn("own", F.when(~keyed, F.monotonically_increasing_id()))
    once = rows.repartition("producer", "file", "line", "own").dropDuplicates(["producer", "file", "line", "own"])
    return once.select(
        F.col("producer").alias(spec.producer), F.col("file").alias(spec.file), F.col("line").alias(spec.line), *out
    )
