"""Envelope -> typed fact rows (PRJ1-6, PRJ4 discriminators, SET5 sparse union).

The JSON ``data`` object is parsed **once** per row with ``from_json`` and a
schema generated from the registry paths (all leaves as strings, objects and
arrays come back as JSON text); every column is then a field access plus a
lenient cast.  That keeps the whole projection inside one codegen'd
``Project`` instead of one JSON parse per path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dispatch import ENVELOPE, ENVELOPE_COLS, FACT_TABLES, FactDispatch

ENVELOPE_SCHEMA = "id string, time string, type string, tenantid string, caseid string, data string"


def envelope_cols() -> list:
    """PRJ1: envelope fields renamed to their warehouse columns, typed."""
    return [coerce(F.col(src), typ).alias(col) for col, src, typ in ENVELOPE]


def coerce(c: Column, type_name: str, width: int | None = None) -> Column:
    """PRJ6: lenient typing (malformed values become NULL, never fail the batch)."""
    if type_name == "timestamp":
        out = F.try_to_timestamp(c)
    elif type_name == "date":
        out = c.try_cast("date")
    elif type_name == "string":
        out = c.cast("string")
        if width:
            out = F.left(out, F.lit(width))
    else:
        out = c.try_cast(type_name)
    return out


def _data_schema(paths) -> str:
    """DDL struct for the ``data.*`` paths of one or more entries (string leaves)."""
    tree: dict = {}
    for p in paths:
        parts = p.split(".")
        if parts[0] != "data":
            continue
        node = tree
        for name in parts[1:-1]:
            node = node.setdefault(name, {})
            if not isinstance(node, dict):
                raise ValueError(f"path {p} nests below a leaf")
        node.setdefault(parts[-1], None)

    def render(node):
        fields = []
        for name, child in node.items():
            typ = "string" if child is None else render(child)
            fields.append(f"`{name}`: {typ}")
        return "struct<" + ", ".join(fields) + ">"

    return render(tree) if tree else "struct<>"


def _path_col(path: str, parsed: str = "_d") -> Column:
    parts = path.split(".")
    if parts[0] != "data":
        return F.col(parts[0])  # envelope field: type / time / ...
    c = F.col(parsed)
    for name in parts[1:]:
        c = c.getField(name)
    return c


def parse_data(env: DataFrame, entries) -> DataFrame:
    """Add ``_d`` = data parsed once with the union schema of ``entries``."""
    schema = _data_schema([p for e in entries for p in e.paths])
    return env.withColumn("_d", F.from_json(F.col("data"), schema))


def project(env: DataFrame, entry: FactDispatch, with_type: bool = False) -> DataFrame:
    """PRJ2-5: rows of ``entry.event_type`` as the entry's columns, in order."""
    df = parse_data(env.filter(F.col("type") == entry.event_type), [entry])
    cols = envelope_cols()
    for c, p, t in zip(entry.columns, entry.paths, entry.types):
        cols.append(coerce(_path_col(p), t).alias(c))
    if with_type:
        cols.append(F.col("type").alias("_event_type"))
    return df.select(*cols)


def project_table(env: DataFrame, entries, table: str | None = None) -> DataFrame:
    """SET5 in one pass: all entries of one table as a single CASE projection.

    Each table column is ``CASE type WHEN e1 THEN path1 WHEN e2 THEN path2 END``
    over the rows whose type belongs to the table; columns an event type does
    not list are NULL (sparse union), so no per-type scans and no ``union``.
    """
    entries = list(entries)
    table = table or entries[0].table
    ft = FACT_TABLES.get(table)
    types = [e.event_type for e in entries]
    df = parse_data(env.filter(F.col("type").isin(types)), entries)
    out_cols = [c for c, _ in ft.columns] if ft else list(dict.fromkeys(c for e in entries for c in e.columns))
    sel = envelope_cols()
    for c in out_cols:
        expr = None
        for e in entries:
            if c in e.columns:
                i = e.columns.index(c)
                v = coerce(_path_col(e.paths[i]), e.types[i])
                expr = (F.when(F.col("type") == e.event_type, v) if expr is None
                        else expr.when(F.col("type") == e.event_type, v))
        if expr is None:
            typ = ft.type_of(c) if ft else "string"
            expr = F.lit(None).cast(typ)
        sel.append(expr.alias(c))
    sel.append(F.col("type").alias("_event_type"))
    return df.select(*sel)


def unify(frames) -> DataFrame:
    """SET3/SET5: union by name, missing columns NULL."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_mapped(env: DataFrame, registry) -> tuple:
    """FIL2: (mapped, unmapped) rows by registry membership.

    The registry is a few dozen type names, so ``isin`` compiles to an
    in-set predicate evaluated inside the scan's codegen stage (no join).
    """
    types = list(registry)
    mapped = env.filter(F.col("type").isin(types))
    unmapped = env.filter(~F.col("type").isin(types) | F.col("type").isNull())
    return mapped, unmapped


def registry_frame(spark, registry) -> DataFrame:
    """The registry as a small table: (event_type, target_table, strategy, merge_key)."""
    rows = [(e.event_type, e.table, e.strategy, e.merge_key) for e in registry.values()]
    return spark.createDataFrame(rows, "event_type string, target_table string, strategy string, merge_key string")


def dispatch_for(types: DataFrame, registry, type_col: str = "event_type") -> DataFrame:
    """JN4: look up each event type's dispatch entry (left join; unmapped -> NULL).

    The registry holds a few dozen entries (fixed by code), so it is broadcast.
    """
    reg = registry_frame(types.sparkSession, registry).withColumnRenamed("event_type", type_col)
    return types.join(F.broadcast(reg), type_col, "left")


def empty_like(df_or_schema, spark=None) -> DataFrame:
    """DML4: empty frame with the same columns, every field nullable."""
    from pyspark.sql import types as T
    schema = df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    spark = spark or df_or_schema.sparkSession
    return spark.createDataFrame([], nullable)


def conform(df: DataFrame, table: str) -> DataFrame:
    """SNK1: select the table's columns in order; columns the batch lacks are NULL."""
    ft = FACT_TABLES[table]
    cols = []
    for f in ft.schema.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


__all__ = ["ENVELOPE_SCHEMA", "ENVELOPE_COLS", "envelope_cols", "coerce", "parse_data", "project",
           "project_table", "unify", "split_mapped", "registry_frame", "dispatch_for", "empty_like", "conform"]
