"""Query bindings over the driver's test tables.

Each binding is ``(spark, sf_dir) -> DataFrame`` plus, where SQL can say the
same thing, an equivalent DuckDB SQL string over the same parquet views.
Bindings call the library operators; they add only the mapping from the
test tables to the operator's inputs.
"""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def binding(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all():
    import importlib
    for mod in ("loader", "observability", "routing", "governance", "roundtrips", "warehouse"):
        try:
            importlib.import_module(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{mod}":
                raise
    return QUERIES, ORACLE
