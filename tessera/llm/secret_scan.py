"""Secret scan with multipart credential linking.

Base spans are found on their own.  Weak candidates (a user or key name, a
mixed token without a label, an endpoint) prove little alone: one is reported
only when a complementary part stands near it.  Parts are intervals of a
document; the interval join works inside a scope (a paragraph, ended by an
empty line) and within ``reach`` characters, as running windows over the parts
of a scope, so no pairs are made.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .shared import cleared, short_batches

# The base patterns, with the shortest length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key(?:_id)?|key_id)["']?\x20*[:=]\x20*["']?([\w.@-]{3,128})""",
                     re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![a-z0-9.-])[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,16}:\d{2,5}\b", re.I | re.A)
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
# role of a weak candidate -> the roles of which one must stand near it
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
PART = "array<struct<kind:int,start:long,end:long,scope:int>>"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def base_spans(text: str):
    """``(start, kind, end)`` of the base spans; code points, end exclusive."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def weak_spans(text: str, base: list):
    """Candidates that need a partner; those that overlap a base span are part of it."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def free(a, b):
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a
    for m in WEAK_ID.finditer(text):
        yield m.start(), 3, m.end()
    for m in WEAK_SECRET.finditer(text):
        s = m[0]
        mixed = any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)
        if mixed and entropy(s) >= 3.5 and free(m.start(), m.end()):
            yield m.start(), 4, m.end()
    for m in ENDPOINT.finditer(text):
        yield m.start(), 5, m.end()


def parts_of(text: str) -> list[tuple]:
    """``(kind, start, end, scope)`` of all parts, by start, then kind."""
    base = sorted(base_spans(text))
    found = sorted(set(base) | set(weak_spans(text, base)))
    if not found:
        return []
    ends, scope, out = [m.end() for m in SCOPE_END.finditer(text)], 0, []
    for start, kind, end in found:
        while scope < len(ends) and ends[scope] <= start:
            scope += 1
        out.append((kind, start, end, scope))
    return out


def find_parts(docs: DataFrame) -> DataFrame:
    """``docs`` columns but the text, plus ``_row`` (a row number) and ``parts``."""
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int32())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "scope"), p)) for p in parts_of(t.as_py() or "")] for t in b.column("text")]
            yield pa.record_batch([b.column(f.name) for f in keep] + [b.column("_row"), pa.array(found, kind)],
                                  names=[f.name for f in keep] + ["_row", "parts"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", _row long, parts {PART}"
    return docs.withColumn("_row", F.monotonically_increasing_id()).select(*[f.name for f in keep], "text", "_row").mapInArrow(run, schema)


def link(parts: DataFrame, reach: int) -> DataFrame:
    """``_row, linked``: the weak parts that have a complementary part within reach in their scope."""
    rows = parts.filter(F.exists("parts", lambda p: p["kind"] >= 3)).select("_row", F.explode("parts").alias("p")).select("_row", "p.*")
    role = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (k, ROLE[name])]), F.col("kind"))
    rows = rows.withColumn("role", role)
    scope = Window.partitionBy("_row", "scope").orderBy("start", "kind", "end")
    back, ahead = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    for r in ("id", "secret", "endpoint"):
        # of a part before: the largest end; of a part after: the smallest start
        rows = (rows.withColumn(f"b_{r}", F.max(F.when(F.col("role") == r, F.col("end"))).over(back))
                    .withColumn(f"a_{r}", F.min(F.when(F.col("role") == r, F.col("start"))).over(ahead)))

    def near(r):
        return F.coalesce(F.col("start") - F.col(f"b_{r}") <= reach, F.lit(False)) | F.coalesce(F.col(f"a_{r}") - F.col("end") <= reach, F.lit(False))
    asks = F.lit(False)
    for mine, others in NEEDS.items():
        some = F.lit(False)
        for r in others:
            some = some | near(r)
        asks = asks | ((F.col("role") == mine) & some)
    linked = rows.filter((F.col("kind") >= 3) & asks)
    return linked.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """``docs`` (without the text) plus ``spans``: array of (start, kind, end), sorted.

    ``kind`` indexes ``KINDS``; base kinds (0 to 2) are always reported, weak
    ones only with a complementary part.  Offsets are code points.  A NULL or
    empty text has no spans; every row gives a row, repeated ones and those
    with a NULL doc_id too; a computed column replaces one of the same name.
    """
    short_batches(docs.sparkSession)
    docs = cleared(docs, "spans", "parts", "linked", "_row")
    found = materialize(find_parts(docs), "secret-parts")
    weak = link(found, reach)
    base = F.transform(F.filter("parts", lambda p: p["kind"] < 3),
                       lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (found.join(weak, "_row", "left")
                 .withColumn("spans", F.array_sort(F.concat(base, F.coalesce("linked", none)))).drop("_row", "parts", "linked"))


def spans_text(spans, kinds=KINDS):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
