"""URL filters: a blocked Bloom filter of listed URLs in front of an exact hash join.

A list holds prefix rules (host, path, verdict) that fit a host with all its
subdomains and every path that starts alike, and canonical URLs.  A page asks
for few keys: each host suffix of as many labels as listed hosts have, with
each path prefix of a listed length, and its canonical URL.

1. The filter: 256 bits a block, eight words of 32 bits, one bit set in each
   word by every key.  A block is a row, at most ``2**MAX_BITS`` rows, and is
   built by ``bit_or``.  The filter is broadcast: its size is bounded by that.
2. Keys whose eight bits are all set are possible hits; most pages end here,
   without a shuffle of keys.
3. The exact join with the list takes out the false positives.  Keys that hold
   over 1/256 of all possible hits, at most 255 of them, are joined by
   broadcast, all other keys by a shuffle in which no key is hot.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORDS = 8
MAX_BITS = 18                                   # at most 2**18 blocks: 8 MB of filter
PER_BLOCK = 16                                  # keys a block is sized for
HOT = 256
PREFIX, URL = 0, 1                              # kinds of list entries
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty without ``://`` or for NULL."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without default port, path without closing slashes, query parameters sorted without ``utm_`` ones, no fragment."""
    host = F.regexp_replace(host_of(url), ":(80|443)?$", "")
    path = F.rtrim(path_of(url), F.lit("/"))
    query = F.regexp_extract(_after_scheme(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.coalesce(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")), F.lit(""))


def prefix_entries(rules: DataFrame) -> DataFrame:
    """List entries of rules ``host, path, verdict``."""
    return rules.select(F.lit(PREFIX).alias("kind"), F.concat("host", "path").alias("entry"), "verdict",
                        F.size(F.split("host", "\\.")).alias("labels"), F.char_length("path").alias("path_length"))


def url_entries(canonical: DataFrame, column: str = "canonical") -> DataFrame:
    """List entries that block whole canonical URLs."""
    return canonical.filter(F.col(column) != "").select(
        F.lit(URL).alias("kind"), F.col(column).alias("entry"), F.lit("block").alias("verdict"),
        F.lit(None).cast("int").alias("labels"), F.lit(None).cast("int").alias("path_length"))


def _hashes(bits: int) -> list[Column]:
    """The block of a key, and the hash that its marks are cut from."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit("block"), "kind", "entry"), 64 - bits).alias("block"),
            F.xxhash64(F.lit("bits"), "kind", "entry").alias("_h")]


# The bit that a key sets in each of the eight words of its block.
MARKS = [f"shiftleft(1, cast(shiftrightunsigned(_h, {5 * i}) & 31 as int))" for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, bits: int) -> DataFrame:
    """``block, w0 .. w7``: the rows of the filter, at most ``2**bits`` of them."""
    rows = listed.select(*_hashes(bits)).select("block", *(F.expr(m).alias(f"w{i}") for i, m in enumerate(MARKS)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible_hits(probes: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """The probes whose bits are all set: every listed key, and few others."""
    asked = probes.select("*", *_hashes(bits)).select(*probes.columns, "block", *(F.expr(m).alias(f"m{i}") for i, m in enumerate(MARKS)))
    set_ = " AND ".join(f"w{i} & m{i} = m{i}" for i in range(WORDS))
    return asked.join(F.broadcast(blocks), "block").filter(set_).select(*probes.columns)


def _keys(host: Column, path: Column, canonical: Column, labels: int, lengths: list[int]) -> Column:
    """What a page asks the list: (kind, entry) structs."""
    whole = F.array(F.struct(F.lit(URL).alias("kind"), canonical.alias("entry")))
    if not labels or not lengths:
        return whole
    hosts = F.array_distinct(F.array(*(F.substring_index(host, ".", -i) for i in range(1, labels + 1))))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.char_length(path) >= n), lambda n: F.substr(path, F.lit(1), n))
    rules = F.flatten(F.transform(hosts, lambda h: F.transform(
        paths, lambda p: F.struct(F.lit(PREFIX).alias("kind"), F.concat(h, p).alias("entry")))))
    return F.concat(rules, whole)


def filter_urls(pages: DataFrame, listed: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``id, url, host, path, canonical, rule, listed, verdict`` of every page.

    ``listed``: rows of ``prefix_entries`` and ``url_entries``; an entry listed
    twice counts once, and as ``allow`` where its verdicts differ.  The longest
    fitting rule decides; without one, a page is blocked if its canonical URL is
    listed, else allowed.  A NULL url, or one without ``://``, has an empty host
    and path and fits no rule.  Repeated rows give a row each; other columns are
    ignored.
    """
    listed = materialize(listed.groupBy("kind", "entry").agg(
        F.min("verdict").alias("verdict"), F.max("labels").alias("labels"), F.max("path_length").alias("path_length")), "url-list")
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    bits = min(max((shape["n"] // PER_BLOCK).bit_length(), 1), MAX_BITS)
    asked = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    u = F.col("url")
    keyed = asked.select("id", "url", host_of(u).alias("host"), path_of(u).alias("path"), canonical_url(u).alias("canonical"))
    keys = _keys(F.col("host"), F.col("path"), F.col("canonical"), shape["labels"] or 0, sorted(shape["lengths"]))
    probes = keyed.select("id", "url", F.explode(keys).alias("key")).select("id", "url", "key.kind", "key.entry")
    hits = materialize(possible_hits(probes, bloom_blocks(listed, bits), bits), "url-hits")
    total = hits.count()
    heavy = materialize(hits.groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * HOT > total)
                            .select("kind", "entry"), "url-hot")            # fewer than 256 rows: each is over 1/256 of the hits
    entries = listed.select("kind", "entry", "verdict")
    hot = hits.join(F.broadcast(entries.join(F.broadcast(heavy), ["kind", "entry"], "left_semi")), ["kind", "entry"])
    cold = hits.join(F.broadcast(heavy), ["kind", "entry"], "left_anti").join(entries, ["kind", "entry"])
    exact = hot.unionByName(cold).select(
        "id", "url", F.lit(0).cast("long").alias("n"),
        F.when(F.col("kind") == PREFIX, F.struct(F.char_length("entry").alias("length"), "entry", "verdict")).alias("rule"),
        (F.col("kind") == URL).alias("listed"))
    rows = asked.select("id", "url", F.lit(1).cast("long").alias("n"),
                        F.lit(None).cast(exact.schema["rule"].dataType).alias("rule"), F.lit(False).alias("listed"))
    judged = rows.unionByName(exact).groupBy("id", "url").agg(
        F.sum("n").alias("n"), F.max("rule").alias("rule"), F.max("listed").alias("listed"))
    # Repeated rows come back out in runs of at most 65,536, so no array grows with them.
    runs = judged.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 65536))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(65536), F.col("n") - 65536 * F.col("run")))))
    return each.select("id", "url", host_of(u).alias("host"), path_of(u).alias("path"), canonical_url(u).alias("canonical"),
                       F.col("rule.entry").alias("rule"), "listed",
                       F.coalesce("rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
