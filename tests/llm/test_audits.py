"""Filter audit, URL filter and source divergence against brute force, and on edge rows."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, source_divergence, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, part string, n long, step string, value string, rank string, A string, E string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["mine"] * 1, 7, *["mine"] * 5) for r in rows], DOCS).repartition(3)


def documents(seed=1, n=140):
    rnd = random.Random(seed)
    vocab = {lang: [f"{lang}{w}" for w in ("a", "Ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "x" * 17, "x" * 18, "ünï", "ÜNÏ", "漢字", "z1z", "q-r")]
             for lang in ("en", "de")}
    rows = []
    for k in range(n):
        lang = rnd.choice(["en", "en", "de"])
        words = [rnd.choice(vocab[lang]) for _ in range(rnd.choice([0, 3, 40, 250]))] + [f"rare{k}"]
        if rnd.random() < 0.3:
            words = words[:2] * 120
        if rnd.random() < 0.2:
            words.append("#tag")
        rows.append((k, rnd.choice([" ", "\n", "\t "]).join(words), lang, rnd.choice(["s1", "s2", "s3", "s4", None])))
    rows += [(1000 + k, rows[k % min(n, 7)][1], "en", "s1") for k in range(30)]            # copies
    rows += [(2000, None, None, None), (2001, "", "en", ""), (2002, " \n", "", "lone"), (None, rows[0][1], "en", "s2"), (None, None, "fr", "s9"),
             (2003, "same row", "en", "s3"), (2003, "same row", "en", "s3"), (2004, "only one #", "fr", "s9"), (2005, "W" * 5000 + " w" * 30000, "fr", "s8"),
             (2006, "only two", "fr", "s8"), (2007, "only three", "fr", "s8")]
    return rows


def audit_by_hand(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    text = [(d, t or "", s or "") for d, t, _, s in docs]
    first = {}
    for d, t, _ in text:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    rows = []
    for d, t, s in text:
        w = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                               bool(re.search("[#$%&*|]", t)), d is not None and d > first[t])) if bad}
        rows.append((s, fails, d is not None and d in good, d is not None and d in toxic))
    out, by_filter = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                now = [r for r in left if f in r[1]]
                out[part, order, k + 1] = [len(left) - len(now), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in left + gone),
                                           sum(r[2] for r in now), sum(r[3] for r in now)]
                by_filter[part, f] += len(now)
                left, gone = [r for r in left if f not in r[1]], gone + now
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_every_order_played_out(spark):
    docs = documents()
    labels = [(k, k % 2, (k % 5 == 0) + 0) for k in range(0, 90)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (1003, 1, None), (2000, None, 1)]
    out = filter_audit.audit_filters(frame(spark, docs), spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in out.collect()}
    assert len(got) == out.count() and got == audit_by_hand(docs, labels)


def test_filter_audit_of_empty_tables(spark):
    docs, labels = frame(spark, documents(n=5)), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.filter(F.lit(False)), labels).count() == 0
    assert filter_audit.audit_filters(docs, labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_potential_gives_shapley_values_of_any_number_of_filters(spark):
    rnd = random.Random(4)
    for k in (1, 2, 4):
        cells = [(m, rnd.randrange(50)) for m in range(1 << k)]
        df = spark.createDataFrame([("p", cells)], "part string, cells array<struct<mask:int,n:long>>")
        got = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in filter_audit.audit_masks(df, list("VWXY"[:k]), {}).collect()}
        for i in range(k):
            want = sum(sum(n for m, n in cells if m >> i & 1 and not any(m >> j & 1 for j in order[:order.index(i)]))
                       for order in itertools.permutations(range(k)))
            assert got["VWXY"[i]] == want


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/fr/x", "block")]


def judge_by_hand(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, None))
    return host, path, rule[1], rule[2] or ("block" if listed else "allow")


URLS = [None, "", "no scheme", "https://", "http:///en/", "https://Example.NET/en/a", "https://example.net/EN/a", "https://notexample.net/en/", "http://x.example.net",
        "http://x.example.net?q=/en/", "ftp://a.example.com/de/", "http://example.com/de", "http://example.com.org/fr/", "http://org/fr/1#top", "http://b.org/fr/1?x",
        "http://q.a.b.org/fr/xy", "http://a.b.org/fr/y", "http://xa.b.org/fr/x", "http://net/", "http://.net/", "http://net.", "see http://u.net/a://b.com/",
        "http://bad.com/p/?utm_source=f&b=2&a=1", "https://bad.com:443/p?a=1&b=2#frag", "http://bad.com/p?a=1", "http://BAD.com/P", "http://" + "l." * 3000 + "net/" + "p/" * 3000]


def test_url_filter_equals_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(None, URLS[5], "x", "y")] + [(77, URLS[5], "x", "y")] * 3 + [(None, None, "x", "y")] * 2,
                                  "page_id long, url string, verdict string, rule string").repartition(3)
    rules = spark.createDataFrame(RULES + [("org", "/fr/", "block")], "host string, path string, verdict string")
    listed = url_filter.prefix_entries(rules).unionByName(url_filter.url_entries(spark.createDataFrame([("bad.com/p?a=1&b=2",), ("",)], "canonical string")))
    out = url_filter.filter_urls(pages, listed).collect()
    want = [(p["page_id"], *judge_by_hand(p["url"], p["url"] in URLS[22:24])) for p in pages.collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    assert order([(r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out]) == order(want)
    assert {r["url"] for r in out if r["listed"]} == set(URLS[22:24])
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_passes_every_listed_key_and_few_others(spark):
    listed = spark.range(4000).select(F.lit(1).alias("kind"), F.concat(F.lit("in"), "id").alias("entry"))
    others = spark.range(20000).select(F.lit(1).alias("kind"), F.concat(F.lit("out"), "id").alias("entry"))
    blocks = url_filter.bloom_blocks(listed, 8)
    assert blocks.count() == 256
    assert url_filter.possible_hits(listed, blocks, 8).count() == 4000
    assert url_filter.possible_hits(others, blocks, 8).count() < 600
    full = url_filter.bloom_blocks(listed, 1)                  # far too small: all pass, which costs time and loses nothing
    assert url_filter.possible_hits(listed, full, 1).count() == 4000 and url_filter.possible_hits(others, full, 1).count() > 19000


def divergence_by_hand(docs, at_least=3, top=200):
    texts = [(la or "", s or "", ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(t or "")]) for _, t, la, s in docs]
    out = set()
    for lang in {t[0] for t in texts}:
        mine = [t for t in texts if t[0] == lang]
        held = collections.Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= at_least)
        counts = {s: collections.Counter(w for _, x, ws in mine if x == s for w in ws) for s in {t[1] for t in mine}}
        counts[None] = collections.Counter(w for _, _, ws in mine for w in ws)
        p = {}
        for s, c in counts.items():
            total = sum(c[w] for w in kept)
            p[s] = {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}
        for s in counts:
            if s is None:
                continue
            pairs = sorted(((-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in counts if o not in (s, None)), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-((p[s][w] - p[None][w]) ** 2 // p[None][w]), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]),
                           key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)} | {(lang, s, "term", w, -v, k + 1) for k, (v, w) in enumerate(terms)}
    return out


@pytest.mark.parametrize("options", [{}, {"levels": (1, 2), "block": 2, "cell": 7}, {"block": 1, "at_least": 2}, {"top": 2, "levels": (64,)}])
def test_source_divergence_equals_brute_force(spark, options):
    docs = documents()
    got = source_divergence.audit_sources(frame(spark, docs), **options).collect()
    want = divergence_by_hand(docs, options.get("at_least", 3), options.get("top", 200))
    assert len(got) == len(want) and {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == want


def test_source_divergence_of_an_empty_table_and_the_callers_setting(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert source_divergence.audit_sources(frame(spark, documents(n=3)).filter(F.lit(False))).count() == 0
    none_kept = source_divergence.audit_sources(frame(spark, [(1, "aa bb", "en", "x"), (2, "cc", "en", "y")])).collect()
    assert sorted((r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in none_kept) == [("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)]
    assert spark.conf.get(key) == before


def test_discarded_prefixes_are_not_counted_again(spark):
    docs = frame(spark, [(k, f"common{'xy'[k % 2]} rare{'abcdefgh'[k]}", "en", "s") for k in range(8)])
    texts = docs.select("lang", "source", "text")
    first = source_divergence.prefix_counts(texts, 5, None).groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 3")
    bits = spark.sparkContext.broadcast(source_divergence.bitmap(first, "token"))
    assert first.count() == 1                                  # "commo"; every "rare." stands in one document
    left = source_divergence.prefix_counts(texts, 7, (5, bits)).groupBy("token").agg(F.sum("n").alias("n")).collect()
    assert sorted(r["n"] for r in left) == [4, 4]
    assert {r["term"] for r in source_divergence.term_counts(texts, (5, bits)).collect()} == {"commonx", "commony"}


def test_grouping_of_terms_counts_documents_exactly():
    """Distinct keys, a place of each, and the distinct documents of each, against plain sets."""
    import numpy as np
    from tessera.llm.source_divergence import documents, grouped
    rng = np.random.default_rng(5)
    for size in (0, 1, 3000):
        keys = rng.integers(0, 90, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = np.sort(rng.integers(0, 40, size))
        found, at, code = grouped(keys)
        assert found.tolist() == sorted(set(keys.tolist()))
        assert (keys[at] == found).all() and (found[code] == keys).all()
        assert documents(code, rows, 40, len(found)).tolist() == [len({r for k, r in zip(keys, rows) if k == f}) for f in found]
