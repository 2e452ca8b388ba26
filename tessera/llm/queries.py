"""The operators applied to the test tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_back
from .decontaminate import contaminated
from .filter_audit import audit_filters
from .imatch import fingerprint_documents
from .language import held_out, identify, train
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import LENGTH_ODDS, mix_sources
from .ngram_join import ngram_jaccard_join
from .secret_scan import scan_secrets, spans_text
from .sharding import shard_by_bytes
from .source_divergence import audit_sources
from .url_filter import canonical_url, filter_urls, host_of, prefix_entries, url_entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op5_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op6_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), odds=LENGTH_ODDS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_shard_documents(spark, sf_dir):
    rows = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op10_format_chats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = read_back(format_chats(rows.unionByName(own)))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars")


def op11_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
JUNK_HOSTS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op12_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict")))) for r in URL_RULES))))
    junk = pages.filter(F.arrays_overlap(F.split(host_of(F.col("url")), "\\."), F.array(*map(F.lit, JUNK_HOSTS))))
    listed = prefix_entries(rules).unionByName(url_entries(junk.select(canonical_url(F.col("url")).alias("canonical"))))
    judged = filter_urls(pages, listed)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "canonical", "listed")


def op13_source_divergence(spark, sf_dir):
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


# The same results in DuckDB SQL, where SQL can state them.
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w)"""

ORACLE = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
n AS (SELECT doc_id, len(ss)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(ss) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(ss) > 0 THEN list_sort(ss) ELSE [doc_id::VARCHAR] END) AS class_id FROM s)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, any_value(class_id) AS class_id
FROM n JOIN reach USING (doc_id) JOIN copies USING (doc_id) GROUP BY n.doc_id, n.n""",
    "op6_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([5.0, 2.0, 1.0]::DOUBLE[], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS w
      FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM c),
g AS (SELECT source, source_size, least(cap, max(rate) OVER () * w) AS target FROM o),
p AS (SELECT *, coalesce(target / nullif(source_size, 0), 0)::DOUBLE AS ratio FROM g),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.source, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest,
        u / (1 - u) / (least(greatest(ratio - floor(ratio), 1e-12), 1 - 1e-12) / (1 - least(greatest(ratio - floor(ratio), 1e-12), 1 - 1e-12)) * (1::DOUBLE + least(size, 1000) / 1000::DOUBLE)) AS q
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN size > 0 AND below + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken FROM x""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, i, line, coalesce(h.n > 1 AND h.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    # Every order is played out on the documents' masks; the Shapley numbers are sums over the played orders.
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
        CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
        CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT '' AS o UNION ALL SELECT o || c FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
s AS (SELECT o, k, o[k] AS c, o[:k - 1] AS earlier FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(o) = 5),
x AS (SELECT m.part, o AS filter_order, k AS step, c, n, good, toxic,
        contains(fails, c) AS failing, length(translate(fails, earlier, '')) < length(fails) AS gone, fails <> c AS others FROM m, s),
g AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (failing AND NOT others), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
        coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (c), (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM g""",
    "op12_url_filter": rf"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM a),
c AS (SELECT *, regexp_replace(host, ':(80|443)?$', '') || rtrim(path, '/') AS base,
        array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS kept FROM h),
u AS (SELECT page_id, host, path, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM c),
bad AS (SELECT DISTINCT canonical FROM u WHERE canonical <> '' AND list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in JUNK_HOSTS)}])),
r AS (SELECT *, canonical IN (SELECT canonical FROM bad) AS listed, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, canonical, listed, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_UPPER}) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v))::HUGEINT AS p
        FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::HUGEINT AS q
        FROM c GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b
            ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank
FROM best QUALIFY rank <= 200""",
}

QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_document_fingerprints, op3_benchmark_decontamination, op4_secret_scan, op5_license_scan,
    op6_mix_sources, op7_line_dedup, op8_language_id, op9_shard_documents, op10_format_chats,
    op11_filter_audit, op12_url_filter, op13_source_divergence)}
