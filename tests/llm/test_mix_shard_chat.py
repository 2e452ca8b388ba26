"""Fingerprints, mixing, sharding, language ID, chat windows and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.chat import CONTROL, escape, format_chats, pack_role, read_back, unescape, unpack_role
from tessera.llm.decontaminate import normal
from tessera.llm.imatch import fingerprint_documents
from tessera.llm.language import held_out, identify, train
from tessera.llm.mixing import mix_sources
from tessera.llm.sharding import shard_by_bytes
from tessera.oracle import compare, duck_connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"


def test_fingerprints(spark):
    rnd = random.Random(1)
    words = [f"term{i}" for i in range(3000)]
    docs = [(d, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 400)))) for d in range(0, 240, 2)]
    docs += [(501, docs[7][1]), (502, None), (503, ""), (504, "x"), (505, "é" * 7)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(None, "no id", 1)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: r for r in fingerprint_documents(df).collect()}
    order = sorted(docs, key=lambda x: -x[0])
    assert set(got) == {d for d, _ in docs}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + nxt[:third]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[501]["fingerprint"] == got[docs[7][0]]["fingerprint"]
    assert got[502]["fingerprint"] == got[503]["fingerprint"] != got[504]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 600]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)
    assert fingerprint_documents(spark.createDataFrame([], df.schema)).count() == 0
    one = fingerprint_documents(df.filter("doc_id = 2")).first()
    assert one["near_next"] == 1.0


def test_mix_targets_and_copies(spark):
    rnd = random.Random(2)
    rows = [(d, rnd.choice(["b", "a", "é", None, "c"]), " ".join(["w"] * rnd.randrange(0, 60)), 7) for d in range(900)]
    rows += [(5000 + d, "hot", "w " * rnd.randrange(1, 40), 7) for d in range(900)] + [(9000, "zero", None, 7), (9001, "zero", "", 7), (None, "a", "w w", 7)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int").repartition(5)
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    total, by = sum(r["size"] for r in out), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by.setdefault(r["source"], []).append(r)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    size = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    want, open_, rest = {}, set(by), 1.5 * total
    while True:                                      # reshare the excess until no target is above its limit
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s], rest = 2.0 * size[s], rest - 2 * size[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    for s, rs in by.items():
        assert rs[0]["source_size"] == size[s] and rs[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= 60
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mix_sources(df.repartition(2)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in out)
    assert mix_sources(spark.createDataFrame([], df.schema)).count() == 0


def test_pareto_odds_steer_the_sample(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit("w w w").alias("text"),
                                  F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("odds"))
    rows = mix_sources(df, share=0.5, odds="odds").groupBy("odds").agg(F.sum("taken").alias("t")).collect()
    taken = {r["odds"]: r["t"] for r in rows}
    assert taken[4.0] > 1.5 * taken[1.0]


def test_shards_by_bytes(spark):
    rnd = random.Random(3)
    rows = [(d, "é" * rnd.randrange(0, 400), 9) for d in range(1500)] + [(5000 + d, "hot group " * 12, 9) for d in range(1500)]
    rows += [(8000, None, 9), (None, "", 9), (8000, None, 9), (7777, "copy", 9), (7777, "copy", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    out = shard_by_bytes(df, shards=8).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    for s in range(8):
        mine = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= 900
    for r in out:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    homes = {}
    for r in out:
        if not (r["text"] or "").startswith("hot"):
            homes.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(h) <= 2 for h in homes.values())
    assert shard_by_bytes(spark.createDataFrame([], df.schema)).count() == 0
    few = shard_by_bytes(df.limit(3), shards=8)
    assert few.count() == 3


def test_language_rejects_what_it_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out("doc_id")))
    rnd = random.Random(1)
    odd = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(60)) for _ in range(10)]
    odd += ["Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto.",
            "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
            "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα."]
    out = identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in out)
    clean = identify(docs.filter(held_out("doc_id")), model).collect()
    assert sum(r["rejected"] for r in clean) <= 0.01 * len(clean)


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out("doc_id")))
    out = identify(docs.filter(held_out("doc_id")).withColumn("score", F.lit("x")), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 456 !!"), (None, "the house of the man and the dog"), (5, "the " * 200_000)], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in identify(odd, model).collect()]
    assert [p for _, p, _ in got[:3]] == ["und"] * 3 and all(0 <= s <= 1 for _, _, s in got)
    assert got[3][1] != "und" and got[4][1] != "und"
    assert identify(odd.limit(0), model).count() == 0
    none = train(docs.limit(0))
    assert {r["lang_pred"] for r in identify(odd, none).collect()} == {"und"}
    marked = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in marked.items())


def test_escape_round_trip(spark):
    rnd = random.Random(6)
    bits = [*CONTROL, "\\", "\\\\", "<", "[", "%", "%0A", "\n", "a", "<\\/s>", "<\\\\/s>", "[\\INST]", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e"))).withColumn(
            "r", unpack_role(pack_role(F.col("t")))).withColumn("p", pack_role(F.col("t"))).collect():
        assert r["u"] == r["t"] == r["r"] and "\n" not in r["p"]
        assert not any(c in r["e"] for c in CONTROL)


def test_chat_windows(spark):
    rnd = random.Random(7)
    rows = []
    for c in range(60):
        roles = (["system"] if rnd.random() < 0.5 else []) + [("user", "assistant")[k % 2] for k in range(rnd.randrange(0, 40))]
        rows += [(c, k, r, rnd.choice(["", "</s>[INST] ok [/INST]", "word " * rnd.randrange(1, 90)])) for k, r in enumerate(roles)]
    rows += [(100, 0, None, None), (100, None, "user", "first\nof all"), (100, 1, "assi\nstant%", "x"), (100, 1, "assi\nstant%", "x"), (None, 0, "assistant", "lone"),
             (101, 0, "assistant", "w " * 5000), (101, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nno")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(3)
    out = format_chats(df, budget=128, history=48).cache()
    got = {r["conv_id"]: r for r in read_back(out).collect()}
    want = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, t) for _, _, r, t in turns]
        assert got[c]["loss_text"] == "".join(t for _, _, r, t in turns if r == "assistant")
    for r in out.collect():
        n = r["formatted"].count("<|im_start|>")
        tokens = sum(len(re.findall(r"[^\W_]+|[^\w\s]|_", x)) for x in r["formatted"].split("<|im_end|>\n"))
        assert n > r["n_repeated"] and (tokens <= 2 * 128 + 200 or n - r["n_repeated"] == 1)
        turns = want[r["conv_id"]]
        if turns[0][2] == "system":
            assert r["formatted"].startswith("<|im_start|>system\n")
    assert any(r["n_repeated"] > 1 for r in out.collect())
    assert read_back(format_chats(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duck_connect(SF)
    result = compare(rows_of_spark(queries.QUERIES[name](spark, SF)), rows_of_duck(con, queries.ORACLE[name]))
    assert result["match"], result


def test_chat_query_equals_sql(spark):
    """Digests of the read-back turns, straight from the table."""
    con = duck_connect(SF)
    sql = """WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
        VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM c GROUP BY conv_id"""
    got = queries.op10_format_chats(spark, SF).drop("formatted_chars")
    result = compare(rows_of_spark(got), rows_of_duck(con, sql))
    assert result["match"], result


@pytest.mark.parametrize("name", ["op2_document_fingerprints", "op3_benchmark_decontamination", "op4_secret_scan", "op5_license_scan", "op8_language_id",
                                  "op9_shard_documents"])
def test_queries_cover_all_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES[name](spark, SF)
    ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    if name.startswith("op3"):
        bench = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        exact = {d["doc_id"] for d in docs.collect() if any(b in normal(d["text"]) for b in bench)}
        assert exact <= set(ids)
    else:
        assert ids == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    from tests.llm.test_textkit_and_join import brute
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language"](spark, docs, SF)
    assert named.columns == docs.columns and named.count() >= 0.97 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    groups = brute(rows)
    single = stages["near duplicates"](spark, named, SF)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    bench = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = {r["doc_id"] for r in single.collect() if any(b in normal(r["text"]) for b in bench)}
    free = stages["decontamination"](spark, single, SF)
    kept = {r["doc_id"] for r in free.collect()}
    assert not kept & leak and len(kept) >= single.count() - len(leak) - 2
    mixed = stages["mixing"](spark, free, SF)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and out.count() == mixed.count()
    assert out.select("shard").distinct().count() == 8
