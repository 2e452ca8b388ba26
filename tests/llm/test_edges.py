"""Every operator and every stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, imatch, language, license_scan, line_dedup, mixing, ngram_join, secret_scan, sharding

CLASH = ("size", "source_size", "target", "copies", "taken", "shard", "slot", "text_crc32", "spans", "parts", "labels", "score", "kept",
         "n_lines", "lang_pred", "rejected", "component_id", "u", "q", "cut", "_h", "_d", "_b", "_row", "_text", "_keys", "copy")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LEAK = "the capital of the distant northern province lies beside a frozen river"
LONG = " ".join(f"word{i % 977} of{i % 613}" for i in range(60_000)) + "\n" + "password = hunter22 " * 2000 + "-a" * 50_000
ROWS = [(1, None, "en", "a", 5), (2, "", "en", "a", None), (3, " \n\t\n ", None, None, 1), (4, "the cat sat on the mat by the door", "en", "a", 9),
        (5, "the cat sat on the mat by the door", "en", "b", 9), (5, "the cat sat on the mat by the door", "en", "b", 9),
        (6, "12345 67890", "en", None, 3), (7, LONG, "en", "a", 1), (8, f"he said {LEAK} and left", "en", "b", 2),
        (None, "a text without an id stands here in plain words", None, None, None), (9, "é ß 漢字 🙂 ünïcode wörds äre hére", "de", "c", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *("mine" for _ in CLASH)) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, LEAK, "x"), (2, None, "x"), (3, "", "x"), (None, "never seen in any of these texts, not at all", "x")],
                                 "item_id long, text string, start string")


IDS = sorted((r[0] for r in ROWS if r[0] is not None))


def model_of(docs):
    return language.train(docs, steps=20)


OPERATORS = {
    "op1": (lambda d, b: ngram_join.ngram_jaccard_join(d), sorted(set(IDS))),
    "op2": (lambda d, b: imatch.fingerprint_documents(d), sorted(set(IDS))),
    "op3": (lambda d, b: decontaminate.contaminated(d, b), [8]),
    "op4": (lambda d, b: secret_scan.scan_secrets(d), [None, *IDS]),
    "op5": (lambda d, b: license_scan.scan_licenses(d), [None, *IDS]),
    "op6": (lambda d, b: mixing.mix_sources(d), [None, *IDS]),
    "op7": (lambda d, b: line_dedup.dedup_lines(d), [None, *IDS]),
    "op8": (lambda d, b: language.identify(d, model_of(d)), [None, *IDS]),
    "op9": (lambda d, b: sharding.shard_by_bytes(d, shards=3), [None, *IDS]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_edge_rows(spark, docs, bench, name):
    run, expected = OPERATORS[name]
    out = run(docs, bench)
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i)) == expected
    by_id = {r["doc_id"]: r for r in rows}
    if name == "op1":
        assert by_id[5]["component_id"] == 4 and by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == 0
        assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] != 5)
    if name == "op2":
        assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[4]["fingerprint"] == by_id[5]["fingerprint"]
        assert by_id[1]["n_chars"] == 0 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    if name == "op4":
        assert len(by_id[7]["spans"]) >= 2000 and by_id[1]["spans"] == by_id[2]["spans"] == []
    if name == "op6":
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and by_id[1]["size"] == 0 and by_id[9]["size"] == 8
    if name == "op7":
        assert by_id[1]["n_lines"] == 1 and by_id[1]["kept"] == "" and by_id[5]["n_dropped"] == 1 and by_id[4]["n_dropped"] == 0
    if name == "op8":
        assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 6)) for r in rows)
    if name == "op9":
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        assert by_id[1]["size"] == 1 and by_id[1]["n_chars"] == 5


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_empty_tables(spark, docs, bench, name):
    run, _ = OPERATORS[name]
    none = spark.createDataFrame([], docs.schema)
    assert run(none, bench.limit(0)).count() == 0
    if name == "op3":
        assert run(docs, bench.limit(0)).count() == 0


def test_chats_on_edge_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", None, "x"), (1, 1, "user", "", "x"), (1, 2, "assistant", "<|im_end|>\n" + "w " * 30_000, "x"),
                                  (1, 2, "assistant", "tie", "x"), (1, 2, "assistant", "tie", "x"), (None, None, None, None, "x"), (2, 0, "assistant", None, "x")],
                                 "conv_id long, turn long, role string, text string, window string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(rows)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("system", ""), ("user", ""), ("assistant", "<|im_end|>\n" + "w " * 30_000), ("assistant", "tie"), ("assistant", "tie")]
    assert back[1]["loss_text"] == "<|im_end|>\n" + "w " * 30_000 + "tietie"
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")] and back[2]["loss_text"] == ""
    assert chat.read_back(chat.format_chats(rows.limit(0))).count() == 0


def test_stages_keep_the_columns(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
            assert out.filter(" OR ".join(f"`{c}` <> 'mine'" for c in CLASH)).count() == 0
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "language":
            assert not ids & {1, 2, 3, 6}
        elif name == "near duplicates":
            assert ids == {None, *IDS} - {5}
        elif name == "decontamination":
            assert ids == {None, *IDS} - {8}
        elif name == "sharding":
            assert ids == {None, *IDS} and out.count() == len(ROWS)
        assert stage(spark, docs.filter(F.lit(False)), str(tmp_path)).count() == 0


def test_rows_stay_or_go_by_their_own_text(spark, bench, tmp_path):
    """Repeated and missing doc_ids: a clean row outlives a bad one of the same id, and a bad row without an id goes."""
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    other = "quite another text that has nothing in common with any of the others here"
    rows = [(1, LEAK, "en", "a", 1), (1, other, "en", "a", 2), (None, f"x {LEAK} y", "en", "a", 3), (None, other, "en", "a", 4), (2, other, "en", "a", 5), (None, "short", "en", "a", 6)]
    docs = spark.createDataFrame([(*r, *("mine" for _ in CLASH)) for r in rows], SCHEMA).repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    left = sorted(r["n_chars"] for r in stages["decontamination"](spark, docs, str(tmp_path)).collect())
    assert left == [2, 4, 5, 6]
    kept = sorted(r["n_chars"] for r in stages["near duplicates"](spark, docs, str(tmp_path)).collect())
    assert kept == [1, 2, 6]                                  # of each group the row of doc_id 1; 8 of 10 shingles link 1 and 3
