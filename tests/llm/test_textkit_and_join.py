"""Shingle sets, the n-gram join and components against brute force."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language, ngram_join, textkit
from tessera.llm.ngram_join import MIN_SIZE, differing, need, ngram_jaccard_join, signature, sketch
from tessera.llm.shared import bitmap, components, has_bit
from tessera.llm.textkit import ascii_lower, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rep string, component_id string"


def shingles(text):
    w = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def fixture(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, base = [], [[rnd.choice(words) for _ in range(n)] for n in (6, 9, 14, 30, 80, 300)]
    for k in range(220):
        text = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        if rnd.random() < 0.3:
            text += [rnd.choice(words) for _ in range(rnd.randrange(6))]
        docs.append((k, rnd.choice([" ", "\n", "\t "]).join(text).title()))
    passage = " ".join(words[:60])                   # a passage that many otherwise different texts share
    docs += [(1000 + k, passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 25)))) for k in range(40)]
    return docs + [(2000, ""), (2001, None), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "a b c"), (2006, "a b  c")]


def test_join_equals_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df).collect()}
    assert got == brute(docs)


def test_join_finds_isolated_pairs_of_unequal_size(spark):
    rnd, docs = random.Random(11), []
    for k in range(80):
        words = [f"p{k}x{i}" for i in range(rnd.randrange(84, 405))]
        extra = [f"p{k}y{i}" for i in range(int(len(words) * rnd.uniform(0.15, 0.24)))]
        at = len(words) if k % 2 else rnd.randrange(1, len(words))
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:at] + extra + words[at:]))]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    want = brute(docs)
    assert sum(d != root for d, (_, root) in want.items()) > 60
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df).collect()} == want


@pytest.mark.parametrize("percent", [40, 50, 66, 75, 100])
def test_join_at_other_similarities(spark, percent):
    rnd, docs = random.Random(percent), []
    for k in range(60):
        words = [f"q{k}x{i}" for i in range(rnd.randrange(5, 12))]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"q{k}y{i}" for i in range(rnd.randrange(4))]))]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df, percent=percent).collect()}
    assert got == brute(docs, percent)


def test_join_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f g", "", ""), (1, "a b c d e f g", "", ""), (None, "a b c d e f g", "", ""), (2, "A B C D E F G", "", "")]
    got = sorted((r["doc_id"], r["component_id"], r["class_id"]) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1), (2, 1, 1)]
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingle_sets_are_one_per_row_and_distinct():
    texts = ["a b c d e f", None, "", "x" * 3_000_000 + " b c d e", "a b c d e f a b c d e f", "ä ö ü ß é"]
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert all((np.diff(s) > 0).all() for s in sets if len(s) > 1)
    assert set(sets[0]) <= set(sets[4])


def test_prefix_bound_is_safe():
    for n in range(MIN_SIZE, 400):
        for m in range(n, 500):
            if 100 * n < 80 * m:
                break
            overlap = -(-80 * (n + m) // 180)
            assert overlap >= need(m, 80) or overlap >= need(n, 80)
            assert overlap >= 2


def test_components_and_bits(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(500, k) for k in range(501, 560)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for v, root in got.items():
        seen, todo = {v}, [v]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert root == min(seen)
    hashes = np.array([rnd.getrandbits(64) for _ in range(500)], np.uint64)
    table = bitmap(spark.createDataFrame([(int(h),) for h in hashes[:250].view(np.int64)], "h long"), "h")
    assert has_bit(table, hashes[:250]).all() and not has_bit(table, hashes[250:]).all()


def test_signatures_never_differ_in_more_bits_than_the_sets():
    rnd = np.random.default_rng(7)
    for _ in range(300):
        n, m = rnd.integers(1, 3000, 2)
        both = rnd.integers(0, min(n, m) + 1)
        s = np.unique(rnd.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = s[:n], s[n - both:n - both + m]
        apart = len(np.setxor1d(a, b))
        bits = sum(int(x).bit_count() for x in (signature(a) ^ signature(b)).view(np.uint64))
        assert bits <= apart and differing(sketch(a), sketch(b)) <= apart and differing(sketch(b), sketch(a)) <= apart
    a, far = np.unique(rnd.integers(0, 2**63, (2, 4000), dtype=np.uint64), axis=1)
    assert 180 * differing(sketch(a), sketch(far)) > 20 * (len(a) + len(far))      # unrelated sets of any size are told apart


@pytest.mark.parametrize("edits", [6, 14])
def test_groups_of_near_copies_cost_few_verified_pairs(spark, monkeypatch, edits):
    """Near copies of one text that link with few others (6 edits: just below 80 percent) or none (14: well below)."""
    rnd, counted = random.Random(edits), {}
    base = [f"b{i}" for i in range(260)]
    write = ngram_join.materialize

    def counting(df, name):
        out = write(df, name)
        counted[name] = counted.get(name, 0) + (out.count() if name in ("candidates", "likely") else 0)
        return out
    monkeypatch.setattr(ngram_join, "materialize", counting)
    pairs = []
    for size in (300, 900):
        docs = []
        for k in range(size):
            words = list(base)
            for at in rnd.sample(range(260), edits):
                words[at] = f"e{k}x{at}"
            docs.append((k, " ".join(words)))
        counted.clear()
        df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(4)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df).collect()}
        if size == 300:
            assert got == brute(docs)
        pairs.append((counted["candidates"], counted["likely"]))
    assert pairs[1][1] <= 4 * max(pairs[0][1], 900) and pairs[1][0] <= 20 * 900


def test_join_runs_no_python_rows_beside_arrow(spark, monkeypatch):
    """A frame of Python rows, even an empty one, starts a second set of Python workers on every executor."""
    def refused(*args, **kwargs):
        raise AssertionError("createDataFrame in the join")
    docs = spark.range(12).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 39), k -> "
                                      "concat('w', k + if(id < 4, 0, 100 * id))), if(id < 4, concat('x', id), '')) AS text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs).collect()}
    assert got == brute(texts) and len({c for _, c in got.values()}) == 9


def test_memory_of_a_batch_follows_its_pieces():
    """A batch of 4 MB of texts is worked in less memory than its largest arrays would take at once, with the rows' own results."""
    draw, known = np.random.default_rng(3), [f"w{i}" for i in range(3000)]
    texts = pa.array([*(" ".join(draw.choice(known, 800)) for _ in range(1000)), None, "", "a" * (1 << 19), "b c"])
    model = language.Model(["a", "b"], draw.normal(size=(language.BUCKETS, 2)), np.zeros(2), 1.0, 0.0, 1.0,
                           draw.normal(size=(language.BUCKETS, 2)), -1.0)
    small = texts.take(pa.array([*range(0, 1000, 100), 1000, 1001, 1003]))
    for work, most in ((model.predict, 60), (lambda t: [len(s) for s in shingle_sets(t)], 25)):
        textkit._POW.clear()
        tracemalloc.start()
        work(texts.slice(0, 1000))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, peak
    for a, b in zip(model.predict(texts), model.predict(small)):
        assert list(a[[*range(0, 1000, 100), 1000, 1001, 1003]]) == list(b)
    alone = [next(iter(shingle_sets(texts.slice(i, 1)))) for i in range(len(texts))]
    assert all(np.array_equal(a, b) for a, b in zip(shingle_sets(texts), alone))


def test_power_tables_of_long_texts_are_not_kept():
    up, down = textkit._powers(3 * textkit.MOST_HELD)
    assert len(up) == len(down) == 4 * textkit.MOST_HELD
    assert len(textkit._powers(10)[0]) == textkit.PIECE
    held = textkit._powers(textkit.MOST_HELD)
    assert textkit._powers(10) is held and len(textkit._POW) == 1       # not built anew for every shorter piece
    textkit._POW.clear()
