"""Decontamination, secrets, licences and line dedup against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from tessera.llm.decontaminate import clean, contaminated, myers, normal, pieces_of
from tessera.llm.license_scan import PHRASES, TEMPLATES, Automaton, Scanner, chains, scan_licenses, words_of
from tessera.llm.line_dedup import Cuckoo, LineIndex, dedup_lines
from tessera.llm.secret_scan import scan_secrets, spans_text
from pyspark.sql import functions as F


def edits(item, text):
    """Fewest edits of ``item`` against any substring of ``text`` (table of all prefixes)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 90)))
        best, limit = edits(item, text), rnd.randrange(0, 12)
        hit = myers(item, text, limit)
        assert (hit is None) == (best > limit)
        if hit:
            d, a, b = hit
            assert d == best and 0 <= a <= b <= len(text) and edits(item, text[a:b]) == best


def test_pieces_cover_the_item():
    for budget in range(6):
        parts = pieces_of("abcdefghijklmnop", budget)
        assert len(parts) == budget + 1 and "".join(p for _, p in parts) == "abcdefghijklmnop"


def test_contaminated_equals_brute_force(spark):
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "si", "po", "den")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(60):
        text = " ".join(rnd.choice(words) for _ in range(60))
        if d % 3 == 0:
            hit = list(items[d % 12][1])
            for _ in range(rnd.randrange(0, 9)):
                k = rnd.randrange(len(hit))
                hit[k:k + 1] = rnd.choice([[], ["x"], [hit[k], "y"]])
            text = text[:100] + "\n" + "".join(hit).upper() + " " + text[100:]
        docs.append((d, text, "z"))
    docs += [(200, None, "z"), (201, "", "z"), (202, "this is a short one here", "z"), (203, "ashort onex", "z"), (None, items[0][1], "z")]
    want = set()
    for d, text, _ in docs:
        for i, t in items:
            item, whole = normal(t), normal(text)
            if item and len(item) >= 32 and edits(item, whole) <= int(0.05 * len(item)):
                want.add((d, i, edits(item, whole)))
    want.add((202, 92, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(df, bench).collect()}
    assert got == want
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(df, bench, block_chars=200).collect()} == want
    left = clean(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _, _ in docs} - {d for d, _, _ in want}
    assert contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert contaminated(spark.createDataFrame([], df.schema), bench).count() == 0


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_base_and_linking(spark):
    hexes, access = "0123456789abcdef01234567", "AKIA" + "Q7" * 8
    weak = "Zk9QmT4xLr8WvB2nYc6HsD1p"
    docs = [(1, f'é token = "{hexes}" x\npassword: abc12 SECRET=abcdef-9'), (2, f"{access} AKIAX {hexes}f"), (3, None), (4, ""),
            (5, f"user = bob\nnothing here\n\nkey material {weak}"),                 # two paragraphs: no link
            (6, f"user = bob {weak} https://db.example.org/x"), (7, f"only {weak} alone"), (8, "https://example.org alone"),
            (9, "login: ann" + " filler" * 60 + f" {weak}"),                          # too far apart
            (10, "tokſen=abcdefgh Key api_key='qwerty1'"), (None, f"api-key {access}"), (6, f"user = bob {weak} https://db.example.org/x"),
            (11, "x" * 300_000 + f" secret={hexes}")]
    df = spark.createDataFrame([(d, t, "q", 0) for d, t in docs], "doc_id long, text string, spans string, _row long")
    rows = scan_secrets(df).withColumn("txt", spans_text(F.col("spans"))).collect()
    assert len(rows) == len(docs)
    text = {d: t or "" for d, t in docs}
    for r in rows:
        assert [tuple(s) for s in r["spans"] if s["kind"] < 3] == base(text[r["doc_id"]])
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in rows}
    assert kinds[5] == [] and kinds[7] == [] and kinds[8] == [] and kinds[9] == []
    assert kinds[6] == [3, 4, 5]
    assert next(r["txt"] for r in rows if r["doc_id"] == 6).startswith("weak_id:0:10,weak_secret:11:")
    assert scan_secrets(spark.createDataFrame([], df.schema)).count() == 0


def test_automaton_matching_statistics():
    rnd = random.Random(4)
    seqs = [[rnd.randrange(4) for _ in range(rnd.randrange(3, 25))] for _ in range(6)] + [[0, 1, 2], [0, 1, 2]]
    sam = Automaton(seqs)

    def occurs(run):
        return {t for t, s in enumerate(seqs) if any(s[i:i + len(run)] == run for i in range(len(s) - len(run) + 1))}
    for _ in range(60):
        ids = [rnd.choice([0, 1, 2, 3, None]) if rnd.random() < 0.2 else rnd.randrange(4) for _ in range(40)]
        want = set()
        for t, seq in enumerate(seqs):
            def has(run):
                return None not in run and any(seq[i:i + len(run)] == run for i in range(len(seq) - len(run) + 1))
            for end in range(1, len(ids) + 1):
                size = 0
                while size < end and has(ids[end - size - 1:end]):
                    size += 1
                longer = size and end < len(ids) and has(ids[end - size:end + 1])
                if size >= 2 and not longer:
                    run = ids[end - size:end]
                    want.add((t, end, size, frozenset(i + size for i in range(len(seq) - size + 1) if seq[i:i + size] == run)))
        assert {(t, end, size, frozenset(ends)) for t, end, size, ends in sam.maximal(ids, 2)} == want


def test_chains_are_the_best_of_all():
    rnd = random.Random(8)

    def best_of_all(matches, gap):
        """Every subset in order, added up match by match."""
        best = 0
        for r in range(1, len(matches) + 1):
            for some in itertools.combinations(sorted(matches, key=lambda m: (m[1], m[0], m[2])), r):
                covered, (s, e, a) = some[0][1] - some[0][0], some[0]
                for start, end, at in some[1:]:
                    skip = max(0, e - start, a + e - s - at)
                    if not (s < start and skip < end - start and start + skip - e <= gap and at + skip - (a + e - s) <= gap):
                        break
                    covered, (s, e, a) = covered + end - start - skip, (start, end, at)
                else:
                    best = max(best, covered)
        return best
    for _ in range(150):
        at, matches = 0, []
        for _ in range(rnd.randrange(1, 8)):
            at += rnd.randrange(1, 5)
            matches.append((at, at + rnd.randrange(3, 7), rnd.randrange(0, 20)))
        end = 0
        matches = [(s, end := max(end, e), p) for s, e, p in matches]       # later starts end no earlier
        assert max(c for c, _, _ in chains(matches, 4)) == best_of_all(matches, 4)


def test_a_repeated_run_of_a_template_is_chained_at_its_right_place():
    scanner = Scanner({"t": "a b c d e f g h a b c i j k"}, {"x y z": "x"}, 3, 8, 0.6)
    starts, labels, spans = scanner.scan("e f g h q a b c q i j k".split())
    assert starts == [] and labels == set() and spans == [("t", 0, 12, 10 / 14)]
    twice = scanner.scan("a b c d e f g h a b c i j k and then a b c d e f g h a b c i j k".split())[2]
    assert [(s, e) for _, s, e, _ in sorted(twice, key=lambda s: s[1])] == [(0, 14), (16, 30)]


def test_licenses(spark):
    mit = TEMPLATES["mit"].replace("furnished to do so", "furnished so")
    docs = [(1, "Released UNDER the MIT License. x apache license, version 2.0 y CC BY-NC 4.0"), (2, "before " + mit + " after"), (3, None), (4, ""),
            (5, "the license of the software"), (6, "under the mit; license under the mit license under the mit license"),
            (7, "Apache License Version 2é"), (None, "cc by nc")]
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        words, places, labels = words_of(t), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = got[d]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), sorted(labels))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert got[2]["labels"] == ["mit"] and got[2]["score"] > 0.9 and got[2]["base_labels"] == []
    assert got[5]["labels"] == [] and got[5]["score"] == 0
    assert scan_licenses(spark.createDataFrame([], df.schema)).count() == 0


def strip(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute_lines(docs):
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= 10:
                holders.setdefault(strip(line), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(strip(x), ())) > 1 and min(holders[strip(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_docs(seed, first=0):
    rnd = random.Random(seed)
    pool = [f"{rnd.choice(['Line', ' line', 'LINE'])} number {k} ü" for k in range(40)] + ["short", "", " \t", "é" * 10, "exactly10c"]
    return [(first + d, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for d in range(60)]


def test_line_dedup_equals_brute_force(spark):
    docs = line_docs(1) + [(900, None), (901, ""), (902, "the same line\nthe same line"), (903, "The Same Line "), (903, "The Same Line ")]
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, kept string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(df).collect())
    assert got == brute_lines(docs)
    assert dedup_lines(spark.createDataFrame([], df.schema)).count() == 0


@pytest.mark.parametrize("size", [{"shards": 8}, {"shards": 2, "per_shard": 60, "per_task": 40}])
def test_line_index_is_reversible(spark, size):
    one, two = line_docs(1), line_docs(2, 100)
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (one, two))
    first = LineIndex(spark, **size).insert(a)
    both = first.insert(b)
    back = both.delete(b)

    def kept(index, df):
        return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in index.kept(df).collect())
    assert kept(both, a.unionByName(b)) == brute_lines(one + two)
    assert kept(back, a) == kept(first, a) == brute_lines(one)
    if "per_shard" in size:                      # more lines, more shards, and a large shard has several salts
        assert first.shards < both.shards
    counts = [sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in i.counts.collect()) for i in (first, back)]
    assert counts[0] == counts[1]


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)]
    f = Cuckoo.load(Cuckoo.of(keys[:3000]).dump())
    assert f.has(keys[:3000]).all() and f.has(keys[3000:]).mean() < 0.01
    for k in keys[:1500]:
        f.remove(k)
    assert f.has(keys[1500:3000]).all() and f.has(keys[:1500]).mean() < 0.01
