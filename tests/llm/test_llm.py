"""The training-text operators against brute force, round trips and libraries, on small tables with awkward rows."""

import itertools
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orthant.llm import chat_format, components, decontamination, license_rules, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash_dedup, token_counts, toxicity

TABLES = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, wide characters; an extra column with a name used inside."""
    r = random.Random(1)
    syllables = ["ka", "to", "mi", "re", "sol", "né", "漢", "und"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(words, k=n)) + "."
    texts = [None, "", " \n\t", "one", "a b c", "same line\nsame line\n\nsame line", prose(5000), "x" * 20_000, "a b c", "1 2 3\r\n4\x0b5"]
    base = prose(120)
    texts += [base, base, base.replace(words[0], "other", 1), base + " end", *(prose(r.randint(1, 90)) for _ in range(30))]
    rows = [(i, t, "en" if i % 3 else None, "s0" if i % 2 else "s1", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], (None, "no id at all", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("taken")).withColumn("key", F.lit(1)).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_signals(spark, odd):
    def brute(text):
        w = split(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n")]
        dup = sum(1 for i, x in enumerate(lines) if split(x) and x in lines[:i])
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)

    extra = spark.createDataFrame([(900, "a b c a b c a b c # <x>", "en", "s", 1), (901, "l\nl\n \n \nl", "en", "s", 1)], DOCS)
    docs = odd.drop("score", "key").unionByName(extra)
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    found = quality_rules.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_quantile_sketch_is_close_and_merges(spark):
    r = random.Random(2)
    values = {("en", "a"): [int(r.paretovariate(1) * 50) for _ in range(500)], ("en", "b"): [r.randint(0, 100_000) for _ in range(400)]}
    rows = [(k[0], k[1], *([v] * 5)) for k, vs in values.items() for v in vs]
    sketch = quality_rules.sketches(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in quality_rules.METRICS)))
    for keys, wanted in ((("lang", "source"), values), (("lang",), {("en",): sum(values.values(), [])})):
        for row in quality_rules.quartiles(sketch, *keys).filter("metric = 'symbols'").collect():
            v = sorted(wanted[tuple(row[k] for k in keys)])
            for q, got in ((1, row.q1), (3, row.q3)):
                exact = v[(len(v) - 1) * q // 4]
                assert got <= exact <= got * (1 + 1 / 64) + 1


def test_adaptive_thresholds_reject_outliers(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(4000)]
    rows = [(i, " ".join(r.sample(words, 80)), "en", "s", 0) for i in range(150)] + [(200, " ".join(w + "###" for w in r.sample(words, 80)), "en", "s", 0)]
    kept = {x.doc_id for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).filter("kept").collect()}
    assert kept == set(range(150))


def test_attention_gradients():
    r = np.random.default_rng(4)
    m = quality_classifier.AttentionModel(5, 3)
    x, bags, y = r.standard_normal((9, quality_classifier.WIDTH)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-np.mean(y * np.log(m.score(x, bags)) + (1 - y) * np.log(1 - m.score(x, bags))))
    g = m.gradients(x, bags, m.forward(x, bags), y)
    for name in m.p:
        at = tuple(0 for _ in m.p[name].shape)
        held = m.p[name][at]
        m.p[name][at] = held + 1e-5
        up = loss()
        m.p[name][at] = held - 1e-5
        down = loss()
        m.p[name][at] = held
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6


def labelled(spark, sf="sf0.01"):
    d = TABLES.parent / sf
    return spark.read.parquet(str(d / "documents.parquet")), spark.read.parquet(str(d / "labels.parquet")), str(d)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_quality_classifier_on_held_out_rows(spark, odd):
    _, labels, d = labelled(spark)
    rows = quality_classifier.query(spark, d).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    scored = quality_classifier.score(odd.select("doc_id", "text"), None)
    assert scored.count() == odd.count() and {r.score for r in scored.collect()} == {0.5}
    docs = odd.select("doc_id", "text")
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, few, F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, model).collect())


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(5)
    e, t, q = r.standard_normal(11), r.standard_normal((2, 2)), r.standard_normal(2)
    starts = np.array([0, 5, 6])
    got, pairs = toxicity.marginals(e, starts, t, q, True)
    want, joint = np.zeros(11), np.zeros((2, 2))
    for a, b in zip(starts, [*starts[1:], 11]):
        total, ones, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=b - a):
            w = np.exp(q[tags[0]] + sum(t[i, j] for i, j in zip(tags, tags[1:])) + sum(x for x, k in zip(e[a:b], tags) if k))
            total += w
            ones += w * np.array(tags)
            for i, j in zip(tags, tags[1:]):
                two[i, j] += w
        want[a:b] = ones / total
        joint += two / total
    assert np.allclose(got, want, atol=1e-9) and np.allclose(pairs, joint, atol=1e-9)


def test_long_chain_stays_finite():
    p = toxicity.marginals(np.full(100_000, -20.0), np.array([0, 70_000]), np.array([[2.0, -2], [-2, 2]]), np.zeros(2))
    assert np.isfinite(p).all() and p.max() < 1e-3


def test_toxic_spans(spark, odd):
    r = random.Random(6)
    clean = ["".join(r.choices("abcde", k=4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        words, toxic = r.choices(clean, k=30), i % 3 == 0
        if toxic:
            words[r.randint(0, 29)] = r.choice(["grumok", "grumoks!", "zorbel"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") < 200)
    found = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(found[i].predicted == labels[i][2] for i in range(200, 300))
    text = rows[210][1].encode()
    assert any(text[s.start : s.end].startswith((b"grum", b"zorb")) for s in found[210].spans)
    assert toxicity.score(odd, model).count() == odd.count()
    assert {x.score for x in toxicity.score(odd, None).collect()} == {0.5}
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True)) is None


def test_fingerprints(spark, odd):
    def brute(text):
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [r.text for r in odd.collect()] + ["Ab cD " * 70_000]
    assert simhash_dedup.fingerprints([(t or "").encode() for t in texts]).tolist() == [brute(t) for t in texts]


def test_golay_keys_reach_all_links():
    r = np.random.default_rng(7)
    for exact, k in itertools.product((1, 2, 3), (0, 1, 2, 3, 4)):
        for _ in range(60):
            x = int(r.integers(0, 2**64, dtype=np.uint64))
            y = x
            for i in r.choice(64, k, replace=False):
                y ^= 1 << int(i)
            row, key = simhash_dedup.fuzzy_keys(np.array([x, y], np.uint64), exact)
            assert set(key[row == 0]) & set(key[row == 1])


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_components_equal_brute_force(spark, odd, monkeypatch):
    found = simhash_dedup.simhash_components(odd)
    rows = found.collect()
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows if r.doc_id is not None}
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert len(rows) == odd.count() and {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    kept = [r.doc_id for r in simhash_dedup.keep_first(odd).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert simhash_dedup.simhash_components(empty(spark)).count() == 0


def test_links_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CHUNK", 8)
    r = random.Random(8)
    center = r.getrandbits(64)
    prints = {center}
    while len(prints) < 120:
        x = r.choice(sorted(prints)) if r.random() < 0.9 else r.getrandbits(64)
        for i in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << i
        prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    links = simhash_dedup.print_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = groups(signed, [(r.u, r.v) for r in links.collect()])
    assert got == groups(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 6)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_line_dedup(spark, odd):
    long = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [
        (1, f"alpha beta gamma delta\nuser 17 logged in from 10.0.0.1 today\nshort\n{long}", "a", "s", 1), (2, f"own words of two here\nuser 99 logged in from 10.9.9.9 today\nshort\n{long}", "a", "s", 1),
        (3, "alpha  beta gamma delta\n\nthe quick brown fox jumps over the lazy cat beside the river bank", "a", "s", 1), (4, "the quick brown fox jumps over the lazy cow by the river bank", "a", "s", 1),
        (5, None, "a", "s", None), (6, "", "a", "s", 0), (7, "all of this is only here twice", "a", "s", 1), (7, "all of this is only here twice", "a", "s", 1),
    ]
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect())
    want = [(1, rows[0][1]), (2, "own words of two here\nshort"), (3, "\nthe quick brown fox jumps over the lazy cat beside the river bank"), (5, None), (6, ""), (7, rows[6][1]), (7, rows[6][1])]
    assert all(got[x] == want.count(x) for x in want if x[0] != 3) and sum(got.values()) == 8
    assert not any(d == 3 and t.startswith("alpha") for d, t in got if t)
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines_dropped"] and out.count() == odd.count()
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_of_short_lines(spark):
    own = ["ten", "two", "six", "one", "red", "sun", "sea", "sky"]
    texts = [f"All rights reserved.\nHome\n\nPage {i} of\n{i}\n7\nown line {w}" for i, w in enumerate(own)]
    docs = [(i, t, "a", "s", 1) for i, t in enumerate(texts)] + [(8, "Share this\nHome page", "a", "s", 1), (9, "Share this", "a", "s", 1)]
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    want = {i: (f"\n{i}\nown line {w}", 4) for i, w in enumerate(own)} | {0: (texts[0], 0), 7: ("\nown line sky", 5), 8: (docs[8][1], 0), 9: (docs[9][1], 0)}
    assert got == want
    few = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs[8:], DOCS), min_short=2).collect()}
    assert few == {8: docs[8][1], 9: ""}


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_line_dedup_equals_brute_force(spark):
    docs, _, _ = labelled(spark, "sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    where = {}
    for d, text in texts.items():
        for line in text.split("\n"):
            t = split(line)
            masked = ["<*>" if any(c in "0123456789@" for c in w) or "//" in w else w for w in t]
            keys = [(0, *masked)] if len(t) >= 4 else []
            if len(t) >= 9:
                cuts = [2 + (len(t) - 2) * k // 3 for k in range(4)]
                keys += [(k + 1, len(t), *masked[: cuts[k]], "|", *masked[cuts[k + 1] :]) for k in range(3)]
            for key in keys:
                where.setdefault(key, set()).add(d)
            where.setdefault(("keys", line), set()).update(keys)
    def gone(d, line):
        return any(len(where[k]) >= (3 if k[0] else 2) and d > min(where[k]) for k in where[("keys", line)])
    want = {d: "\n".join(x for x in text.split("\n") if not gone(d, x)) for d, text in texts.items()}
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


def test_license_scan(spark, odd):
    rules = license_rules.rules()
    assert len({r.pattern.pattern for r in rules}) == len(rules) > 300
    for r in rules:  # a keyword lies outside of all groups, so each match has it
        fixed = r.pattern.pattern[len(r"(?<!\S)(?:") : -len(r")(?!\S)")]
        while "(" in fixed:
            fixed = re.sub(r"\([^()]*\)\??", " ", fixed)
        assert "|" not in fixed and r.keyword in fixed.split(), r
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

    def brute(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or ord(c) >= 128 else " " for c in low).split(" ")
        w = [x for x in w if x]
        hits = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    more = ["Licensed under the Apache License, Version 2.0. See the MIT License; MIT\nLicense", "CC BY-NC 4.0 and cc by.cc by", "GNU GPL, gnu general public license version 3 gnu General Public LICENSE", "emit license", "All rights reserved."]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 500)), "doc_id long, text string"))
    found = license_scan.license_scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    labels = {r.doc_id: r.labels for r in found}
    assert labels[500] == "apache,apache-2.0,mit" and labels[501] == "cc-by,cc-by-nc-4.0" and labels[503] == "" and labels[504] == "proprietary"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_overlapping_license_detections(spark):
    s = license_scan.Scanner()
    text = "this work is licensed under the gnu general public license version 3 or later"
    assert [s.rules[i].label for _, _, i in s.detections(text)] == ["gpl-3.0-or-later"]
    r = random.Random(13)
    parts = ["gnu", "general", "public", "license", "version", "2", "or", "later", "apache", "0", "mit", "cc", "by", "nc", "the", "bsd", "3", "clause", "under"]
    for _ in range(300):
        joined = " ".join(r.choices(parts, k=r.randint(1, 40)))
        each = sorted((p.priority, m.start() - m.end(), m.start(), m.end(), i) for i, p in enumerate(s.rules) for m in p.pattern.finditer(joined))
        want = []
        for _, _, a, b, i in each:
            if not any(x <= a and b <= y or a <= x and y <= b for x, y, _ in want):
                want.append((a, b, i))
        assert s.detections(joined) == sorted(want)


def test_decontamination(spark, odd):
    item = "On Monday Alice bought 12 apples and 7 pears at the market for 30 dollars, then she walked 4 km home with a heavy bag."
    items = spark.createDataFrame([(1, item), (2, "What is nine plus five really"), (3, None), (4, "")], "item_id long, text string")
    other = item.replace("Alice", "Zoe").replace("12", "55").replace("dollars", "euros")
    clash = item.replace("12 apples", "30 apples")  # 12 -> 30 only, while 30 stays: still one value for each
    rows = [(1, f"Some words first. {item} And more."), (2, f"x y z. {other} q"), (3, "nothing to see here at all, just words that go on for a while"), (4, "well, what is nine plus five really?"), (5, clash), (6, None), (7, ""), (8, item[40:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contaminated(docs, items).collect()) == [1, 2, 4, 5, 8]
    repeated = spark.createDataFrame([(1, "Take 5 red balls and 5 blue balls, put all 5 of them into the old box under the table.")], "item_id long, text string")
    mixed = spark.createDataFrame([(1, "Take 6 red balls and 8 blue balls, put all 9 of them into the old box under the table."), (2, "Take 6 red balls and 6 blue balls, put all 6 of them into the old box under the table.")], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(mixed, repeated).collect()] == [2]
    left = decontamination.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(empty(spark), items).count() == 0


def test_decontamination_of_names_that_open_sentences(spark):
    apples = "Alice has 5 red apples in a bag. Bob gives her 3 more of them. Carol takes 2 apples from the bag. How many apples are left?"
    norway = "What is the capital city of the kingdom of Norway called today?"
    short = "Alice walks to the old market. Bob sleeps in the big house. Carol sings for the three cats."
    items = spark.createDataFrame([(1, apples), (2, norway), (3, short)], "item_id long, text string")
    renamed = apples.replace("Alice", "Zoe").replace("Bob", "Yan").replace("Carol", "Xia")
    rows = [
        (1, renamed.replace("has 5", "has 9")), (2, f"Teachers often ask: {renamed}"), (3, f"They asked What is{norway[7:]} Nobody knew."), (4, f"so {norway[0].lower()}{norway[1:]}"),
        (5, short.replace("Alice", "Zoe").replace("Bob", "Yan").replace("Carol", "Xia")), (6, "Zoe has a red bag in which apples are. Yan takes her bag. How many apples are in the old house?"),
        (7, f"we know that {renamed}"), (8, apples), (9, "The three cats sing. The old market is in the big house. The kingdom has a city."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (7, 1), (8, 1)]


def test_decontamination_of_items_of_placeholders(spark):
    table = "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60 63"
    texts = ["What is 17 + 25?", "17 25 42 3.5 99", "ask Alice Bob Carol Dave Eve Frank Grace Heidi Ivan", table, "Antidisestablishmentarianism!", "3 km 5 kg", "+ -"]
    items = spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")
    rows = [
        (1, "The first task: what is 17 + 25? Tell us."), (2, "What is 18 + 25?"), (3, "numbers 17, 25, 42, 3.5, 99 in a row"), (4, "17 25 42 35 99"), (5, "17 25 42 99 3.5"),
        (6, "They ask Alice Bob Carol Dave Eve Frank Grace Heidi Ivan daily"), (7, "ask Zoe Yan Xia Will Vic Una Tom Sue Rob"), (8, f"a {table} b"), (9, table.replace("39", "40")),
        (10, "it was antidisestablishmentarianism, no more"), (11, "walk 3 km with 5 kg"), (12, "it is 3 km 5 kg then"), (13, "+ - +"), (14, "ask alice bob carol dave eve frank grace heidi ivan"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()) == [(1, 1), (3, 2), (6, 3), (8, 4), (10, 5), (12, 6), (14, 3)]


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_decontamination_finds_the_planted_passages(spark):
    docs, _, d = labelled(spark)
    items = [r.text for r in spark.read.parquet(d + "/benchmark.parquet").collect()]
    planted = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    assert planted <= {r.doc_id for r in decontamination.query(spark, d).collect()}


def test_differencing():
    r = np.random.default_rng(9)
    for n, k in ((1, 3), (7, 3), (40, 5), (200, 20)):
        sizes = r.integers(1, 300, n)
        w = packing.differencing(sizes, k)
        sums = np.bincount(w, sizes, k)
        assert w.max() < k and sums.sum() == sizes.sum() and (n < 40 or sums.max() - sums.min() <= 20)
    assert np.bincount(packing.windows(np.array([600] * 5)), [600] * 5).max() <= 1024
    textbook = np.array([8, 7, 6, 5, 4])  # differencing leaves a difference of 2
    assert sorted(np.bincount(packing.differencing(textbook, 2), textbook, 2).tolist()) == [14, 16]


def test_packing_round_trip(spark, odd):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    more = ["a <|endoftext|> b", "two  spaces \n x", " lead", "trail ", "　x 　y"]
    docs = odd.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(list(enumerate(more, 500)), "doc_id long, text string")).coalesce(2)
    rows = packing.pack(docs, packing.default_path(), 16).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    for d, own in ids.items():
        at = 0
        for p in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *own[at : at + p.length]))
            at += p.length
        assert at == len(own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(empty(spark), packing.default_path()).count() == 0


def test_token_counts_equal_the_library(spark, odd):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    counter = token_counts.Counter(token_counts.default_path())
    r = random.Random(10)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "😀", "x", "12", ".", "<s>", "▁", "<0x41>", "    ", "ing", "\x00", " ", "I'm", "tion"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(500)] + [" " * n + "xthe" for n in range(40)] + ["x" * 40_000, " x" * 20_000, "ab" * 9000 + " " + "cd" * 9000]
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    rows = token_counts.token_counts(odd, token_counts.default_path(), 100).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in rows) == Counter((x.doc_id, len((x.text or "").encode()), n := len(library.encode(x.text or "")), n > 100) for x in odd.collect())


def test_chunk_maps_compose(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    counter = token_counts.Counter(token_counts.default_path())
    r = random.Random(11)
    texts = ["".join(r.choices(["ab", " ", "  ", "     ", "the", "ing", "é", "x" * 9], k=200)) for _ in range(6)]
    texts += ["".join(r.choices("abcdeinorst", k=900)), " " * 300 + "the", "the" + " " * 300, "漢" * 50, *(" " * n + w for n in range(2, 40) for w in ("the", "x", "ing"))]
    for size in (1, 3, 7, 50, 1 << 14):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]
    marked = "▁" + texts[0].replace(" ", "▁")
    maps = [token_counts.ChunkMap(counter, marked[i : i + 5]) for i in range(0, len(marked), 5)]
    want = token_counts.scan(maps)(counter.start)
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = token_counts.Composed(left, m)
    for m in maps[-2::-1]:
        right = token_counts.Composed(m, right)
    states = [counter.start, *(m.usual[0] for m in maps)]
    assert left(counter.start) == right(counter.start) == want and all(left(s) == right(s) for s in states)


def test_a_full_transducer_starts_anew(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    counter = token_counts.Counter(token_counts.default_path())
    text = "".join(random.Random(12).choices("abcdeinorst ", [1] * 11 + [0.01], k=60_000))
    assert counter.count(text) == len(library.encode(text)) and len(counter.machine.states) < 50 + token_counts.CHUNK


CHATS = "conv_id long, turn long, role string, text string"


def test_chats(spark):
    long = [(9, i, "user", f"m{i}") for i in range(600)]
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, None, None, None), (5, 0, "user", "x"), (None, 0, "user", "lost"), (6, 5, "user", "hi"), (6, 6, "assistant", "hello"), (6, 6, "assistant", "hello"), *long, *((8, *x[1:]) for x in long[:300]),
    ]
    df = spark.createDataFrame(rows, CHATS).withColumn("place", F.lit(0)).withColumn("h1", F.lit(0))
    out = chat_format.format_chats(df).collect()
    assert sorted({(r.conv_id, r.n_turns) for r in out}) == [(2, 3), (3, 2), (5, 2), (9, 600)]
    texts = {(r.conv_id, r.block): r.text for r in out}
    assert texts[3, 0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n" and texts[5, 0].startswith("<|im_start|>user\n<|im_end|>\n")
    assert "".join(texts[9, b] for b in range(3)) == "".join(f"<|im_start|>user\nm{i}<|im_end|>\n" for i in range(600))
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as pipeline

    d, docs = str(TABLES), spark.read.parquet(str(TABLES / "documents.parquet"))
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == ids
            break
        assert out.columns == docs.columns
        out = pipeline.materialize(out, "test")
        now = {r.doc_id for r in out.collect()}
        assert now <= ids and len(now) > 0.5 * len(ids) and (name != "line_dedup" or now == ids)
        docs, ids = out, now
    assert {r.doc_id for r in pipeline.run(spark, d).collect()} == ids
