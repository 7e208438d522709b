"""Results of operators that SQL can't express against plain rewritings of their definitions, on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from orthant.llm import decontamination, quality_classifier, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[ \t\n\v\f\r]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def test_kept_by_quality_rules(spark):
    r = random.Random(31)
    words = ["".join(r.choices("abcdefghijk", k=r.randint(2, 9))) for _ in range(900)]
    rows = []
    for i in range(260):
        text = " ".join(r.choices(words, k=r.randint(40, 120)))
        kind = r.random()
        if kind < 0.1:
            text = text.replace("a", "#")
        elif kind < 0.2:
            text = text.upper()
        elif kind < 0.3:
            text = "\n".join([text[:100]] * r.randint(2, 6) + [text])
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["s", "t"]), 0))

    def bucket(v):
        return v if v < 128 else (v >> (v.bit_length() - 7)) << (v.bit_length() - 7)

    signals, limits = [], {}
    for i, text, lang, source, _ in rows:
        w = split(text)
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        per_mille = lambda a, b: 1000 * a // b if b else 0
        chars = sum(map(len, w))
        m = {
            "symbols": per_mille(sum(c in "#*$%&|<>" for c in text), len(w)), "dup_lines": per_mille(len(lines) - len(set(lines)), len(lines)),
            "repeats": per_mille(len(covered), len(w)), "capitals": per_mille(sum("A" <= c <= "Z" for c in text), chars), "word_length": per_mille(chars, len(w)),
        }
        signals.append((i, lang or "", source, m, len(w) < 50 or 2 * len(covered) > len(w)))
    groups = defaultdict(list)
    for _, lang, source, m, failed in signals:
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(m)

    def fence(lang, source, name):
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= 40), ())
        values = sorted(bucket(m[name]) for m in groups[key])
        q1, q3 = values[(len(values) - 1) // 4], values[3 * (len(values) - 1) // 4]
        spread = 3 * max(q3 - q1, {"symbols": 20, "word_length": 600}.get(name, 60))
        return q1 - spread, q3 + spread

    want = set()
    for i, lang, source, m, failed in signals:
        fits = all(m[n] <= fence(lang, source, n)[1] for n in m) and m["word_length"] >= fence(lang, source, "word_length")[0]
        if not failed and fits:
            want.add(i)
    got = {x.doc_id for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), min_group=40).filter("kept").collect()}
    assert got == want and 0 < len(want) < len(rows)


def passage_bigrams(words):
    """One passage's byte-pair features by the definition."""
    data = "".join(w + " " for w in words).encode()
    grams = [0.0] * quality_classifier.BIGRAMS
    for a, b in zip(data, data[1:]):
        grams[(a * 31 + b * 7) % quality_classifier.BIGRAMS] += 1
    return [math.sqrt(x / max(len(data), 1)) for x in grams]


def test_quality_scores_follow_from_features_and_weights(spark):
    r = random.Random(32)
    words = ["".join(r.choices("abcdefgh.,!", k=r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 5, 63, 64, 65, 128, 200, 700)] + ["", "\n"]
    model = quality_classifier.AttentionModel(seed=3)
    model.mean, model.scale = np.full(quality_classifier.WIDTH, 0.1), np.full(quality_classifier.WIDTH, 0.5)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.score for x in quality_classifier.score(docs, model).collect()}
    p = model.p
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, text in enumerate(texts):
        x, bags = quality_classifier.passages([text.encode()])
        w = split(text)
        assert bags[0] == max(1, -(-len(w) // 64)) == len(x)
        for k, row in enumerate(x):  # the features by definition
            own = w[64 * k : 64 * k + 64]
            if not own:
                assert not row.any()
                continue
            assert np.allclose(row[: quality_classifier.BIGRAMS], passage_bigrams(own), atol=1e-5)
            data = "".join(v + " " for v in own).encode()
            assert abs(row[quality_classifier.BIGRAMS] - 3 * sum(c == 32 or 97 <= c <= 122 for c in data) / len(data)) < 1e-5  # class 0
            dense = row[quality_classifier.BIGRAMS + 9 :]
            mean = sum(map(len, own)) / len(own)
            seen = w[: 64 * k]
            triples = [tuple(w[max(0, j - 2) : j + 1]) if j >= 2 else (k, j, w[j]) for j in range(len(w))]
            again = [j >= 2 and triples[j] in triples[2:j] for j in range(64 * k, 64 * k + len(own))]
            want = [mean / 10, math.sqrt(max(sum(len(v) ** 2 for v in own) / len(own) - mean**2, 0)) / 10]
            assert np.allclose(dense[:2], want, atol=1e-5) and abs(dense[10] - len(own) / 64) < 1e-6
            same = sum(a == b for a, b in zip([*seen[-1:], *own], own if seen else own[1:])) / len(own)
            assert abs(dense[2] - same) < 1e-5 and abs(dense[3] - sum(again) / len(own)) < 1e-5 and abs(dense[4] - len(set(own)) / len(own)) < 1e-5
            share = lambda f: sum(map(f, own)) / len(own)
            ends = [share(lambda v: v[0].isupper()), share(lambda v: v[-1] == "."), share(lambda v: v[-1] in "!?")]
            assert np.allclose(dense[5:8], ends, atol=1e-5)
            assert np.allclose(dense[11:13], [share(lambda v: len(v) <= 2), share(lambda v: len(v) >= 15)], atol=1e-5)
        weights, states = [], []
        for row in x.astype(float):
            z = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(sum(a * b for a, b in zip(z, p["W"][:, j])) + p["b"][j]) for j in range(len(p["b"]))]
            gate = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, j]))) * sigmoid(sum(a * b for a, b in zip(h, p["U"][:, j]))) for j in range(len(p["a"]))]
            weights.append(math.exp(sum(a * b for a, b in zip(gate, p["a"]))))
            states.append(h)
        mixed = [sum(wt * s[j] for wt, s in zip(weights, states)) / sum(weights) for j in range(len(p["b"]))]
        assert abs(got[i] - sigmoid(sum(a * b for a, b in zip(mixed, p["c"])) + p["d"][0])) < 1e-6


def test_toxicity_scores_follow_from_marginals(spark):
    r = random.Random(33)
    words = ["".join(r.choices("abcde", k=4)) for _ in range(40)]
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 6, 9)] + [None, ""]
    model = toxicity.ChainTagger()
    rng = np.random.default_rng(1)
    model.weights, model.bias = rng.standard_normal(toxicity.FEATURES), -0.5
    model.transition, model.prior, model.calibration = rng.standard_normal((2, 2)), rng.standard_normal(2), np.array([0.3, 0.7, -0.4, 1.1])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for row in toxicity.score(docs, model).collect():
        w = split(texts[row.doc_id])
        e = [model.emission(x.encode()) for x in w]
        forward, backward = [], [[1.0, 1.0]]
        for i, x in enumerate(e):
            emit = [1.0, math.exp(x)]
            before = [math.exp(v) for v in model.prior] if not i else [sum(forward[-1][a] * math.exp(model.transition[a, b]) for a in (0, 1)) for b in (0, 1)]
            forward.append([b * m for b, m in zip(before, emit)])
        for x in e[:0:-1]:
            emit = [1.0, math.exp(x)]
            backward.insert(0, [sum(math.exp(model.transition[a, b]) * emit[b] * backward[0][b] for b in (0, 1)) for a in (0, 1)])
        p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward)]
        top = [min(max(v, 1e-3), 1 - 1e-4) for v in (sorted(p, reverse=True) + [0, 0])[:2]]
        c = model.calibration
        z = c[0] + sum(k * math.log(v / (1 - v)) for k, v in zip(c[1:], top)) + c[3] * math.log1p(sum(v for v in p if v >= 0.05))
        assert abs(row.score - 1 / (1 + math.exp(-z))) < 1e-4 and row.predicted == (row.score >= 0.3)
        text = (texts[row.doc_id] or "").encode()
        assert [text[s.start : s.end].decode() for s in row.spans] == [x for x, v in zip(w, p) if v >= 0.5]


UNITS = set(decontamination.UNITS)


def readings(text):
    """(plain word, kind of placeholder or None, slot value, opens a sentence with a capital) of each word of a text."""
    out, opens = [], True
    for match in re.finditer(r"[^ \t\n\v\f\r]+", text or ""):
        word = match.group()
        plain = "".join(c for c in word.lower() if c.isdigit() or c.isalpha() or ord(c) >= 128)
        first = word[0]
        kind = "number" if any(c in "0123456789" for c in word) else "name" if first.isupper() and not opens else "unit" if plain in UNITS else None
        if plain:
            value = word.lower().strip(".,;:!?\"'()[]{}")
            out.append((plain, kind, value, first.isupper() and opens and not any(c in "0123456789" for c in word)))
        opens = word[-1] in ".!?:;\"" or text[match.end() : match.end() + 1] == "\n"
    return out


def windows(words, width):
    """(kind, place, key, slot values) of all windows of a width, by every reading of opening words."""
    need = max(1, min(decontamination.SOLID, width - 1))
    for at in range(len(words) - width + 1):
        part = words[at : at + width]
        yield "exact", at, tuple(w[0] for w in part), [w[2] for w in part if w[1] == "number"]
        opening = [i for i, w in enumerate(part) if w[3]]
        for mask in range(1 << len(opening)):
            named = {opening[b] for b in range(len(opening)) if mask >> b & 1}
            kinds = ["name" if i in named else w[1] for i, w in enumerate(part)]
            if sum(k is None for k in kinds) >= need:
                yield ("named" if named else "plain"), at, tuple(k and (k,) or w[0] for k, w in zip(kinds, part)), [w[2] for k, w in zip(kinds, part) if k]


def brute_matches(docs, items):
    found = set()
    for item_id, item in items:
        own = readings(item)
        width = min(len(own), decontamination.WINDOW)
        if not width:
            continue
        known, total = defaultdict(list), len(own) - width + 1
        plain_total = len({at for kind, at, _, _ in windows(own, width) if kind == "plain"})
        for kind, at, key, slots in windows(own, width):
            known[kind == "exact", key].append((kind, at, slots))
        for doc_id, text in docs:
            diagonals = defaultdict(list)
            for kind, at, key, slots in windows(readings(text), width):
                for item_kind, item_at, item_slots in known[kind == "exact", key]:
                    if kind != "exact" or slots == item_slots:
                        diagonals[at - item_at].append((max(kind, item_kind, key=["plain", "named", "exact"].index), item_at, list(zip(item_slots, slots))))
            for rows in diagonals.values():
                count = lambda kinds: len({at for k, at, _ in rows if k in kinds})
                pairs = lambda kinds: {p for k, _, ps in rows if k in kinds for p in ps}
                steady = lambda kinds: len(pairs(kinds)) == len({a for a, _ in pairs(kinds)})
                enough = lambda n, of: n > 0 and n >= min(of, decontamination.RUN)
                typed = {"plain", "named"}
                if (
                    enough(count({"plain"}), plain_total) and steady({"plain"})
                    or (enough(count(typed), plain_total) or enough(count(typed | {"exact"}), total)) and steady(typed)
                    or enough(count({"exact"}), total)
                ):
                    found.add((doc_id, item_id))
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(34)
    plain = "apple bag walks old market sleeps big house sings three cats river stone under takes gives".split()
    names = "Alice Bob Carol Dave Eve Frank".split()

    def sentence():
        words = [r.choice(plain) if r.random() < 0.7 else r.choice([r.choice(names), str(r.randint(1, 40)), r.choice(["km", "days"])]) for _ in range(r.randint(4, 12))]
        words[0] = r.choice(names) if r.random() < 0.4 else words[0].capitalize()
        return " ".join(words) + r.choice([".", "?", "."])

    items = [(i, " ".join(sentence() for _ in range(r.randint(1, 4)))) for i in range(14)]

    def changed(text):
        swap = dict(zip(names, r.sample(names, len(names))))
        step = r.randint(0, 9)
        text = re.sub(r"\b[A-Z][a-z]+\b", lambda m: swap.get(m.group(), m.group()), text)
        return re.sub(r"\d+", lambda m: str(int(m.group()) + step), text)

    docs = []
    for i in range(70):
        parts = [sentence() for _ in range(r.randint(0, 4))]
        if i % 2:
            item = r.choice(items)[1]
            item = r.choice([item, changed(item), item[: len(item) // 2], item.replace("apple", "pear", 1), re.sub(r"\d+", lambda m: str(r.randint(1, 40)), item)])
            parts.insert(r.randint(0, len(parts)), item)
        docs.append((i, " ".join(parts)))
    got = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == brute_matches(docs, items)


def test_reparameterised_items_are_found(spark):
    """Recall of items whose numbers, names and units are changed, hidden in prose of the test tables' kind."""
    r = random.Random(35)
    words = ["".join(r.choices(["th", "an", "er", "ou", "st", "le", "re"], k=r.randint(1, 4))) for _ in range(400)]
    names = [w.capitalize() for w in r.sample(words, 40)]

    def question():
        slots = []
        text = []
        for i in range(r.randint(16, 40)):
            kind = r.random()
            if kind < 0.12:
                slots.append(("number", str(r.randint(2, 99))))
            elif kind < 0.22:
                slots.append(("name", r.choice(names)))
            elif kind < 0.27:
                slots.append(("unit", r.choice(["km", "kg", "hours", "dollars"])))
            else:
                text.append(r.choice(words).capitalize() if i % 9 == 0 else r.choice(words) + ("." if i % 9 == 8 else ""))
                continue
            text.append(f"{{{len(slots) - 1}}}")
        return " ".join(text), slots

    items, docs, planted = [], [], set()
    for i in range(150):
        shape, slots = question()
        first = {v: v for _, v in slots}
        other = {v: {"number": str(r.randint(100, 999)), "name": r.choice(names), "unit": r.choice(["miles", "days", "euros"])}[k] for k, v in slots}
        items.append((i, shape.format(*(first[v] for _, v in slots))))
        prose = " ".join(r.choices(words, k=80))
        docs += [(2 * i, f"{prose}. {shape.format(*(other[v] for _, v in slots))} {prose}"), (2 * i + 1, " ".join(r.choices(words, k=150)))]
        planted.add(2 * i)
    got = {x.doc_id for x in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("re-parameterised items found:", len(got & planted), "of", len(planted), "; clean documents flagged:", len(got - planted))
    assert len(got & planted) >= 0.9 * len(planted) and not got - planted


def test_toxic_documents_held_out_in_the_tables(spark):
    from test_llm import TABLES, labelled

    if not TABLES.exists():
        return
    _, labels, d = labelled(spark, "sf0.1")
    rows = toxicity.query(spark, d).filter("held_out").join(labels.select("doc_id", F.col("toxic")), "doc_id").collect()
    toxic, clean = [x for x in rows if x.toxic == 1], [x for x in rows if x.toxic == 0]
    assert sum(x.predicted for x in toxic) >= 0.9 * len(toxic) and sum(x.predicted for x in clean) <= 0.02 * len(clean)
    assert all(x.spans for x in toxic if x.score > 0.9)
