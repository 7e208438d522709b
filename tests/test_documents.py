"""Texts, names, the document store and the completion service, with worked values."""

import json
import random
import re
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from orthant.functions import text as t
from orthant.model import embedding, server
from orthant.operators import documents, vectors
from orthant.sources import model_file, points, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_words_and_keywords(spark):
    text = "The don't-stop DON'T; and About cat's a1 xx Which cats, cats café"
    assert one(spark, t.words(F.lit(text))) == ["the", "don't", "stop", "don't", "and", "about", "cat's", "a1", "xx", "which", "cats", "cats", "caf"]
    assert one(spark, t.keywords(F.lit(text))) == ["don't", "stop", "cat's", "cats", "caf"]
    many = " ".join(f"word{i}" for i in range(300))
    assert one(spark, t.keywords(F.lit(many))) == [f"word{i}" for i in range(200)]
    assert len(t.STOP_WORDS) == len(set(t.STOP_WORDS)) == 37 and len(set(t.SEPARATORS)) == 26
    assert one(spark, t.overlap(t.words(F.lit("a b a z")), t.words(F.lit("A c")))) == 0.5
    assert one(spark, t.overlap(t.words(F.lit("")), t.words(F.lit("a")))) == 0 and one(spark, t.overlap(t.words(F.lit("a")), t.words(F.lit("")))) == 0


def brute_chunks(text, size):
    if len(text) <= size:
        return [text]
    out, now = [], ""
    for part in re.split(r"\n\s*\n", text):
        if len(now) + len(part) > size and now:
            out.append(now)
            now = ""
        now += ("\n\n" if now else "") + part
    return out + ([now] if now else [])


@pytest.mark.parametrize("text", ["short", "", "\n\n" + "a" * 30, "a" * 30 + "\n\n", "ab\n \ncd\n\nef" + "x" * 20 + "\n\n\n\ngh", "x" * 50 + "\n\n" + "y" * 5 + "\n\nz", "\n\n\n\n" * 9])
def test_chunks(spark, text):
    for size in (3, 10, 24):
        assert one(spark, t.chunks(F.lit(text), size)) == brute_chunks(text, size)


def test_names_and_roles(spark):
    want = {
        "Art Prompts.txt": ("prompts", "art_promptstxt"), "Glossary.txt": ("universe", "glossarytxt"), "Old Lore.md": ("universe", "old_loremd"), "npc list.txt": ("characters", "npc_listtxt"),
        "location.md": ("locations", "locationmd"), "World Map.md": ("locations", "world_mapmd"), "Plot outline.txt": ("reference", "plot_outlinetxt"), "Brennan-Yee's Öl!": ("reference", "brennanyees_l"),
    }
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", t.role(F.col("n")).alias("r"), t.safe_name(F.col("n")).alias("s")).collect()
    assert {r.n: (r.r, r.s) for r in rows} == want
    assert one(spark, t.prompt_file_name(F.lit(7), F.lit("First Light"))) == "prompt_07_first_light"
    assert one(spark, t.lora_tag(F.lit("Ink"), F.lit(0.75))) == "<lora:Ink:0.8>" and one(spark, t.lora_tag(F.lit(""), F.lit(0.8))) is None
    found = t.proper_nouns(F.lit("Zoe met Brennan-Yee; Zoe and Zoes (x.y) left"), ["Brennan-Yee", "Zoe", "x.y", "met"])
    assert one(spark, found) == ["Zoe", "met", "Brennan-Yee", "x.y"]


def test_hash_embedding(spark):
    def djb2(token):
        h = 5381
        raw = token.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h * 33) & 0xFFFFFFFF) ^ int.from_bytes(raw[i : i + 2], "little")
        return abs(h - (1 << 32) if h >> 31 else h)

    texts = ["Get value(x): return x;", "get Value", "", None, " .,", "日本 😀smile", "a" * 5000, "x|y@z"]
    rows = t.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 64, 5).collect()
    for r in rows:
        want = {}
        for token in re.split("[" + re.escape(t.SEPARATORS) + "]", r.text or ""):
            if token:
                want[djb2(token) % 64] = want.get(djb2(token) % 64, 0) + 5
        assert [tuple(x) for x in r.e] == (sorted(want.items()) or [(0, 1)])
    with pytest.raises(ValueError):
        t.hash_embedding(spark.createDataFrame([("a",)], "text string"), 7)


def test_context_joins_trimmed_chunks(spark):
    docs = spark.createDataFrame([("a", "red apple\n\n" + "x " * 140 + "red\n"), ("b", " red \n"), ("c", "nothing")], "doc string, text string")
    best = documents.relevance(docs, "Red apple", 5)
    rows = best.collect()
    assert [(r.doc, r.chunk_no) for r in rows][0] == ("a", 0) and all(r.chunk == r.chunk.strip() for r in rows)
    assert documents.context(best, 400).startswith("red apple\n\nx") and documents.context(best, 400).endswith(" red red") and documents.context(best, 0) == ""


def test_ingest_reads_what_changed(spark, tmp_path):
    (tmp_path / "npc one.txt").write_text("Brave captain sails " * 40)
    (tmp_path / "b.md").write_text("world")
    (tmp_path / "c.bin").write_text("no text")
    first = spark.createDataFrame(documents.ingest(spark, str(tmp_path), None).collect(), documents.INDEX)
    rows = {r.file_name: r for r in first.collect()}
    assert set(rows) == {"npc one.txt", "b.md"} and rows["npc one.txt"].role == "characters" and len(rows["npc one.txt"].summary) == 500
    assert rows["npc one.txt"].keywords == ["brave", "captain", "sails"]
    (tmp_path / "b.md").unlink()
    (tmp_path / "d.txt").write_text("new")
    again = {r.file_name: r for r in documents.ingest(spark, str(tmp_path), first, F.lit("2100-01-01").cast("timestamp")).collect()}
    assert set(again) == {"npc one.txt", "d.txt"} and again["npc one.txt"].indexed_utc == rows["npc one.txt"].indexed_utc and again["d.txt"].indexed_utc.year == 2100


def test_greedy_tokens(spark):
    tokens = ["", "The", "t", "he", "the", " cat", "c"]
    rows = vectors.greedy_tokens(spark.createDataFrame([(1, "THE cat"), (2, "xtc "), (3, None), (4, "t" * 80)], "id int, text string"), tokens).collect()
    assert {r.id: r.ids for r in rows} == {1: [1, 5], 2: [2, 6], 3: [], 4: [2] * 51}


def test_config_lookups(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"instruments": {"brass": ["horn", "tuba"], "keys": ["organ"]}, /* hints */ "tempoMarkings": [{"label": "Largo", "bpmHint": 50}]}')
    config = stores.read_config(spark, str(path), stores.MUSIC)
    assert sorted(tuple(r) for r in stores.instruments(config).collect()) == [("brass", "horn"), ("brass", "tuba"), ("keys", "organ")]
    assert [r.instrument for r in stores.instruments(config, "keys").collect()] == ["organ"] and stores.instruments(config, "none").count() == 0
    assert [tuple(r) for r in stores.tempo_markings(config).collect()] == [("Largo", 50)]


def test_tensor_census(spark):
    rows = [("blk.0.w", [4, 2], "F32", 0), ("blk.1.w", [4, 2], "F32", 32), ("out", [4], "Q8_0", 64)]
    tensors = spark.createDataFrame(rows, "name string, shape array<long>, dtype string, offset long")
    assert {tuple(r) for r in model_file.dtype_census(tensors).collect()} == {("F32", 2), ("Q8_0", 1)}
    assert {(r.pattern, tuple(r.shape), r.dtype) for r in model_file.name_patterns(tensors).collect()} == {("blk.N.w", (4, 2), "F32"), ("out", (4,), "Q8_0")}
    assert model_file.dequantise("MXFP4", bytes([0]) + bytes([0x77] * 16)).tolist() == [0.0] * 32


def test_scene(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# points\n1,2,3\n4,5,6\n")
    scene = points.load_scene(spark, str(tmp_path / "s.csv"), register=False).collect()
    assert sorted((r.pos.x, r.pos.y, r.pos.z) for r in scene) == [(1, 2, 3), (4, 5, 6)] and not any(r.registered for r in scene) and len({r.guid for r in scene}) == 2
    more = points.load_scene(spark, str(tmp_path / "s.csv"), points.load_scene(spark, str(tmp_path / "s.csv")))
    assert more.count() == 4


def test_text_index_with_any_source(spark):
    class Lengths:
        name, dims = "lengths", 2

        def embed(self, df, text="text"):
            return df.withColumn("vec", F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))

    corpus = spark.createDataFrame([(1, "a"), (2, "bbbb"), (3, "ccccc")], "id long, text string")
    built = embedding.build_index(corpus, Lengths())
    asked = embedding.embedded(spark.createDataFrame([(9, "dddd")], "id long, text string"), Lengths())
    assert [r.id for r in vectors.knn(asked, built, 2, 2).orderBy("rank").collect()] == [2, 3]
    assert embedding.HashSource(64).name == "direct-hash-64d"
    vec = embedding.HashSource(64).embed(corpus).first().vec
    assert len(vec) == 64 and sum(vec) == 1


def test_completion_service():
    class Model:
        dims = 8

        def generate(self, prompt, most, candidates):
            if prompt == "fail":
                raise ValueError("no")
            yield from list(prompt)[:most]

    service = server.server(Model(), "m", "f")
    threading.Thread(target=service.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{service.server_address[1]}"

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=20) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as error:
            return error.code, error.read().decode()

    assert json.loads(ask("/api/tags")[1])["models"][0]["name"] == "m" and json.loads(ask("/api/ps")[1])["models"]
    assert json.loads(ask("/api/show", {})[1])["model_info"]["general.embedding_length"] == 8
    assert json.loads(ask("/api/generate", {"prompt": "abc", "stream": False, "options": {"num_predict": 2}})[1]) == {"model": "m", "response": "ab", "done": True}
    lines = [json.loads(x) for x in ask("/api/generate", {"prompt": "xyz"})[1].splitlines()]
    assert [x["response"] for x in lines] == ["x", "y", "z", ""] and [x["done"] for x in lines] == [False] * 3 + [True]
    assert ask("/none")[0] == 404 and ask("/api/generate", {"prompt": "fail", "stream": False})[0] == 500
    service.shutdown()


def test_python_words_and_chunks_equal_the_columns(spark, monkeypatch):
    r = random.Random(11)
    bits = ["The", "queue", "İstanbul", "\u212aelvin", "it's", "ab", "x" * 30, "\n\n", "\n \u00a0\u2028\n", "\n", "\x85", "\n\u200b\n", ". ", " ", "Σίς", "über", "1st", "and"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice([0, 1, 5, 60, 900]))) for _ in range(150)] + [" ".join(f"w{i}" for i in range(300)), "\n\n", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("text", t.words(F.col("text")).alias("words"), t.keywords(F.col("text")).alias("keywords"), t.chunks(F.col("text"), 40).alias("chunks")).collect()
    for row in rows:
        assert (t.word_list(row.text), t.first_keywords(row.text), t.chunk_list(row.text, 40)) == (row.words, set(row.keywords), row.chunks)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(3)
    of_doc, own = (t.overlap(F.array(*map(F.lit, ["queue", "and", "kelvin"])), c) for c in (t.keywords(F.col("text")), t.words(F.col("chunk"))))
    each = docs.select("doc", of_doc.alias("of_doc"), F.posexplode(t.chunks(F.col("text"), 40)).alias("chunk_no", "chunk")).withColumn("own", own).filter("own > 0 AND of_doc > 0")
    want = each.select("doc", "chunk_no", F.round(F.col("own") + 0.3 * F.col("of_doc"), 9).alias("score")).orderBy(F.desc("score"), "doc", "chunk_no").limit(25).collect()
    monkeypatch.setattr(t, "keywords", None)  # a text is read once, in one pass
    got = documents.relevance(docs, "queue and kelvin", 25, size=40).select("doc", "chunk_no", "score").collect()
    assert len(want) == 25 and got == want


def test_hash_source_embeds_texts_once(spark):
    texts = ["", None, "one two one", "a b c d e f g h", "über, über"]
    rows = [(i, texts[i % 5]) for i in range(300)]
    seen = spark.sparkContext.accumulator(0)

    class Counting(embedding.HashSource):
        def embed(self, df, text="text"):
            def counted(batches):
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            return super().embed(df, text).mapInArrow(counted, "id long, text string, vec array<float>")

    df = spark.createDataFrame(rows, "id long, text string")
    built = embedding.build_index(df, Counting(64), cells=8)
    assert built.counts.sum() == 300 and seen.value <= 308
    sparse = t.hash_embedding(df, 64).select("id", vectors.dequantize(F.col("e"), 64, 1_000_000).alias("want"))
    both = embedding.HashSource(64).embed(df).join(sparse, "id").collect()
    assert len(both) == 300 and all(r.vec == r.want for r in both)
