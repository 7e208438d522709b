"""Awkward tables for every operator and pipeline stage: empty ones, clashing and unusual columns, one id with several texts."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthant.llm import chat_format, common, decontamination, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = ("score", "predicted", "key", "keys", "mark", "drop", "d", "row", "fp", "root", "kept", "n", "h", "bag", "label", "part", "n_lines_dropped", "__doc", "__drop", "__mark", "__gone")


@pytest.fixture(scope="module")
def wide(spark):
    """Nulls in all columns, repeated rows, one id with two texts, null ids with one text, clashing names and a map column."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    same = prose(60)
    texts = [None, "", same, same, prose(80), prose(3000), "漢" * 500, "\n\n\n", same + "\n" + prose(30), prose(40) + "\n" + same, "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, "s", None if i % 3 else 5) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, "another text altogether " + prose(50), None, None, 1), (None, prose(20), None, None, None), (None, None, None, None, None)]
    rows += [(None, "a text without an id", "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("taken") for c in CLASHES}).withColumn("map", F.create_map(F.lit("a"), F.lit(1))).withColumn("with space", F.lit(1)).cache()


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "a text without an id"), (2, None), (None, "this is an item that has no id but nine words")], "item_id long, text string")


def model(spark, docs):
    return quality_classifier.train(docs, labels(spark), F.lit(True))


STAGES = {
    "quality": lambda spark, docs: quality_classifier.keep_good(docs, None),
    "lines": lambda spark, docs: line_dedup.line_dedup(docs, counted=False),
    "near": lambda spark, docs: simhash_dedup.keep_first(docs),
    "benchmark": lambda spark, docs: decontamination.decontaminate(docs, items(spark)),
}
OPERATORS = {
    "line_dedup": lambda spark, docs: line_dedup.line_dedup(docs),
    "quality_rules": lambda spark, docs: quality_rules.quality_rules(docs),
    "quality_classifier": lambda spark, docs: quality_classifier.score(docs, model(spark, docs)),
    "packing": lambda spark, docs: packing.pack(docs, packing.default_path()),
    "simhash": lambda spark, docs: simhash_dedup.simhash_components(docs),
    "license": lambda spark, docs: license_scan.license_scan(docs),
    "decontamination": lambda spark, docs: decontamination.contaminated(docs, items(spark)),
    "toxicity": lambda spark, docs: toxicity.score(docs, toxicity.train(docs, labels(spark), F.lit(True))),
    "token_counts": lambda spark, docs: token_counts.token_counts(docs, token_counts.default_path()),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_pass_columns_through(spark, wide, name):
    out = STAGES[name](spark, wide)
    assert out.schema.names == wide.schema.names
    rows, before = out.collect(), wide.collect()
    assert all(r["score"] == r["__drop"] == "taken" and r["map"] == {"a": 1} for r in rows)
    if name in ("quality", "lines"):
        assert len(rows) == len(before)
    if name == "lines":
        assert {r.doc_id for r in rows} == {r.doc_id for r in before}
    if name == "benchmark":
        assert len(rows) == len(before) - 2 and not any(r.text == "a text without an id" for r in rows)
    if name == "near":
        texts = [r.text for r in rows if r.doc_id == 4]
        assert len(texts) == 2 and len(set(texts)) == 2  # two texts of one id stay, repeated rows don't
        assert sum(r.text == "a text without an id" for r in rows) == 1
    empty = STAGES[name](spark, wide.limit(0))
    assert empty.schema.names == wide.schema.names and empty.count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_awkward_and_empty_tables(spark, wide, name):
    if name in ("packing", "token_counts"):
        pytest.importorskip("public_tokenizers")
    out = OPERATORS[name](spark, wide)
    assert len(set(out.columns)) == len(out.columns)
    if name not in ("packing", "decontamination"):
        assert out.count() == wide.count()
    assert OPERATORS[name](spark, wide.limit(0)).count() == 0


def test_decontamination_with_null_ids(spark, wide):
    found = decontamination.contaminated(wide, items(spark)).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(None, 1)]
    assert decontamination.contaminated(wide, items(spark).limit(0)).count() == 0


def test_pipeline_stages_on_an_awkward_table(spark, wide, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (wide, wide.limit(0)):
        now = docs
        for i, (name, stage) in enumerate(pipeline.STAGES):
            now = pipeline.materialize(stage(spark, now, str(tmp_path)), name)
            if i < len(pipeline.STAGES) - 1:
                assert now.schema.names == wide.schema.names
        assert (now.count() > 0) == (docs is wide)


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_repeated_rows_of_a_label_leave_the_other_in(spark, column):
    r = random.Random(22)
    words = ["".join(r.choices("abcde", k=5)) for _ in range(100)]
    text = lambda bad: " ".join(r.choices(words, k=40) + ["grumok zorbel"] * bad)
    rows = [(i, text(i % 2), "en", "s", 1) for i in range(60)]
    rows += [rows[0]] * 200 + [(2, text(0), "en", "s", 1) for _ in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], LABELS)
    if column == "quality":
        found = quality_classifier.train(docs, marks, F.lit(True), per_class=10)
        assert found is not None
        scores = {r.doc_id: r.score for r in quality_classifier.score(docs.limit(60), found).collect()}
        assert len({round(x, 3) for x in scores.values()}) > 2
    else:
        assert toxicity.train(docs, marks, F.lit(True), per_class=(10, 10)) is not None


def test_a_corpus_without_tagged_words_gets_the_base_rate(spark):
    r = random.Random(23)
    words = ["".join(r.choices("abcde", k=5)) for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=40)), "en", "s", 1) for i in range(64)], DOCS)
    found = toxicity.train(docs, spark.createDataFrame([(i, 1, int(i < 4)) for i in range(64)], LABELS), F.lit(True))
    rows = toxicity.score(docs, found).collect()
    assert {x.score for x in rows} == {4 / 64} and {x.predicted for x in rows} == {0}


def test_long_documents_are_excerpted_for_training():
    text = " ".join(f"w{i}" for i in range(10_000)).encode()
    cut = toxicity.excerpt(text, 800).split()
    assert len(cut) == 800 and cut[0] == b"w0" and cut[-1] == b"w9999" and toxicity.excerpt(text, 10_000) == text


def test_conversation_of_one_turn_number(spark):
    rows = [(1, 0, "user", f"m{i:04}") for i in range(700)] + [(2, 0, "user", f"m{i:04}") for i in range(300)] + [(3, None, None, None)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted({(r.conv_id, r.n_turns) for r in out}) == [(1, 700), (3, 1)]
    text = "".join(r.text for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.block))
    assert text == "".join(f"<|im_start|>user\nm{i:04}<|im_end|>\n" for i in range(700))


def test_scratch_folders(spark):
    df = common.materialize(spark.range(5), "test")
    other = common.materialize(spark.range(7), "test")
    common.discard(df)
    assert other.count() == 7
    common.clear_scratch(spark)
    with pytest.raises(Exception):
        other.count()

    class Cluster:
        conf = {}

        class sparkContext:
            master, applicationId, getConf = "spark://host:7077", "x", dict

    with pytest.raises(ValueError):
        common.scratch_dir(Cluster)


def test_hashes_of_long_words_and_lines_depend_on_the_order():
    a, b = b"a" * 2000 + b"b" + b"c" * 2000, None
    swapped = bytearray(a)
    swapped[0], swapped[1024 * 2] = swapped[1024 * 2], swapped[0]
    b = bytes(swapped)
    words = common.ByteWords([a, b])
    assert len(set(words.hashes(words.data.astype("uint64")).tolist())) == 2
    tokens = ["w" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(1500)]
    other = tokens.copy()
    other[3], other[3 + 1024] = other[3 + 1024], other[3]
    _, _, keys = line_dedup.template_keys([" ".join(x).encode() for x in (tokens, other)])
    assert keys[0] != keys[len(keys) // 2]


def test_skew_join_equals_a_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.skew_join(rows, keyed, ["k"], "n", 5000)
    assert got.count() == 5000 and got.select("k", "n").distinct().count() == keyed.count()
    assert isinstance(got.schema, T.StructType)
