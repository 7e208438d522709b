import json
import math
import struct

import numpy as np
import pandas as pd
import pytest

from orthant.functions import signal
from orthant.model import fixed_point as fp
from orthant.model.tokenizers import BytePairs, WordPieces
from orthant.operators import documents
from orthant.sources import model_file, points, stores
from orthant.streaming import ticks


def test_point_files(spark, tmp_path):
    (tmp_path / "static.csv").write_text("# shape\n1,2,3,255,0,9\n-4,5,6,0,0,0\n")
    (tmp_path / "sweep.csv").write_text("﻿# frames\n0,1,2,3\n0,4,5,6\n1 7\t8,9\n")
    static = points.read_points(spark, str(tmp_path / "static.csv")).collect()
    assert sorted((r.x, r.r, r.frame) for r in static) == [(-4, 0, None), (1, 255, None)]
    sweep = points.read_points(spark, str(tmp_path / "sweep.csv")).collect()
    assert sorted((r.frame, r.x, r.z) for r in sweep) == [(0, 1, 3), (0, 4, 6), (1, 7, 9)]


@pytest.mark.parametrize("change, framed", [(None, True), ("falls", False), ("alone", False)])
def test_point_files_of_many_blocks(spark, tmp_path, change, framed):
    first = list(range(400)) if change == "alone" else [i // 3 for i in range(400)]
    if change == "falls":
        first[200] = 0
    (tmp_path / "f.csv").write_text("".join(f"{f}, {i}, 2, 3\n" for i, f in enumerate(first)))
    (tmp_path / "g.csv").write_text("7 8 9\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        df = points.read_points(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "monotonically_increasing_id" not in plan and "SortMergeJoin" not in plan  # lines are neither numbered nor sorted
        got = sorted((r.frame is not None, r.frame, r.x, r.y, r.z, r.size) for r in df.collect() if r.x != 7 or r.y != 8)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(True, f, i, 2, 3, None) if framed else (False, None, f, i, 2, 3) for i, f in enumerate(first)]
    assert got == sorted(want) and df.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("text", ["1,2,3\n1,2\n", "1.5,2,3\n", "1,2,3,256,0,0\n"])
def test_corrupt_point_files_raise(spark, tmp_path, text):
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(Exception):
        points.read_points(spark, str(tmp_path / "bad.csv")).collect()


def test_embedding_rows(spark, tmp_path):
    (tmp_path / "m_3.csv").write_text("1,2.5,x\n-1,0,3\n")
    assert sorted(r.vec for r in points.read_embeddings(spark, str(tmp_path / "m_3.csv")).collect()) == [[-1, 0, 3], [1, 2.5, 0]]


def write_model(path, magic=b"GGUF", version=3):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    values = np.arange(12, dtype="<f4")
    block = struct.pack("<e", 0.5) + np.arange(-16, 16, dtype=np.int8).tobytes()
    out = magic + struct.pack("<IQQ", version, 2, 2) + text("a.name") + struct.pack("<I", 8) + text("tiny") + text("a.sizes") + struct.pack("<IIQ3i", 9, 5, 3, 1, 2, 3)
    out += text("w") + struct.pack("<IQQIQ", 2, 4, 3, 0, 0) + text("q") + struct.pack("<IQIQ", 1, 32, 8, 64)
    out += bytes(-len(out) % 32) + values.tobytes()
    out += bytes(-len(values.tobytes()) % 32) + block
    path.write_bytes(out)


def test_model_file(spark, tmp_path):
    path = tmp_path / "m.gguf"
    write_model(path)
    spark.dataSource.register(model_file.ModelFileSource)
    read = lambda table: spark.read.format("gguf").option("table", table).load(str(path)).collect()
    assert {r.key: json.loads(r.value) for r in read("metadata")} == {"a.name": "tiny", "a.sizes": [1, 2, 3]}
    assert {r.name: r.dtype for r in read("tensors")} == {"w": "F32", "q": "Q8_0"}
    rows = {(r.name, r.row_id): list(r["values"]) for r in read("rows")}
    assert rows["w", 2] == [8, 9, 10, 11] and rows["q", 0] == [x / 2 for x in range(-16, 16)]


def test_model_file_refuses_what_it_does_not_know(tmp_path):
    write_model(tmp_path / "x", magic=b"ABCD")
    write_model(tmp_path / "y", version=1)
    for name in "xy":
        with pytest.raises(ValueError):
            model_file.Header(str(tmp_path / name))
    with pytest.raises(NotImplementedError):
        model_file.dequantise("Q5_0", bytes(22))


def test_four_bit_blocks():
    block = struct.pack("<e", 2.0) + bytes([0x98] * 16)
    assert model_file.dequantise("Q4_0", block).tolist() == [0.0, 2.0] * 16
    assert model_file.dequantise("MXFP4", bytes([128]) + bytes([0xF1] * 16)).tolist() == [1.0, -12.0] * 16


def test_stores(spark, tmp_path):
    schema = "key string, version long, deleted boolean, value int"
    for version, rows in enumerate([[("a", False, 1), ("b", False, 2)], [("a", False, 3)], [("b", True, 0)]]):
        stores.append_records(spark.createDataFrame([(k, version, d, v) for k, d, v in rows], schema), str(tmp_path / "s"))
    assert [(r.key, r.value) for r in stores.read_records(spark, str(tmp_path / "s"), schema).collect()] == [("a", 3)]
    from pyspark.sql import functions as F

    bodies = spark.createDataFrame([('{"embeddings":[[1,2]]}',), ('{"embedding":[3]}',)], "b string")
    assert sorted(r.v for r in bodies.select(stores.parse_embedding(F.col("b")).alias("v")).collect()) == [[1, 2], [3]]


def test_prompts(spark):
    text = ["SERIES ONE: Frontier", 'PROMPT 01 — "First"', "body a", "body b", 'PROMPT 02 - "Second"', "scene one", "", "scene two", "", "LORA: ink:0.6", "", "wide shot", "SERIES TWO: Core", 'PROMPT 3 – "Third"', "d", "PRODUCTION NOTES", "e"]
    other = ['PROMPT 9 - "Alone"', "LORA: soft", "x"]
    lines = [("a", i, x) for i, x in enumerate(text)] + [("b", i, x) for i, x in enumerate(other)]
    rows = documents.prompts(spark.createDataFrame(lines, "file string, n int, line string")).orderBy("number").collect()
    assert [(r.file, r.number, r.title, r.series, r.scene, r.style, r.lora, r.lora_weight) for r in rows] == [
        ("a", 1, "First", "Frontier", "body a\nbody b", "", None, 0.8), ("a", 2, "Second", "Frontier", "scene one\n\nscene two", "wide shot", "ink", 0.6),
        ("a", 3, "Third", "Core", "d", "", None, 0.8), ("b", 9, "Alone", "", "x", "", "soft", 0.8),
    ]


def test_prompt_adjustment():
    weights = {"mist": 2.0, "gold": 3.0, "neon": -2.0}
    assert documents.adjust_prompt("a neon city, rain", weights, 3) == "a city, rain, gold, mist"
    assert documents.adjust_prompt("a neon city", weights, 2) == "a neon city"
    assert documents.adjust_prompt("a city, neon, rain", weights | {"preset:x": 9.0}, 3) == "a city, rain, gold, mist"


def test_fixed_point():
    for x in (-5.0, -0.3, 0.0, 0.7, 3.0):
        assert abs(fp.to_float(fp.exp(fp.from_float(x))) - math.exp(x)) < 1e-6 * max(1, math.exp(x))
        assert abs(fp.to_float(fp.sigmoid(fp.from_float(x))) - 1 / (1 + math.exp(-x))) < 1e-6
    assert abs(sum(fp.softmax([fp.from_float(x) for x in (1, 2, 3)])) - fp.ONE) < 8
    assert fp.isqrt(10**40) == 10**20
    one = fp.ONE
    assert fp.attention([[one, 0], [0, one]], [[one, 0], [0, one]], [[5 * one, 0], [0, 7 * one]])[0] == [5 * one, 0]


def test_tokenizers():
    pieces = WordPieces({"[UNK]": 0, "play": 1, "##ing": 2, "now": 3, ".": 4})
    assert pieces.encode("Playing now. zzz") == [1, 2, 3, 4, 0]
    assert pieces.decode([1, 2, 3]) == "playing now"
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b" the": 258}
    pairs = BytePairs(ranks)
    assert pairs.encode("the the") == [257, 258] and pairs.decode(pairs.encode("thé é")) == "thé é"


def test_audio_features():
    rate, n = 22_050, 22_050 * 60
    silence = signal.audio_features(np.zeros(n), rate)
    assert silence["rms_db"] == silence["peak_db"] == -96 and silence["centroid"] == 1000
    clicks = np.zeros(n)
    clicks[:: 8 * 2048] = 1.0  # a rise in every eighth frame
    assert abs(signal.audio_features(clicks, rate)["bpm"] - 60 * rate / (8 * 2048)) < 1
    tone = 372 * rate / 8192
    sine = np.sin(2 * np.pi * tone * np.arange(n) / rate)
    found = signal.audio_features(sine, rate)
    assert abs(found["centroid"] - tone) < 20 and abs(found["rms_db"] + 3.01) < 0.1
    bands = signal.band_energies(sine)
    assert bands.shape == (n // 4096, 64) and (bands.argmax(1) == int(tone / (rate / 2048) / 16)).all()
    assert signal.tempo(np.zeros(3), rate) == 120


def test_streamed_ticks(spark, tmp_path):
    schema = "guid string, ts_ms long, kind string, x long, y long, z long"
    batches = [[("a", 0, "insert", 1, 2, 3), ("a", 1, "register", 0, 0, 0), ("a", 2, "set_velocity", 100, 0, 0)], [("a", 12, "tick", 0, 0, 0)], [("a", 13, "set_velocity", 5, 5, 5), ("a", 90, "tick", 0, 0, 0)]]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["guid", "ts_ms", "kind", "x", "y", "z"]).to_json(source / f"{i}.json", orient="records", lines=True)
    stream = ticks.track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    q = stream.writeStream.outputMode("update").format("memory").queryName("ticks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert max(r.x for r in spark.table("ticks").collect()) == 1 + 100 * 11
