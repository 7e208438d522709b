import http.server
import io
import json
import random
import struct
import threading
import zlib

import numpy as np
import pytest

from orthant.sources import embedding_service, images, index_file, model_file


def by_hand(name, b):
    """Values of one 256-value block, one at a time."""
    half = lambda at: float(np.frombuffer(b[at : at + 2], "<f2")[0])
    field = lambda at, i, width: b[at + i * width // 8] >> i * width % 8 & (1 << width) - 1
    out = []
    for i in range(256):
        if name == "Q2_K":
            s = b[4 + i // 16]
            out.append(half(0) * (s & 15) * field(20, i, 2) - half(2) * (s >> 4))
        elif name == "Q3_K":
            g = i // 16
            low = b[96 + g] & 15 if g < 8 else b[96 + g - 8] >> 4
            out.append(half(108) * ((low | field(104, g, 2) << 4) - 32) * ((field(32, i, 2) | field(0, i, 1) << 2) - 4))
        elif name in ("Q4_K", "Q5_K"):
            g, s = i // 32, b[4:16]
            scale, least = (s[g] & 63, s[g + 4] & 63) if g < 4 else (s[g + 4] & 15 | s[g - 4] >> 6 << 4, s[g + 4] >> 4 | s[g] >> 6 << 4)
            q = field(16, i, 4) if name == "Q4_K" else field(48, i, 4) | field(16, i, 1) << 4
            out.append(half(0) * scale * q - half(2) * least)
        else:
            scale = struct.unpack_from("b", b, 192 + i // 16)[0]
            out.append(half(208) * scale * ((field(0, i, 4) | field(128, i, 2) << 4) - 32))
    return out


@pytest.mark.parametrize("name,size,halves", [("Q2_K", 84, (0, 2)), ("Q3_K", 110, (108,)), ("Q4_K", 144, (0, 2)), ("Q5_K", 176, (0, 2)), ("Q6_K", 210, (208,))])
def test_blocks_of_256(name, size, halves):
    blocks = []
    for seed in (1, 2):
        b = bytearray(random.Random(seed).randbytes(size))
        for at in halves:
            struct.pack_into("<e", b, at, 0.25 * seed + at / 1024)
        blocks.append(bytes(b))
    found = model_file.dequantise(name, b"".join(blocks))
    assert found.shape == (512,)
    assert np.allclose(found, by_hand(name, blocks[0]) + by_hand(name, blocks[1]), rtol=1e-5, atol=1e-4)


def test_locate(tmp_path):
    tags = tmp_path.joinpath(*model_file.MANIFESTS, "m")
    tags.mkdir(parents=True)
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "sha256-1").write_text("x")
    layers = [{"mediaType": "other", "digest": "sha256:0"}, {"mediaType": model_file.MODEL_LAYER}, {"mediaType": model_file.MODEL_LAYER, "digest": "sha256:1"}]
    (tags / "7b").write_text(json.dumps({"layers": layers}))
    assert model_file.locate("m", tmp_path) == model_file.locate("m", tmp_path, "7b") == tmp_path / "blobs" / "sha256-1"
    (tags / "latest").write_text("no json")
    assert model_file.locate("m", tmp_path) is None and model_file.locate("m", tmp_path, "8b") is None and model_file.locate("n", tmp_path) is None


def vectors(n, payload):
    r = random.Random(n)
    return [(64, [(d, r.randint(-900, 900) or 1) for d in sorted(r.sample(range(64), 8))], payload(i)) for i in range(n)]


@pytest.mark.parametrize("kind,payload", [("string", lambda i: "é" * i), ("int32", lambda i: i - 5)])
def test_index_round_trip(spark, tmp_path, kind, payload):
    rows = vectors(200, payload)
    tree = index_file.build(rows)
    data = index_file.encode(tree)
    again = index_file.decode(io.BytesIO(data), kind)
    assert again == tree and index_file.encode(again) == data
    assert sorted(p for leaf in index_file.leaves(tree) for _, _, p in leaf.vectors) == sorted(p for _, _, p in rows)

    def check(node):
        if isinstance(node, index_file.Branch):
            sides = [[dict(e).get(node.dimension, 0) for leaf in index_file.leaves(x) for _, e, _ in leaf.vectors] for x in (node.below, node.above)]
            assert max(sides[0]) < node.value == sorted(sides[0] + sides[1])[len(sides[0] + sides[1]) // 2] <= min(sides[1])
            check(node.below)
            check(node.above)

    assert isinstance(tree, index_file.Branch)
    check(tree)
    (tmp_path / "i.slat").write_bytes(data)
    spark.dataSource.register(index_file.IndexFileSource)
    read = spark.read.format("slat").option("payload", kind).load(str(tmp_path / "*.slat")).collect()
    assert sorted((r.payload, [tuple(x) for x in r.e]) for r in read) == sorted((p, e) for _, e, p in rows)


def test_index_edges():
    same = [(4, [(1, 5)], i) for i in range(40)]
    assert index_file.build(same) == index_file.Leaf(same)
    assert index_file.build([(4, [], 0)] * 20) == index_file.Leaf([(4, [], 0)] * 20)
    assert index_file.encode(index_file.Leaf()) == b"SLAT\x01\0\0\0\0\0\0"
    half = index_file.Branch(3, 7, None, index_file.Leaf(same))
    assert index_file.decode(io.BytesIO(index_file.encode(half)), "int32") == half
    for bad in (b"SLAX\x01\0", b"SLAT\x02\0\0", b"SLAT\x01\0\x07", b"SLAT\x01\0\0\1"):
        with pytest.raises(ValueError):
            index_file.decode(io.BytesIO(bad))


def png(path, pixels):
    """pixels: rows x columns x 4."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("sample,spacing", [(1, 1.0), (2, 10.0), (0, 0.5)])
def test_images(spark, tmp_path, monkeypatch, sample, spacing):
    pixels = np.random.default_rng(0).integers(0, 256, (6, 5, 4), np.uint8)
    pixels[..., 3] = np.where(pixels[..., 0] < 128, 0, 255)
    png(tmp_path / "a.png", pixels)
    (tmp_path / "b.png").write_text("no image")
    found = images.image_points(spark, str(tmp_path), sample, spacing).collect()
    step = max(sample, 1)
    expected = [(round((x - 2) * spacing), round((2.5 - y) * spacing), 0, *map(int, pixels[y, x, :3])) for y in range(0, 6, step) for x in range(0, 5, step) if pixels[y, x, 3]]
    assert sorted((p.x, p.y, p.z, p.r, p.g, p.b) for p in found) == sorted(expected)
    everything = images.image_points(spark, str(tmp_path), sample, spacing, skip_transparent=False)
    assert everything.count() == len(range(0, 6, step)) * len(range(0, 5, step))


def test_embedding_service(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            vector = [float(len(asked["input"])), 0.5]
            body = json.dumps({"embeddings": [vector]} if asked["model"] == "m" else {"embedding": vector}).encode()
            self.send_response(200 if self.path == "/api/embed" else 404)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    texts = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id int, t string")
    for model in "mn":
        found = {r.id: r.vec for r in embedding_service.embed(texts, "t", url, model).collect()}
        assert found == {1: [3.0, 0.5], 2: [], 3: []}
    server.shutdown()
