"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of `PASSAGE` words. Each passage gets byte-bigram frequencies and surface
statistics, is encoded by a tanh layer, and receives a gated attention weight (tanh branch times sigmoid
branch, softmax over the bag). The bag's label is a logistic function of the attention-weighted encoding, so
only document labels are needed. Training takes a bounded sample (`per_class` labelled documents for each
label, those of the least hashed ids, `most_passages` passages of each); every document is scored from all its passages.

Defined cases: a null or empty text is a bag with one zero passage; without usable labels of both classes every score
is 0.5; conflicting labels of a document count as two examples, several rows of a labelled id as one; repeated rows
and null ids are scored each; an empty table gives an empty result; other columns pass through, but for `score` and
`predicted`, which are replaced. Labels, language, source and id are not among the features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, Words, crc_mod, slices, table, utf8_list

PASSAGE = 64
BIGRAMS = 192
DENSE = 22
WIDTH = BIGRAMS + DENSE

_powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_classes = np.zeros(256, np.int64)  # 0: letters of words and other bytes
for _group, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#*$%&|<>", b":;'\"()[]{}-_/\\=+@~^`", bytes(range(0x80, 0x100))), 1):
    _classes[list(_bytes)] = _group


def _shares(hits: np.ndarray, passage: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    return np.bincount(passage, hits, n) / size


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text."""
    words = Words(texts)
    bags = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    n = int(first[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not words.total:
        return out, bags
    flat = b" ".join(words.flat()) + b" "
    data = np.frombuffer(flat, np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    order = np.arange(words.total) - words.starts[words.doc]
    passage = first[words.doc] + order // PASSAGE
    place = np.bincount(passage, minlength=n).astype(np.float64)
    count = np.maximum(place, 1)
    at_byte = np.repeat(passage, length + 1)
    size = np.maximum(np.bincount(at_byte, minlength=n), 1).astype(np.float64)

    pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 7) % BIGRAMS
    inner = at_byte[1:] == at_byte[:-1]  # no pair reaches into the next passage, which may be another document's
    grams = np.bincount((at_byte[:-1] * BIGRAMS + pair)[inner], minlength=n * BIGRAMS).reshape(n, BIGRAMS)
    out[:, :BIGRAMS] = np.sqrt(grams / size[:, None])

    kinds = np.bincount(at_byte * 9 + _classes[data], minlength=n * 9).reshape(n, 9) / size[:, None]
    within = np.arange(len(data)) - np.repeat(starts, length + 1)
    hashed = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _powers[within & 63], starts)
    same = np.zeros(words.total)
    same[1:] = (hashed[1:] == hashed[:-1]) & (words.doc[1:] == words.doc[:-1])
    triple = hashed + words.doc.astype(np.uint64) * _powers[7]
    triple[1:] += hashed[:-1] * _powers[3]
    triple[2:] += hashed[:-2] * _powers[5]
    again = np.ones(words.total)
    again[np.unique(triple, return_index=True)[1]] = 0
    fresh = np.zeros(words.total)
    fresh[np.unique(hashed + passage.astype(np.uint64) * _powers[9], return_index=True)[1]] = 1
    lead, last = _classes[data[starts]], _classes[data[np.maximum(ends - 1, 0)]]
    mean_length = _shares(length, passage, n, count)
    out[:, BIGRAMS : BIGRAMS + 9] = 3 * kinds
    for k, column in enumerate((
        mean_length / 10, np.sqrt(np.maximum(_shares(length**2, passage, n, count) - mean_length**2, 0)) / 10,
        _shares(same, passage, n, count), _shares(again, passage, n, count), _shares(fresh, passage, n, count),
        _shares(lead == 1, passage, n, count), _shares(last == 3, passage, n, count), _shares(last == 5, passage, n, count),
        _shares(last == 6, passage, n, count), _shares((last == 6) & (length == 1), passage, n, count),
        place / PASSAGE, _shares(length <= 2, passage, n, count), _shares(length >= 15, passage, n, count),
    ), BIGRAMS + 9):
        out[:, k] = column
    return out, bags


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """encoder W, b; attention V, U, a; output c, d."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": draw(WIDTH, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p, starts = self.p, np.concatenate([[0], np.cumsum(bags)[:-1]])
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags))
        w = e / np.repeat(np.add.reduceat(e, starts), bags)
        z = np.add.reduceat(w[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "w": w, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x, bags, f, y) -> dict:
        p, n, starts = self.p, len(bags), np.concatenate([[0], np.cumsum(bags)[:-1]])
        dy = (f["y"] - y) / n
        dz = np.repeat(dy, bags)[:, None] * p["c"]
        pull = (dz * f["h"]).sum(1)
        de = f["w"] * (pull - np.repeat(np.add.reduceat(f["w"] * pull, starts), bags))
        dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["w"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": de @ (f["t"] * f["g"]), "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            for k, g in self.gradients(x, bags, self.forward(x, bags), y).items():
                g = g + decay * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["y"]


def usable_rows(labels: DataFrame, column: str, usable) -> DataFrame:
    """doc_id, label: the distinct labels (0 or 1) of known ids."""
    return labels.filter(usable & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label")).distinct()


def label_counts(labels: DataFrame, column: str, usable) -> list:
    return usable_rows(labels, column, usable).groupBy("label").agg(F.count("*").alias("n")).collect()  # two rows


def sample_ids(labels: DataFrame, column: str, usable, per_class: tuple[int, int]) -> DataFrame:
    """At most as many ids of each label (0, 1) as per_class has, by the least hash of the id: a bounded table."""
    rows = usable_rows(labels, column, usable)
    halves = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[k]) for k in (0, 1)]
    return halves[0].unionByName(halves[1])


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = 1500, most_passages: int = 64) -> AttentionModel | None:
    """Fit on at most 2 * per_class documents; None without labelled documents of both classes.

    Every labelled id counts once, with the least of its bags if it has several rows. A bag is trained on with at most
    most_passages passages, evenly spread over the text, so no document outweighs the driver; scoring uses all.
    """
    chosen = sample_ids(labels, "quality", usable, (per_class, per_class))  # bounded, so it may be broadcast

    def bags_of(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            x, bags = passages(utf8_list(part.column("text")))
            cuts = np.concatenate([[0], np.cumsum(bags)])
            spread = (np.unique(np.linspace(a, b - 1, min(b - a, most_passages)).astype(np.int64)) for a, b in zip(cuts, cuts[1:]))
            rows = [x[at].tobytes() for at in spread]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "bag"])

    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    single = found.mapInArrow(bags_of, "doc_id long, label int, bag binary").groupBy("doc_id", "label").agg(F.min("bag").alias("bag"))
    rows = single.orderBy("label", F.xxhash64("doc_id"), "doc_id").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows.column("bag").to_pylist()]
    return AttentionModel().fit(np.concatenate(x).astype(np.float32), np.array([len(b) for b in x]), y)


def _judged(part: pa.RecordBatch, model: AttentionModel | None) -> np.ndarray:
    return np.full(part.num_rows, 0.5) if model is None else model.score(*passages(utf8_list(part.column("text"))))


def score(docs: DataFrame, model: AttentionModel | None, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted appended; columns of docs with these names are replaced."""
    kept = [f.name for f in docs.schema.fields if f.name not in ("score", "predicted")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, score double, predicted int"

    def scored(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            values = _judged(part, model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return rows.mapInArrow(scored, schema)


def keep_good(docs: DataFrame, model: AttentionModel | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more, with just their columns, whatever these are called."""

    def good(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            yield part.filter(pa.array(_judged(part, model) >= threshold))

    return docs.mapInArrow(good, docs.schema)


def usable_labels():
    return crc_mod("doc_id", 5) != 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, table(spark, sf_dir, "labels"), usable_labels())
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
