"""Toxicity: a linear-chain conditional random field with two tags over the words of a document.

Labels are given for documents only, so the labelled tokens are derived from them first: in toxic documents of
the training sample, words whose form or stem (prefix) goes with toxic documents beyond chance are tagged toxic;
everything else is tagged clean. The CRF is trained on these tags by gradient ascent on the conditional
likelihood; its emission weights belong to hashed word, prefix and suffix features, so inflected forms that
training never met are found by their stem. Forward-backward gives each word's marginal; a logistic function of
the two largest marginals and of the expected number of toxic words gives the document's score, and words with a
marginal of a half or more give the offending spans (byte offsets in the UTF-8 text).

The recursions run over all words of a slice at once: 2x2 transition-emission matrices are multiplied in blocks
(a scan), and the first word of every document has a rank-one matrix, so documents don't influence each other.

Defined cases: null or empty text has no words and gets the score of zero marginals; without labels of both
classes every score is 0.5, and if no word can be tagged it is the share of toxic labels; a labelled id with several
rows is trained on once; repeated rows are scored each; null ids are scored and count as the empty string in the
folds; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import erfc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, Words, crc_mod, slices, table, utf8_list
from .quality_classifier import label_counts, sample_ids

FEATURES = 1 << 16
BLOCK = 256
FLOOR = 1e-3
EDGES = b".,;:!?\"'()[]{}<>-_*#$%&|/\\"


def stem_features(token: bytes) -> list[str]:
    """Names of a word's features: its form, prefixes of 3 to 7 characters and a suffix."""
    word = token.decode("utf-8", "replace").lower().strip(EDGES.decode())
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6, 7) if len(word) >= k), f"${word[-3:]}"]


def feature_ids(token: bytes) -> list[int]:
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in stem_features(token)]


def _product(a, b):
    """Product of two 2x2 matrices of arrays, scaled to a sum of one."""
    c = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    s = c[0] + c[1] + c[2] + c[3]
    return [x / s for x in c]


def marginals(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, prior: np.ndarray, pairs: bool = False):
    """Probability of the toxic tag for each word; emission is the log-odds of a word's own features.

    starts: where documents begin. With pairs, also the expected tag pairs (2x2) within documents.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    strength = np.clip(emission, -30, 30).astype(np.float64)
    e1 = 1 / (1 + np.exp(-strength))
    e0 = 1 - e1
    t = np.exp(transition - transition.max())
    q = np.exp(prior - prior.max())
    m = [np.where(first, q[j], t[i, j]) * (e1 if j else e0) for i in (0, 1) for j in (0, 1)]

    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    one = [1.0, 0.0, 0.0, 1.0]
    m = [np.concatenate([x, np.full(pad, v)]).reshape(rows, BLOCK) for x, v in zip(m, one)]
    ahead = [np.empty((rows, BLOCK)) for _ in range(4)]  # product of the block's matrices up to here
    back = [np.empty((rows, BLOCK)) for _ in range(4)]  # of those after here
    now = [np.full(rows, v) for v in one]
    for k in range(BLOCK):
        now = _product(now, [x[:, k] for x in m])
        for x, y in zip(ahead, now):
            x[:, k] = y
    whole, now = now, [np.full(rows, v) for v in one]
    for k in range(BLOCK - 1, -1, -1):
        for x, y in zip(back, now):
            x[:, k] = y
        now = _product([x[:, k] for x in m], now)
    left, right = np.empty((rows, 2)), np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    blocks = np.stack(whole, 1).reshape(rows, 2, 2)
    for r in range(rows):
        left[r] = v
        v = v @ blocks[r]
        v = v / v.sum()
    v = np.array([0.5, 0.5])
    for r in range(rows - 1, -1, -1):
        right[r] = v
        v = blocks[r] @ v
        v = v / v.sum()
    a = [(left[:, :1] * ahead[j] + left[:, 1:] * ahead[2 + j]).ravel()[:n] for j in (0, 1)]
    b = [(back[2 * i] * right[:, :1] + back[2 * i + 1] * right[:, 1:]).ravel()[:n] for i in (0, 1)]
    total = a[0] * b[0] + a[1] * b[1]
    toxic = a[1] * b[1] / total
    if not pairs:
        return toxic
    inner = np.flatnonzero(~first)
    joint = np.stack([a[i][inner - 1] * t[i, j] * (e1 if j else e0)[inner] * b[j][inner] for i in (0, 1) for j in (0, 1)])
    return toxic, (joint / joint.sum(0)).sum(1).reshape(2, 2)


class ChainTagger:
    def __init__(self, base: float = 0.5):
        self.base, self.untagged = base, False
        self.weights, self.bias = np.zeros(FEATURES), -4.0
        self.transition, self.prior = np.zeros((2, 2)), np.zeros(2)
        self.calibration = np.array([0.0, 1.0, 0.0, 0.0])

    def emission(self, token: bytes) -> float:
        return float(self.weights[feature_ids(token)].sum() + self.bias)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 30, rate: float = 0.3) -> ChainTagger:
        words = Words(texts)
        kinds: dict[bytes, int] = {}
        kind = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words.flat()), np.int64, words.total)
        ids = [feature_ids(w) for w in kinds]
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        feature = np.fromiter((i for x in ids for i in x), np.int64, len(owner))
        tags = silver_tags(words, list(kinds), kind, labels)
        if not tags.any():
            self.untagged = True
            return self
        starts = words.starts[:-1]
        share = max(tags.mean(), 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        first = np.zeros(words.total, bool)
        first[starts[words.counts > 0]] = True
        inner = np.flatnonzero(~first)
        truth = np.bincount(2 * tags[inner - 1].astype(np.int64) + tags[inner].astype(np.int64), minlength=4).reshape(2, 2)
        power = np.zeros(FEATURES)
        for _ in range(steps):
            score = np.bincount(owner, self.weights[feature], len(ids)) + self.bias
            p, pairs = marginals(score[kind], starts, self.transition, self.prior, True)
            gap = np.bincount(kind, tags - p, len(ids))
            grad = np.bincount(feature, gap[owner], FEATURES) - 0.02 * self.weights
            power = 0.9 * power + 0.1 * grad**2
            self.weights += rate * grad / (np.sqrt(power) + 0.5)
            self.transition = np.clip(self.transition + (truth - pairs) / (truth.sum(1, keepdims=True) + 20), -6, 6)
            self.prior = np.clip(self.prior + np.array([1, -1]) * (p[first] - tags[first]).mean(), -6, 6) if first.any() else self.prior
        self._calibrate(document_features(p, words), labels)
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the document label on its aggregates, by Newton steps."""
        x = np.concatenate([np.ones((len(y), 1)), x], 1)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        c = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(c))
            c = c + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * c)
        self.calibration = c

    def score(self, p: np.ndarray, words: Words) -> np.ndarray:
        if self.untagged:
            return np.full(len(words.counts), self.base)
        c = self.calibration
        return 1 / (1 + np.exp(-np.clip(c[0] + document_features(p, words) @ c[1:], -30, 30)))


def document_features(p: np.ndarray, words: Words) -> np.ndarray:
    """Of each document: the log-odds of the two largest marginals (at least FLOOR), and the logarithm of the expected number of toxic words."""
    n = len(words.counts)
    at = np.flatnonzero(p > FLOOR)
    at = at[np.lexsort((p[at], words.doc[at]))]
    doc = words.doc[at]
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(at) else at
    top, second = np.full(n, FLOOR), np.full(n, FLOOR)
    top[doc[last]] = p[at[last]]
    more = last[(last > 0) & (doc[last - 1] == doc[last])]
    second[doc[more]] = p[at[more - 1]]
    odds = [np.log(q / (1 - q)) for q in (np.minimum(top, 1 - 1e-4), np.minimum(second, 1 - 1e-4))]
    sure = at[p[at] >= 0.05]
    return np.stack([*odds, np.log1p(np.bincount(words.doc[sure], p[sure], n))], 1)


def _discoveries(ratio: np.ndarray, tested: int, rate: float) -> np.ndarray:
    """Which log-likelihood ratios (chi-squared with one degree of freedom) stand out at a false-discovery rate, by Benjamini and Hochberg."""
    some = np.flatnonzero(ratio > 8)
    p = np.array([erfc((x / 2) ** 0.5) for x in ratio[some].tolist()])
    order = np.argsort(p, kind="stable")
    low = np.flatnonzero(p[order] <= rate * np.arange(1, len(p) + 1) / max(tested, 1))
    out = np.zeros(len(ratio), bool)
    out[some[order[: low[-1] + 1 if len(low) else 0]]] = True
    return out


def silver_tags(words: Words, kinds: list[bytes], kind: np.ndarray, labels: np.ndarray, rate: float = 1e-4, lift: float = 4) -> np.ndarray:
    """Tags of the words: toxic where, in a toxic document, the form or a stem goes with toxicity.

    A form or stem does if the documents that hold it (or hold it twice or more: prose meets the stems of some
    languages by chance now and then) tell the labels apart at the false-discovery rate, and if its share among
    toxic documents is `lift` times that among clean ones or more; the bound follows the sample's size and the
    number of forms. The most specific of a word's form and stems that enough documents have must show
    that share as well. A toxic document counts only as often as the form follows different words, as in
    copies of one document it always follows the same one.
    """
    bad, good = float(labels.sum()), float((1 - labels).sum())
    if not len(kinds) or not bad or not good:
        return np.zeros(words.total)
    names = [[x for x in stem_features(w) if x[0] == "=" and len(x) > 1 or x[0] == "^" and len(x) > 4] for w in kinds]
    numbers: dict[str, int] = {}
    of_kind = [[numbers.setdefault(x, len(numbers)) for x in own] for own in names]
    sizes = np.array([len(x) for x in of_kind])
    flat = np.fromiter((i for own in of_kind for i in own), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    n = len(numbers)

    def expand(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the features of kinds."""
        each = sizes[of]
        row = np.repeat(np.arange(len(of)), each)
        return row, flat[np.repeat(begins[of], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)]

    held, count = np.unique(words.doc * len(kinds) + kind, return_counts=True)  # a document's kinds
    row, name = expand(held % len(kinds))
    pair, where = np.unique((held // len(kinds))[row] * n + name, return_inverse=True)
    often = np.bincount(where, count[row])
    toxic = labels[pair // n] == 1
    before = np.concatenate([[-1], kind[:-1]])
    before[words.starts[:-1][words.counts > 0]] = -1
    inside = np.flatnonzero(labels[words.doc] == 1)
    places = np.unique(before[inside] * len(kinds) + kind[inside])
    row, name = expand(places % len(kinds))
    contexts = np.bincount(np.unique(name * (len(kinds) + 1) + (places // len(kinds))[row] + 1) // (len(kinds) + 1), minlength=n)
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
    marked, lifted, frequent = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for least in (1, 2):
        enough = often >= least
        hits = np.minimum(np.bincount(pair[toxic & enough] % n, minlength=n).astype(float), contexts)
        misses = np.bincount(pair[~toxic & enough] % n, minlength=n).astype(float)
        share = (hits + misses) / (bad + good)
        ratio = 2 * (part(hits, bad * share) + part(misses, good * share) + part(bad - hits, bad * (1 - share)) + part(good - misses, good * (1 - share)))
        above = (hits > 0) & (hits / bad >= lift * misses / good)
        marked |= above & _discoveries(np.where(above, ratio, 0.0), n, rate)
        lifted |= above
        frequent |= hits + misses >= 8
    toxic_kind = np.zeros(len(kinds), bool)
    for k, own in enumerate(of_kind):  # features: the form, then stems from short to long
        if any(marked[i] for i in own):
            toxic_kind[k] = next((bool(lifted[i]) for i in (own[0], *own[:0:-1]) if frequent[i]), True)
    return (toxic_kind[kind] & (labels[words.doc] == 1)).astype(np.float64)


def excerpt(text: bytes, most_words: int) -> bytes:
    """A text of at most most_words words, or else eight runs of its words, evenly spread, of as many in all."""
    words = text.split()
    if len(words) <= most_words:
        return text
    size = max(1, most_words // 8)
    starts = [k * (len(words) - size) // 7 for k in range(8)]
    return b" ".join(w for at in starts for w in words[at : at + size])


def train(docs: DataFrame, labels: DataFrame, usable, per_class: tuple[int, int] = (1500, 750), most_words: int = 4000, most_bytes: int = 1 << 17) -> ChainTagger | None:
    """Fit on at most as many documents of each label (0, 1) as per_class has, one row of each id (the least text).

    Of a document with more than most_words words, evenly spread runs are trained on, and of what is left most_bytes at
    most. Scoring has none of these bounds.
    """
    chosen = sample_ids(labels, "toxic", usable, per_class)  # bounded, so it may be broadcast
    counts = {r["label"]: r["n"] for r in label_counts(labels, "toxic", usable)}

    def excerpts(batches):
        for part in slices(batches):
            texts = [excerpt(t, most_words)[:most_bytes] for t in utf8_list(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(texts, pa.binary())], ["doc_id", "label", "text"])

    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    single = found.mapInArrow(excerpts, "doc_id long, label int, text binary").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = single.orderBy("label", F.xxhash64("doc_id"), "doc_id").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return ChainTagger(counts[1] / sum(counts.values())).fit(rows.column("text").to_pylist(), y)


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    out, at = [], 0
    for word, x in zip(text.split(), p):
        at = text.index(word, at)
        if x >= 0.5:
            out.append({"start": at, "end": at + len(word)})
        at += len(word)
    return out


def score(docs: DataFrame, model: ChainTagger | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and the offending spans, one row for each row of docs."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scored(batches):
        cache = BoundedCache(model.emission) if model else None
        for part in slices(batches):
            texts = utf8_list(part.column("text"))
            spans: list[list] = [[] for _ in texts]
            if model is None:
                values = np.full(len(texts), 0.5)
            else:
                words = Words(texts)
                p = marginals(np.fromiter(map(cache.__getitem__, words.flat()), np.float32, words.total), words.starts[:-1][words.counts > 0], model.transition, model.prior)
                values = model.score(p, words)
                for d in np.unique(words.doc[p >= 0.5]):
                    spans[d] = _spans(texts[d], p[words.starts[d] : words.starts[d + 1]])
                cache.trim()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array(spans, span)], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def usable_labels():
    return crc_mod("doc_id", 4) != 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), usable_labels())
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "spans")
