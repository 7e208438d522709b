"""SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprint: majority of the bits of the XXH64 (seed 42) of all 4-word shingles. Documents are linked if their
fingerprints differ in 4 bits or fewer. The 64 bits are cut into 4 + e segments; four errors leave e of them intact,
so each choice of e segments gives exact bits of a key. Of the other bits, two words of up to 23 are taken; at most
four errors fall on the two, so one word has two or fewer. In the perfect (23, 12) Golay code, two words at distance 2
or less always have a codeword within distance 4 of both (take the codeword within 3 of a word between them), and a
word has one such codeword or six. So each fingerprint gets keys of (segments, their bits, word, 12-bit index of a
nearby codeword), and linked fingerprints share a key whatever e is. e follows the number of distinct fingerprints:
1 up to `FEW` (about 53 keys of 25 bits each), then 2 (about 160 of 33 bits), then 3 (about 370 of 39 bits), so the
candidates of a fingerprint don't grow with the corpus. Only distinct fingerprints take part; buckets
of more than `CHUNK` are split into pairs of chunks; candidates are verified by their distance, and each bucket
yields a spanning forest instead of all its pairs. Components are then found by star contraction.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows share
their component; null ids are kept, and take part as the lowest ids do (their component_id is that of the
others, or null); an empty table gives an empty result; further columns are ignored (in the stage they pass through,
whatever their names and types).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, skew_join, slices, table, utf8_list
from .components import components

SHINGLE = 4
DISTANCE = 4
#: Most distinct fingerprints for one, and for two, exact segments in a key.
FEW = (1 << 20, 1 << 27)
CHUNK = 4096
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011

_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)
_lanes = np.array([[sum(((b >> (4 * half + j)) & 1) << (16 * j) for j in range(4)) for b in range(256)] for half in (0, 1)], np.uint64)
#: Shingles of a text that are summed at once; the lanes hold 16 bits.
_RUN = 60_000


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return [_hash(b" ".join(words))] if words else []
    return list(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Majority bits of the shingle hashes of each text; zero without words."""
    lists = [shingle_hashes(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.zeros(len(texts), np.uint64)
    total = int(counts.sum())
    if not total:
        return out
    flat = np.fromiter((h for x in lists for h in x), np.uint64, total)
    ends = np.cumsum(counts)
    runs = [(d, a) for d in np.flatnonzero(counts).tolist() for a in range(int(ends[d] - counts[d]), int(ends[d]), _RUN)]
    doc, start = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    octets = flat.astype("<u8").view(np.uint8).reshape(-1, 8)
    for bit in range(0, 64, 4):
        sums = np.add.reduceat(_lanes[bit // 4 % 2][octets[:, bit // 8]], start)
        for j in range(4):
            ones = np.bincount(doc, (sums >> np.uint64(16 * j)) & np.uint64(0xFFFF), len(texts))
            out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit + j)
    return out


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and error patterns of weight 4 or less by syndrome.

    patterns: 2048 x 6, padded with -1.
    """
    def syndrome(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    single = [syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    found[0].append(0)
    level = [(0, 0, -1)]
    for _ in range(4):
        level = [(x | 1 << i, s ^ single[i], i) for x, s, last in level for i in range(last + 1, 23)]
        for x, s, _ in level:
            found[s].append(x)
    patterns = np.full((2048, 6), -1, np.int64)
    for s, x in enumerate(found):
        patterns[s, : len(x)] = x
    return low, high, patterns


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords within distance 4 of 23-bit words: n x 6, padded with -1."""
    low, high, patterns = golay()
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ np.maximum(errors, 0)) >> 11)


@functools.cache
def segments(exact: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(exact pieces, other pieces) as (first bit, bits), for each choice of `exact` of the DISTANCE + exact segments."""
    n = DISTANCE + exact
    cuts = [64 * k // n for k in range(n + 1)]
    pieces = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [([pieces[i] for i in some], [x for i, x in enumerate(pieces) if i not in some]) for some in itertools.combinations(range(n), exact)]


def _gather(x: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(x), np.uint64), 0
    for first, width in pieces:
        out |= ((x >> np.uint64(first)) & np.uint64((1 << width) - 1)) << np.uint64(at)
        at += width
    return out


def fuzzy_keys(prints: np.ndarray, exact: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each fingerprint."""
    x = prints.astype(np.uint64)
    rows, keys = [], []
    for s, (fixed, others) in enumerate(segments(exact)):
        bits, rest = _gather(x, fixed).astype(np.int64), _gather(x, others)
        for w in (0, 1):
            word = ((rest >> np.uint64(23 * w)) & np.uint64((1 << 23) - 1)).astype(np.int64)
            codes = nearby_codewords(word)
            row, k = np.nonzero(codes >= 0)
            rows.append(row)
            keys.append(((2 * s + w) << 44) | (bits[row] << 12) | codes[row, k])
    return np.concatenate(rows), np.concatenate(keys)


def _print_rows(batches):
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(utf8_list(part.column("text"))).view(np.int64)), part.column("mark")], ["doc_id", "fp", "mark"])


def _key_rows(exact: int):
    size = 20_000 // len(segments(exact)) * 5

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                prints = batch.column("fp").slice(start, size).to_numpy(zero_copy_only=False)
                row, key = fuzzy_keys(prints.view(np.uint64), exact)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "fp"])

    return rows


def forest(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) pairs that span the components within each group of equal consecutive numbers."""
    n = len(prints)
    label = np.arange(n)
    x = prints.view(np.uint64)
    at, step = np.arange(n), 1
    while len(at):
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        near = at[np.bitwise_count(x[at] ^ x[at + step]) <= DISTANCE]
        near = near[label[near] != label[near + step]]
        if len(near):
            parent: dict[int, int] = {}

            def root(i: int) -> int:
                while parent.get(i, i) != i:
                    parent[i] = parent.get(parent[i], parent[i])
                    i = parent[i]
                return i

            for a, b in set(zip(label[near].tolist(), label[near + step].tolist())):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            moved = np.arange(n)
            for i in list(parent):
                moved[i] = root(i)
            label = moved[label]
        step += 1
    tied = np.flatnonzero(label != np.arange(n))
    return prints[tied], prints[label[tied]]


def _forest_rows(batches):
    """Edges of sorted (key, pair) groups; the last group of a batch waits for its rest."""
    held: list[pa.RecordBatch] = []

    def edges(columns: list[np.ndarray]):
        change = np.any([np.diff(c) != 0 for c in columns[:2]], axis=0)
        group = np.concatenate([[0], np.cumsum(change)])
        u, v = forest(group, columns[2])
        found = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        now = [np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for a, c in zip(rest, ("key", "pair", "fp"))]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [c[cut:] for c in now]
        if cut:
            yield edges([c[:cut] for c in now])
    if len(rest[0]):
        yield edges(rest)


def print_links(distinct: DataFrame, exact: int | None = None) -> DataFrame:
    """u, v: edges between fingerprints (bigint column fp, distinct) that connect all those within DISTANCE."""
    if exact is None:
        n = distinct.count()
        exact = 1 + sum(n > most for most in FEW)
    keys = materialize(distinct.mapInArrow(_key_rows(exact), "key long, fp long"), "keys")
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    sized = skew_join(keys, sizes, ["key"], "n", keys.count(), "merge").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    paired = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("own", "other").cast("long") * (1 << 24) + F.greatest("own", "other")
    rows = paired.select("key", pair.alias("pair"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", "fp").mapInArrow(_forest_rows, "u long, v long").distinct()
    links = materialize(found, "links")
    discard(keys, sizes)
    return links


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, mark) of each row, mark being the text's hash; and (fp, root) of the distinct fingerprints."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    prints = materialize(rows.mapInArrow(_print_rows, "doc_id long, fp long, mark long"), "prints")
    groups = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("kept")), "groups")
    roots = components(print_links(groups.select("fp")))
    return prints, groups.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, one row for each row of docs."""
    prints, rooted = _rooted(docs)
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    named = skew_join(rooted, least, ["root"], "m", rooted.count()).select("fp", "n", "component_id")
    return skew_join(prints, materialize(named, "named"), ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least id (null ids first), then of the least text hash.

    Of rows alike in both, one stays, the least by the hash of its other columns.
    """
    _, rooted = _rooted(docs)
    kept = rooted.groupBy("root").agg(F.min("kept").alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark"))
    names = docs.columns
    mark, row = fresh(docs, "mark", "row")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = kept.select(F.col("kept_id").alias("kept_id"), F.col("kept_mark").alias("kept_mark"))
    rest = marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_mark"]), "left_semi")
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in ("doc_id", "text")))
    single = rest.groupBy("doc_id", mark).agg(F.min_by(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))), F.to_json(others)).alias(row))
    return single.select(*(F.col(f"`{row}`.c{i}").alias(c) for i, c in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
