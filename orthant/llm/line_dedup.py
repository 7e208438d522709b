"""Line dedup by a log-template tree.

Lines are split on newlines and into tokens on white space. Tokens that hold a digit, an address or a link are
variable fields, all alike. The tree has fixed depth: token count, then the leading tokens; its leaves hold
templates. Besides the masked line itself (the exact template of its leaf), a line of `LONG` tokens or more stands
for generalised templates in which one third of the tokens behind the leading ones is a run of variable fields:
lines of a leaf that differ only there share the template, whatever the fields hold. A template recurs if it is
found in `min_docs` documents (generalised: `min_general`; a line of fewer than `MIN_TOKENS` tokens, which prose may
repeat by chance: `min_short`); its lines are dropped from all documents but the one of the least id, which keeps them,
so a text is never lost altogether. A short line of variable fields only counts with its values, as nothing else tells
it from others.

Each document sends every template key once, so counting keys counts documents and pre-aggregates map-side. Templates
of more than a 1024th of all keys meet their lines in a broadcast join, of which there are so few at any size.
Decisions travel as line numbers; the text is joined to them once, by id and text hash.

Defined cases: null and empty texts stay as they are; of repeated rows none counts as another document, all are
treated alike; null ids count as id -1; blank lines stay; an empty table gives an empty result; other columns pass
through, whatever their names, but for n_lines_dropped, which is replaced (n_chars, if there, is recomputed for changed
texts).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, ByteWords, fresh, materialize, mix, powers, skew_join, slices, table, utf8_list

MIN_TOKENS = 4
LONG = 9
LEAD = 2
THIRDS = 3
EXACT, GENERAL, SHORT = 0, 1, 2
_mark = functools.partial(xxhash.xxh64_intdigest, seed=42)  # what xxhash64() of Spark SQL gives for a text
_values = np.arange(1, 257, dtype=np.uint64)
_values[[9, 10, 11, 12, 13, 32]] = 0
_field = np.zeros(256, bool)
_field[[*b"0123456789@"]] = True
_FIELD, _COUNT = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)
_KINDS = np.array([0, 0x632BE59BD9B4E019, 0x2545F4914F6CDD1D, 0x27D4EB2F165667C5], np.uint64)


def template_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, key) of all templates, by text and line; the last two bits of a key are `EXACT`, `SHORT` or `GENERAL`."""
    words = ByteWords(texts)
    none = np.zeros(0, np.int64)
    if not len(words.starts):
        return none, none, none
    data = words.data
    slash = np.zeros(len(data), bool)
    slash[1:] = (data[1:] == 47) & (data[:-1] == 47)
    token = words.hashes(_values[data])
    field = words.any(_field[data] | slash)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts)
    first = np.flatnonzero(np.concatenate([[True], np.diff(line) > 0]))
    n = np.diff(np.concatenate([first, [len(token)]]))
    bare = (n < MIN_TOKENS) & (np.add.reduceat(field, first, dtype=np.int64) == n)
    token[field & ~np.repeat(bare, n)] = _FIELD
    order = np.arange(len(token)) - np.repeat(first, n)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token * powers(order), dtype=np.uint64)])

    lead = np.minimum(n, LEAD)
    cuts = [first + lead + (n - lead) * k // THIRDS for k in range(THIRDS + 1)]
    leaf = upto[cuts[0]] - upto[first] + mix(n.astype(np.uint64) + _COUNT)
    thirds = [upto[b] - upto[a] for a, b in zip(cuts, cuts[1:])]
    total = leaf + thirds[0] + thirds[1] + thirds[2]
    exact = mix(total) & ~np.uint64(3) | np.where(n < MIN_TOKENS, np.uint64(SHORT), np.uint64(EXACT))
    general = [mix((total - t) ^ k) & ~np.uint64(3) | np.uint64(GENERAL) for t, k in zip(thirds, _KINDS[1:])]
    doc = words.doc[first]
    number = line[first] - np.searchsorted(breaks, words.text_starts)[doc]
    long = np.flatnonzero(n >= LONG)
    rows = np.concatenate([np.arange(len(n)), *[long] * THIRDS])
    keys = np.concatenate([exact, *(g[long] for g in general)])
    rank = np.argsort(rows, kind="stable")
    return doc[rows[rank]], number[rows[rank]], keys[rank].view(np.int64)


_LINES = "doc_id long, mark long, n_keys int, keys array<long>, lines array<array<int>>"


def _line_keys(batches):
    """Each text's distinct keys, and for each the numbers of its lines."""
    for part in slices(batches, limit=ARRAY_BYTES):
        texts = utf8_list(part.column("text"))
        doc, line, key = template_keys(texts)
        order = np.lexsort((line, key, doc))
        doc, line, key = doc[order], line[order], key[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
        cuts = np.searchsorted(doc[new], np.arange(len(texts) + 1)).astype(np.int32)
        marks = np.fromiter(map(_mark, texts), np.uint64, len(texts)).view(np.int64)
        each = pa.ListArray.from_arrays(pa.array(np.append(new, len(line)).astype(np.int32)), pa.array(line.astype(np.int32)))
        lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (pa.array(key[new]), each)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks), pa.array(np.diff(cuts)), *lists], ["doc_id", "mark", "n_keys", "keys", "lines"])


def recurring(keys: DataFrame, min_docs: int, min_general: int, min_short: int) -> DataFrame:
    """key, first, n: templates found in enough documents, the least id that has them, and the number of rows that do."""
    each = keys.select(F.explode("keys").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("d"))
    counted = each.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))
    kind = F.col("key").bitwiseAND(3)
    enough = F.when(kind == EXACT, F.lit(min_docs)).when(kind == SHORT, F.lit(min_short)).otherwise(F.lit(min_general))
    return counted.filter((F.col("n") >= enough) & (F.col("last") > F.col("first"))).select("key", "first", "n")


def line_dedup(docs: DataFrame, min_docs: int = 2, min_general: int = 3, min_short: int = 8, counted: bool = True) -> DataFrame:
    """docs with recurring lines dropped, and if counted, n_lines_dropped appended (or replaced)."""
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    keys = materialize(plain.mapInArrow(_line_keys, _LINES), "lines")
    found = materialize(recurring(keys, min_docs, min_general, min_short), "templates")
    total = keys.agg(F.sum("n_keys")).first()[0] or 0
    each = keys.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "mark", F.explode(F.arrays_zip("keys", "lines")).alias("x"))
    hits = skew_join(each.select("d", "mark", F.col("x.keys").alias("key"), F.col("x.lines").alias("lines")), found, ["key"], "n", total).filter("d > first")
    at, mark, drop = fresh(docs, "d", "mark", "drop")
    drops = hits.groupBy(F.col("d").alias(at), F.col("mark").alias(mark)).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias(drop))
    names = [c for c in docs.columns if c != "n_lines_dropped" or not counted]
    marked = docs.withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), mark: F.xxhash64("text")})
    joined = marked.join(drops, [at, mark], "left")
    # The text is split once: the lambda's variable holds its lines.
    left = F.expr(f"transform(array(split(text, '\\n', -1)), x -> array_join(transform(array_except(sequence(0, size(x) - 1), `{drop}`), i -> x[i]), '\n'))[0]")
    changed = F.col(f"`{drop}`").isNotNull()
    out = {"text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in names:
        out["n_chars"] = F.when(changed, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    columns = [out[c].alias(c) if c in out else F.col(f"`{c}`") for c in names]
    dropped = F.when(changed, F.size(F.col(f"`{drop}`"))).otherwise(0).alias("n_lines_dropped")
    return joined.select(*columns, dropped) if counted else joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_dropped")
