"""Column expressions over texts: words, keywords, overlap, chunks, roles, names and the hash embedding."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "the and for are but not you all can her was one our out has have had this that with they from been said each which their will other "
    "about many then them these some would into"
).split()
# Separators of the hash embedding's tokens.
SEPARATORS = " \n\r\t.,(){}[];:<>=/*+-!?\"'\\"
# Parts of a file name that tell its role, in the order they are tried.
ROLES = (("prompts", ("prompt",)), ("universe", ("universe", "glossary", "lore")), ("characters", ("character", "npc")), ("locations", ("location", "place", "world")))
#: A blank line between paragraphs.
BREAK = r"\n[\f\n\r\t\x0B\x85\p{Z}]*\n"


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9']+"), lambda w: w != "")


def keywords(text: Column, most: int = 200) -> Column:
    """The first distinct words of three characters or more that are no stop words."""
    plain = F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))  # distinct, in the order of their first places
    return F.slice(F.filter(plain, lambda w: F.length(w) >= 3), 1, most)


def overlap(query: Column, found: Column) -> Column:
    """Share of the query's words among the others; repeated query words count each time."""
    hits = let(found, lambda f: F.size(F.filter(query, lambda w: F.array_contains(f, w))))
    return F.when(F.size(query) > 0, F.coalesce(hits, F.lit(0)) / F.size(query)).otherwise(0.0)


def chunks(text: Column, size: int) -> Column:
    """A text of at most size characters whole; else its paragraphs (split at blank lines), joined while they fit.

    A paragraph is joined by a blank line, which isn't counted in the test, to an open chunk that has any character.
    Blank paragraphs at the ends of a text or chunk therefore stay as blank lines.
    """
    parts = F.split(text, BREAK)
    state = "struct<done: array<string>, open: string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s, p):
        full = (F.length(s["open"]) + F.length(p) > size) & (s["open"] != "")
        fresh = F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open"))
        longer = F.struct(s["done"].alias("done"), F.when(s["open"] != "", F.concat(s["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"))
        return F.when(full, fresh).otherwise(longer).cast(state)

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.aggregate(parts, start.cast(state), add, end))


#: The same for Python's expressions.
_BREAK = re.compile("\n[\f\n\r\t\x0b\x85" + "".join(chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c))[0] == "Z") + "]*\n")
_WORD = re.compile("[a-z0-9']+")
_NO_KEYWORDS = frozenset(STOP_WORDS)


def word_list(text: str) -> list[str]:
    """words() of a Python string."""
    return _WORD.findall(text.lower())


def first_keywords(text: str, most: int = 200) -> set[str]:
    """The words of keywords(), as a set; a text is read no further than to the last of them."""
    found: set[str] = set()
    for m in _WORD.finditer(text.lower()):
        w = m[0]
        if len(w) >= 3 and w not in found and w not in _NO_KEYWORDS:
            found.add(w)
            if len(found) >= most:
                break
    return found


def chunk_list(text: str, size: int) -> list[str]:
    """chunks() of a Python string."""
    if len(text) <= size:
        return [text]
    done, part, length = [], [], 0  # the open chunk's paragraphs and its length
    for p in _BREAK.split(text):
        if length and length + len(p) > size:
            done.append("\n\n".join(part))
            part, length = [p], len(p)
        elif length:
            part.append(p)
            length += 2 + len(p)
        else:
            part, length = [p], len(p)
    return [*done, "\n\n".join(part)] if length else done


def role(name: Column) -> Column:
    """Role of a document by its file name; the first rule that holds."""
    lower, out = F.lower(name), F.lit("reference")
    for label, parts in reversed(ROLES):
        out = F.when(lower.rlike("|".join(parts)), label).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    """Lower-cased name with spaces as underscores and nothing but letters, digits and underscores."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def prompt_file_name(number: Column, title: Column) -> Column:
    return F.concat(F.lit("prompt_"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), safe_name(title))


def lora_tag(name: Column, weight: Column) -> Column:
    """The tag of a named adapter, its weight with one decimal; null without a name."""
    return F.when(F.length(name) > 0, F.format_string("<lora:%s:%.1f>", name, F.round(weight, 1)))


def proper_nouns(text: Column, names: list[str]) -> Column:
    """Distinct names of the given list that stand in a text as whole words, in the order of their first places."""
    if not names:
        return F.array().cast("array<string>")
    escaped = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in names)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)\b({escaped})\b"), 1))


def utf16_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code units of all texts, and start, end and text number of each token."""
    units = np.frombuffer(" ".join(texts).encode("utf-16-le", "surrogatepass") + b" \0", np.uint16) if texts else np.zeros(0, np.uint16)
    blank = np.isin(units, np.frombuffer(SEPARATORS.encode("utf-16-le"), np.uint16))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts), np.int64, len(texts)) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])[: len(texts)]
    return units, starts, ends, np.searchsorted(begins, starts, "right") - 1


def hash_tokens(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """djb2 with exclusive or over each token's code units, in 32 bits; all tokens take a step at once."""
    out = np.full(len(starts), 5381, np.uint32)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    left, size = order, length[order]
    for k in range(int(size[0]) if len(size) else 0):
        left = left[: np.searchsorted(-size[: len(left)], -k)]
        out[left] = (out[left] * np.uint32(33)) ^ units[starts[left] + k]
    return out


def hash_dimension(hashes: np.ndarray, dims: int) -> np.ndarray:
    """Absolute value of the signed hash, modulo dims."""
    return np.abs(hashes.view(np.int32).astype(np.int64)) % dims


#: Texts of so many characters are hashed at once.
SLICE = 1 << 20


def hash_embedding(df: DataFrame, dims: int = 768, scale: int = 1_000_000, text: str = "text", dense: bool = False) -> DataFrame:
    """df with e, entries (d, v): scale times the number of tokens of each dimension; a text without tokens is (0, 1).

    dense: with vec instead, the float array of v / scale with zeros.

    The hash runs over code units, which no built-in function yields; it is done for a batch of texts at a time.
    """
    if dims < 8 or scale <= 0:
        raise ValueError("at least 8 dimensions and a positive scale")
    out = "vec" if dense else "e"
    kept = [c for c in df.columns if c != out]
    rows = df.select(*(F.col(f"`{c}`") for c in kept))
    entry = pa.struct([("d", pa.int32()), ("v", pa.int64())])

    def entries(texts: list[str]) -> pa.Array:
        units, starts, ends, doc = utf16_tokens(texts)
        found, n = np.unique(doc * dims + hash_dimension(hash_tokens(units, starts, ends), dims), return_counts=True)
        empty = np.flatnonzero(np.bincount(doc, minlength=len(texts)) == 0)
        place, value = np.concatenate([found, empty * dims]), np.concatenate([n * scale, np.ones(len(empty), np.int64)])
        if dense:
            flat = np.zeros(len(texts) * dims, np.float32)
            flat[place] = value / scale
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(flat))
        order = np.argsort(place)
        place, value = place[order], value[order]
        cuts = np.searchsorted(place, np.arange(len(texts) + 1) * dims).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array((place % dims).astype(np.int32)), pa.array(value.astype(np.int64))], fields=list(entry))
        return pa.ListArray.from_arrays(pa.array(cuts), each)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            part = np.cumsum([len(t) for t in texts]) // SLICE if texts else np.zeros(0, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, entries(texts[a:b])], [*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(hashed, f"{schema}, vec array<float>" if dense else f"{schema}, e array<struct<d: int, v: bigint>>")
