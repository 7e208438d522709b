"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are stripped of punctuation and lower-cased; numbers, names (capitalised
words inside a sentence) and units of measure become typed placeholders, whose values are kept as slots. A capitalised
word that opens a sentence may be a name or a plain word, so windows are made with both readings of each such word, of
items and documents alike. Windows of `WINDOW` canonical words are hashed; a fixed-size bitmap of the benchmark's window hashes (its size doesn't depend
on any table) drops nearly all document windows where they arise, and the others meet the benchmark's windows in a
hash join. Matches on one diagonal (document position minus item position) belong together: a document is flagged
if a diagonal covers `RUN` windows or all of the item, and if its slots are consistent, that is each value in the
item has one value in the document throughout. So exact copies and re-parameterised questions are caught. The plain
reading of opening words is also judged by itself, so that the other one never hides what it finds.

Windows need `SOLID` words that are no placeholders. So that windows of numbers, names or units alone aren't lost,
every window is also searched for as it stands: words without placeholders, and numbers of the same value. These exact
windows count with the others, and by themselves; a diagonal of them covers an item if it has all of its windows.

An item of fewer than WINDOW words is searched as one window of its length, one of a single word thus by that word. A
passage of a longer item counts from WINDOW + RUN - 1 canonical words on; shorter ones are taken for chance.

Defined cases: null and empty texts and those without a letter or digit match nothing; repeated rows of documents count
once; null ids are reported as null, and the stage drops their contaminated rows as well, as it knows rows by id and text;
of items alike the least id is reported; an empty table gives an empty result; further columns are ignored (in the
stage they pass through, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARRAY_BYTES, POWERS, ByteWords, fresh, materialize, mix, slices, table, utf8_list

WINDOW = 8
RUN = 6
#: Fewest words of a window that are no placeholders.
SOLID = 4
BITS = 24
#: Readings of windows that are made at once.
READINGS = 1 << 17
# Units that become a placeholder.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs min mins h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees watt watts volt volts mph kmh kph".split()
#: Kinds of windows.
PLAIN, NAMED, EXACT = 0, 1, 2
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))

_fold = np.zeros(256, np.uint64)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80:
        _fold[_b] = _c + 1
_digit = np.zeros(256, bool)
_digit[0x30:0x3A] = True
_upper = np.zeros(256, bool)
_upper[0x41:0x5B] = True
_stop = np.zeros(256, bool)
_stop[[*b".!?:;\"\n"]] = True


class Canonical:
    """Canonical words of a slice of texts: text number, place in the text, hash, and whether it is a slot."""

    def __init__(self, texts: list[bytes]):
        words = self.words = ByteWords(texts)
        data = words.data
        values = _fold[data]
        if len(data):
            capital = np.zeros(len(data), bool)  # of Latin letters in two bytes
            capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            values = values + np.uint64(32) * capital
        token = plain = words.hashes(values)
        solid = words.any(values != 0)
        if len(token):
            first = data[words.starts]
            second = data[np.minimum(words.starts + 1, len(data) - 1)]
            large = _upper[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            opens = np.ones(len(token), bool)
            opens[1:] = (words.doc[1:] != words.doc[:-1]) | _stop[data[words.ends[:-1] - 1]] | (data[words.ends[:-1]] == 10)
            numbers, names = words.any(_digit[data]), large & ~opens
            opening = large & opens & ~numbers
            known = _unit_hashes()
            units = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
            token = np.where(numbers, NUMBER, np.where(names, NAME, np.where(units, UNIT, token)))
            slot = numbers | names | units
        else:
            slot = opening = numbers = np.zeros(0, bool)
        self.at = np.flatnonzero(solid)
        self.doc, self.token, self.slot = words.doc[self.at], token[self.at], slot[self.at]
        self.opening, self.plain, self.number = opening[self.at], plain[self.at], numbers[self.at]
        begins = np.searchsorted(self.doc, np.arange(len(texts)))
        self.place = np.arange(len(self.doc)) - begins[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def windows(self, width: int):
        """(kind, index of the first word, hash, names) of the windows inside texts.

        Kind PLAIN reads no opening word as a name; NAMED reads those as names whose places are set in the bits of names;
        both need enough words that are no slots. EXACT windows have no placeholders.
        """
        n = len(self.token) - width + 1
        if n <= 0:
            return
        total = np.full(n, mix(np.array([width], np.uint64))[0])
        for k in range(width):
            total += self.token[k : n + k] * POWERS[k]
        firm = np.concatenate([[0], np.cumsum(~self.slot)])
        firm, need = firm[width:] - firm[:n], max(1, min(SOLID, width - 1))
        inside = self.doc[:n] == self.doc[width - 1 :]
        fit = np.flatnonzero(inside & (firm >= need))
        yield PLAIN, fit, mix(total[fit]), np.zeros(len(fit), np.int64)
        before = np.concatenate([[0], np.cumsum(self.opening)])
        many, where = (before[width:] - before[:n])[fit], np.flatnonzero(self.opening)
        for k in np.unique(many[many > 0]).tolist():
            own, step = fit[many == k], max(1, READINGS >> k)
            for start in range(0, len(own), step):
                at = own[start : start + step]
                word = where[before[at] + np.arange(k)[:, None]]
                delta, loss, bit = (NAME - self.token[word]) * POWERS[word - at], (~self.slot[word]).astype(np.int64), 1 << (word - at)
                sums, left, names, chosen = total[at][None], firm[at][None], np.zeros((1, len(at)), np.int64), np.zeros(1, np.int64)
                for i in range(k):  # every reading so far, with this word as a name too
                    more = np.flatnonzero(chosen < width - need)
                    sums, left = np.concatenate([sums, sums[more] + delta[i]]), np.concatenate([left, left[more] - loss[i]])
                    names, chosen = np.concatenate([names, names[more] | bit[i]]), np.concatenate([chosen, chosen[more] + 1])
                keep = left >= need
                keep[0] = False
                yield NAMED, np.broadcast_to(at, keep.shape)[keep], mix(sums[keep]), names[keep]
        total = np.full(n, mix(np.array([width + (EXACT << 8)], np.uint64))[0])
        for k in range(width):
            total += self.plain[k : n + k] * POWERS[k]
        at = np.flatnonzero(inside)
        yield EXACT, at, mix(total[at]), np.zeros(len(at), np.int64)

    def slots(self, kind: int, start: int, width: int, names: int) -> list[str]:
        """Lower-cased values of the slots in a window (of an exact one, its numbers), in order."""
        data, out = self.words.data, []
        slot = self.number if kind == EXACT else self.slot
        for i in range(start, start + width):
            if slot[i] or names >> (i - start) & 1:
                w = self.at[i]
                raw = data[self.words.starts[w] : self.words.ends[w]].tobytes()
                out.append(raw.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}"))
        return out


def _unit_hashes() -> np.ndarray:
    if not _units:
        words = ByteWords([u.encode() for u in UNITS])
        _units.append(np.sort(words.hashes(_fold[words.data])))
    return _units[0]


_units: list[np.ndarray] = []
_item_schema = "item_id long, n_windows int, n_typed int, width int, item_kind int, item_pos int, h long, item_slots array<string>"
_hit_schema = "doc_id long, mark long, kind int, pos int, h long, slots array<string>"


def _item_windows(batches):
    for part in slices(batches, limit=ARRAY_BYTES):
        canon = Canonical(utf8_list(part.column("text")))
        ids = part.column("item_id").to_pylist()
        rows = []
        for width in range(1, WINDOW + 1):
            for kind, at, h, names in canon.windows(width):
                owner = canon.doc[at]
                mine = canon.counts[owner] >= WINDOW if width == WINDOW else canon.counts[owner] == width
                at, h, names, owner = at[mine], h[mine].view(np.int64), names[mine], owner[mine]
                if kind == PLAIN:
                    many = np.bincount(owner, minlength=len(ids))
                rows += [(ids[o], int(canon.counts[o]) - width + 1, int(many[o]), width, kind, int(canon.place[i]), int(x), canon.slots(kind, int(i), width, int(b))) for i, x, b, o in zip(at, h, names, owner)]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["item_id", "n_windows", "n_typed", "width", "item_kind", "item_pos", "h", "item_slots"])


def _bitmap(windows: DataFrame) -> np.ndarray:
    """2^BITS bits, one set for each window hash; folded on the executors into words of 32 bits."""
    slot = F.shiftrightunsigned("h", 64 - BITS)
    words = windows.select(F.shiftright(slot, 5).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - BITS}) & 31 AS INT))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, mark, item_id, n_windows_hit, n_windows, shift: diagonals that show a contamination; mark is the text's hash."""
    windows = materialize(items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_windows, _item_schema), "items")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # WINDOW values at most
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))  # 2 MB whatever the tables

    def hits(batches):
        bits = shared.value
        for part in slices(batches, limit=ARRAY_BYTES):
            canon = Canonical(utf8_list(part.column("text")))
            rows = []
            for width in widths:
                for kind, at, h, names in canon.windows(width):
                    top = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    seen = np.flatnonzero((bits[top >> 5] >> (top & 31).astype(np.uint32)) & 1)
                    rows += [(int(canon.doc[i]), kind, int(canon.place[i]), int(x), canon.slots(kind, int(i), width, int(b))) for i, x, b in zip(at[seen], h[seen].view(np.int64), names[seen])]
            if rows:
                doc, kind, pos, h, slots = zip(*rows)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("mark").take(at), pa.array(kind, pa.int32()), pa.array(pos, pa.int32()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string()))], ["doc_id", "mark", "kind", "pos", "h", "slots"])

    found = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(hits, _hit_schema).join(windows, "h").filter((F.col("kind") != EXACT) | (F.col("slots") == F.col("item_slots")))
    pairs = F.expr("transform(arrays_zip(item_slots, slots), p -> struct(p.item_slots AS item, p.slots AS doc))")
    kind = F.greatest("kind", "item_kind")
    sets = {"plain": kind == PLAIN, "typed": kind != EXACT, "exact": kind == EXACT}
    places = [F.size(F.collect_set(F.when(which, F.col("item_pos")))).alias(f"n_{name}_hit") for name, which in sets.items()]
    values = [F.array_distinct(F.flatten(F.collect_set(F.when(sets[name], pairs)))).alias(f"{name}_pairs") for name in ("plain", "typed")]
    diagonals = found.groupBy("doc_id", "mark", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.size(F.collect_set("item_pos")).alias("n_windows_hit"), F.max("n_windows").alias("n_windows"), F.max("n_typed").alias("n_typed"), *places, *values
    )
    plain, typed = (F.expr(f"size({c}) = size(array_distinct(transform({c}, p -> p.item)))") for c in ("plain_pairs", "typed_pairs"))  # consistent
    enough = lambda n, of: (F.col(n) > 0) & (F.col(n) >= F.least(F.col(of), F.lit(RUN)))
    shown = (enough("n_plain_hit", "n_typed") & plain) | ((enough("n_typed_hit", "n_typed") | enough("n_windows_hit", "n_windows")) & typed) | enough("n_exact_hit", "n_windows")
    return diagonals.filter(shown).select("doc_id", "mark", "item_id", "shift", "n_windows_hit", "n_windows")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, item_id (the least) and n_windows_hit (the most on a diagonal) of each flagged document."""
    return matches(docs, items).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"), F.max("n_windows_hit").alias("n_windows_hit"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text is contaminated; a row is known by its id, which may be null, and its text."""
    gone = matches(docs, items).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    (mark,) = fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    left = marked.join(gone, marked["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (marked[mark] == gone["gone_mark"]), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
