"""License scans: ordered signature rules gated by a keyword prefilter, with overlapping detections resolved.

An Aho-Corasick automaton finds the rules' keywords in a text; only rules with a keyword there are matched.
Detections are taken in the order of priority, then length, then place; one that lies within a detection already
taken is suppressed. Besides the method's labels, the base phrases are counted and their labels always stay.

Defined cases: null and empty texts have no words, labels "" and score 0; repeated rows and null ids are scanned
each; of equal detections the rule written first is taken; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8_list
from .license_rules import rules

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Every byte that is no part of a word becomes a space, and A-Z lower case.
_words = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_base = [(re.compile(rb"(?<!\S)(?=%s(?!\S))" % phrase.encode()), label, phrase.split()[0].encode()) for phrase, label in BASE]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,word:long,n_words:long,priority:int>>"


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.gate = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by.setdefault(rule.keyword, []).append(i)
        for keyword, numbers in by.items():
            self.gate.add_word(f" {keyword} ", numbers)
        self.gate.make_automaton()

    def detections(self, joined: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in characters of the joined words; containment-suppressed."""
        hit = {i for _, numbers in self.gate.iter(f" {joined} ") for i in numbers}
        found = [(self.rules[i].priority, m.start() - m.end(), m.start(), m.end(), i) for i in sorted(hit) for m in self.rules[i].pattern.finditer(joined)]
        taken: list[tuple[int, int, int]] = []  # by start; kept ones never contain each other, so ends rise too
        for _, _, start, end, i in sorted(found):
            at = bisect_right(taken, (start, len(joined) + 1, 0))
            if at and taken[at - 1][1] >= end:
                continue
            if at < len(taken) and taken[at][1] <= end:  # a weaker rule around a stronger one
                continue
            taken.insert(at, (start, end, i))
        return taken

    def scan(self, text: bytes) -> tuple:
        plain = text.translate(_words)
        words = plain.split()
        places: list[int] = []
        base: set[str] = set()
        found: list[dict] = []
        present = set(words) if b"license" in plain or b"by" in plain else ()
        hits = [(pattern, label) for pattern, label, lead in _base if lead in present]
        if hits:
            joined = b" ".join(words)
            starts = _starts(words)
            for pattern, label in hits:
                own = [bisect_left(starts, m.start()) for m in pattern.finditer(joined)]
                places += own
                base |= {label} if own else set()
        keyed = b" ".join(words).decode("utf-8", "replace")
        taken = self.detections(keyed)
        if taken:
            starts = _starts(keyed.split(" "))
            for start, end, i in taken:
                rule = self.rules[i]
                word = bisect_left(starts, start)
                found.append({"label": rule.label, "word": word, "n_words": bisect_left(starts, end) - word, "priority": rule.priority})
        labels = sorted(base | {x["label"] for x in found})
        covered = sum(x["n_words"] for x in found)
        score = 0.0 if not labels else min(1.0, 0.5 + 0.5 * min(1.0, 4 * covered / max(len(words), 1)))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, found


def _starts(words: list) -> list[int]:
    """Where each of the joined words begins."""
    return [0, *itertools.accumulate(len(w) + 1 for w in words)][:-1]


_scanner: list[Scanner] = []


def _rows(batches):
    if not _scanner:
        _scanner.append(Scanner())
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for part in slices(batches):
        columns = zip(*map(_scanner[0].scan, utf8_list(part.column("text"))))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)


def license_scan(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
