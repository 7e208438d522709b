"""Token counts from a BPE vocabulary compiled, as it is met, into a deterministic finite-state transducer.

A BPE encoding is valid just if each two neighbouring tokens are, so the last token of a prefix's encoding is the
one token ending there that is valid behind the last token of what precedes it. A state therefore needs only, for
the last `reach` characters, the last token at each and the token count relative to now: finitely many states.
Reading a character leads to the next state and emits the change of the token count, the transition's annotation.
States and transitions are made on first use and kept; a full machine is emptied and made anew.

Runs of spaces merge last, as in the library: a word behind k > 1 spaces is read from a start state of its own, in which
a first token of the space alone emits what the k-th space adds to the run's count. So the state decides, once the word
is read, whether the last space joins it.

A text longer than `CHUNK` is cut into chunks, and each chunk becomes a state map: a function from the state before the
chunk to the state behind it and the tokens emitted. Behind the first border of words all states fall together, so a map
holds the characters up to there and one exit state and count; a chunk without a border keeps the trace of states from
the start state, and any other state is followed only until it meets the trace. Maps compose associatively, in pairs,
pairs of pairs and so on (the up-sweep of a parallel prefix scan); a composed map remembers what lies behind its first
part's usual exit, so no text is read again. A text is one row, so its maps are composed in the task that has it. Words
met before are single transitions from the start state, kept in a cache.

Characters without a piece are counted as their bytes (byte fallback). The vocabulary file is read here; the library
isn't needed.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows and null ids are counted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, slices, table

SPACE = "▁"
CHUNK = 1 << 14
LIMIT = 4096
MOST_STATES = 250_000
#: Kinds of pieces in the model file: normal, and user-defined.
_NORMAL, _USER = 1, 4


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if wire == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def read_pieces(path: str) -> dict[str, float]:
    """Score of each normal piece in a model file."""
    out = {}
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, _NORMAL) in (_NORMAL, _USER):
                    out[piece[1].decode()] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
    return out


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """BPE by definition: the pair of the best score is joined, the leftmost of equals, until none is left."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


class Transducer:
    """States are numbers; `step` has the next state and the change of the token count for a state and a character."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.longest = max(map(len, pieces), default=1)
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.atoms: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []  # context, then (last token, relative count) at its borders
        self.index: dict[tuple, int] = {}
        self.step: dict[int, int] = {}  # state and character: next state and change of the count

    @staticmethod
    @functools.cache
    def start(extra: int = 0) -> tuple:
        """The state before a word; a first token of the space alone counts 1 + extra. A number stands for the last token."""
        return "", ((extra, 0),)

    def number(self, state: tuple) -> int:
        found = self.index.get(state)
        if found is None:
            found = self.index[state] = len(self.states)
            self.states.append(state)
        return found

    def whole(self, piece: str) -> bool:
        """Whether a piece is the encoding of its own characters."""
        if piece not in self.atoms:
            self.atoms[piece] = len(piece) == 1 or merge(list(piece), self.scores) == [piece]
        return self.atoms[piece]

    def valid(self, left: str | int, right: str) -> bool:
        """Whether right can follow left: together they encode to these two."""
        if isinstance(left, int):
            return True
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            self.pairs[key] = merge(list(left + right), self.scores) == [left, right]
        return self.pairs[key]

    def move(self, key: int) -> int:
        """Compile the transition of a state on a character: key is state << 21 | code point.

        The result is next state << 8 | change of the count + 128. Borders at which no piece can begin that goes
        on behind the context are left out of a state, so that fewer states differ.
        """
        context, borders = self.states[key >> 21]
        text = context + chr(key & 0x1FFFFF)
        size, scores, prefixes = len(text), self.scores, self.prefixes
        for start in range(size):  # the longest candidate first
            border = borders[start]
            if border is None:
                continue
            token = text[start:]
            if (size - start == 1 or token in scores and self.whole(token)) and self.valid(border[0], token):
                break
        count = border[1] + (1 if token in scores else len(token.encode()))
        if token == SPACE and isinstance(border[0], int):
            count += border[0]
        keep = 0
        while keep < size and text[keep:] not in prefixes:
            keep += 1
        new = (text[keep:], (*((x[0], x[1] - count) if (x := borders[i]) is not None and (i == keep or text[i:] in prefixes) else None for i in range(keep, size)), (token, 0)))
        self.step[key] = out = self.number(new) << 8 | count + 128
        return out

    def walk(self, state: tuple, text: str, trace: list | None = None) -> tuple[tuple, int, int]:
        """(state, tokens emitted, characters read); ends early where a trace from another state is met."""
        if len(self.states) > MOST_STATES:
            self.reset()
        now, total, step, move = self.number(state), 0, self.step, self.move
        if trace is None:
            for char in text:
                key = now << 21 | ord(char)
                found = step.get(key) or move(key)
                now = found >> 8
                total += (found & 255) - 128
            return self.states[now], total, len(text)
        for i, char in enumerate(text):
            key = now << 21 | ord(char)
            found = step.get(key) or move(key)
            now = found >> 8
            total += (found & 255) - 128
            if self.states[now] == trace[i][0]:
                return self.states[now], total, i + 1
        return self.states[now], total, len(text)

    def trace(self, text: str) -> list[tuple[tuple, int]]:
        """(state, tokens emitted so far) behind each character, from the start state."""
        out, state, total = [], self.start(), 0
        for char in text:
            state, more, _ = self.walk(state, char)
            total += more
            out.append((state, total))
        return out


_word = re.compile(f"{SPACE}+[^{SPACE}]*")
_part = re.compile(f"{SPACE}+|[^{SPACE}]+")
_border = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Counter:
    """Counts over words. A state is (length of the open run of spaces, state of the transducer in the open word)."""

    def __init__(self, path: str):
        self.machine = Transducer(read_pieces(path))
        self.start = (0, self.machine.start())
        self.words = BoundedCache(self.count_word)
        self.runs: dict[int, int] = {}

    def run(self, n: int) -> int:
        """Tokens of n spaces."""
        if n not in self.runs:
            longest = self.machine.longest
            many = n // longest - 2
            if len(self.runs) > 100_000:
                self.runs.clear()
            self.runs[n] = len(merge([SPACE] * n, self.machine.scores)) if n <= 4 * longest else many + self.run(n - many * longest)
        return self.runs[n]

    def advance(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state behind text, and the tokens emitted on the way."""
        spaces, inner = state
        total = 0
        for part in _part.findall(text):
            if part[0] == SPACE:
                spaces += len(part)
                continue
            if spaces:
                before = self.run(spaces - 1) if spaces > 1 else 0
                inner = self.machine.start(self.run(spaces) - before - 1 if spaces > 1 else 0)
                total += before
                part = SPACE + part
                spaces = 0
            inner, more, _ = self.machine.walk(inner, part)
            total += more
        return (spaces, self.machine.start() if spaces else inner), total

    def close(self, state: tuple) -> int:
        """Tokens still open at the end."""
        return self.run(state[0]) if state[0] else 0

    def count_word(self, word: str) -> int:
        """Tokens of a run of spaces with the characters behind it."""
        state, total = self.advance(self.start, word)
        return total + self.close(state)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if len(marked) <= CHUNK:
            return sum(map(self.words.__getitem__, _word.findall(marked)))
        state, total = scan([ChunkMap(self, marked[i : i + CHUNK]) for i in range(0, len(marked), CHUNK)])(self.start)
        return total + self.close(state)


class ChunkMap:
    """State map of a chunk: called with the state before it, gives the state behind it and the tokens emitted."""

    def __init__(self, counter: Counter, chunk: str):
        self.counter = counter
        border = _border.search(chunk)
        self.head, self.exit, self.rest = (chunk[: border.start()] if border else chunk), None, 0
        if border:
            last = max(m.start() for m in _border.finditer(chunk, border.start()))
            done = sum(map(counter.words.__getitem__, _word.findall(chunk, border.start(), last)))
            self.exit, tail = counter.advance(counter.start, chunk[last:])
            self.rest = done + tail
        self.trace = counter.machine.trace(chunk) if not border and SPACE not in chunk else None
        self.usual = self(counter.start)

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        if self.trace and not state[0]:
            if state == self.counter.start:
                return (0, self.trace[-1][0]), self.trace[-1][1]
            inner, total, read = self.counter.machine.walk(state[1], self.head, self.trace)
            return (0, self.trace[-1][0] if read < len(self.head) else inner), total + self.trace[-1][1] - self.trace[read - 1][1]
        state, total = self.counter.advance(state, self.head)
        return (self.exit, total + self.rest) if self.exit else (state, total)


class Composed:
    """The map of two neighbouring parts of a text; what follows the first one's usual exit is known beforehand."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        state, total = first.usual
        self.known = second(state)
        self.usual = self.known[0], total + self.known[1]

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        state, total = self.first(state)
        end, more = self.known if state == self.first.usual[0] else self.second(state)
        return end, total + more


def scan(maps: list):
    """The composition of all maps, by a balanced tree over neighbours."""
    while len(maps) > 1:
        maps = [Composed(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row for each row of docs."""

    def rows(batches):
        if model_path not in _counters:
            _counters[model_path] = Counter(model_path)
        counter = _counters[model_path]
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            counter.words.trim()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path())
