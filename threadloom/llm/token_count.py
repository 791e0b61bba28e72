"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers give the number of tokens of a byte-level BPE vocabulary:

* The *splitter* (nine states over character classes) marks where a pretoken begins. It is compiled
  to a full table. A batch of texts is one array of classes cut into chunks; each chunk is stepped from
  all nine states at once, which gives its state map; the maps are composed by a parallel prefix scan
  (recursive doubling), so every chunk then knows its true first state and is stepped once more for the
  marks. No chunk waits for the one before it.
* The *counter* reads a pretoken's bytes. A string's BPE encoding is the only chain of tokens in which
  every neighbouring pair is itself a BPE encoding, so the last token of each prefix decides how prefixes
  extend. A state holds the vocabulary-tree nodes of all open suffixes, each with the last token before
  it and the tokens that it lies behind; a transition carries the change of the count. States and
  transitions are made when first needed and the tables are emptied at a size limit, so memory is bounded.

The map of a whole pretoken from the counter's first state (its count) is kept by pretoken.

Cases: null or empty text has 0 bytes and 0 tokens. The vocabulary's special strings inside a text count
as one token each, as the library takes them by default. Nothing is truncated. Repeated rows and null ids
are counted as any row. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import common

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256
TAIL = 24
#: Characters stepped at once.
PIECE = 1 << 20
#: One that a batch does not contain is put between its pretokens.
CUTS = (0xFFFF, 0xFFFE, *range(0xFDD0, 0xFDF0), *range(0x10FF00, 0x110000))
#: Entries that a memo of pretokens, or the counter's transitions, may have.
MOST_KEPT = 400_000

# Classes of characters, and states of the splitter.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, ONE, RV, EL, EE, END = range(11)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, AT_RV, AT_EL, AT_SPACE, AT_BLANK = range(9)
N_CLASSES, N_STATES = 11, 9


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state * 11 + class] and marks (bit 0: a pretoken begins at this character; bit 1: at the one before)."""
    letters = {LETTER, ONE, RV, EL, EE}
    begin = {**{c: IN_LETTERS for c in letters}, NUMBER: IN_NUMBERS, SPACE: AT_SPACE, BLANK: AT_BLANK, QUOTE: AT_QUOTE, OTHER: IN_OTHERS, END: FRESH}
    stay = {IN_LETTERS: letters, IN_NUMBERS: {NUMBER}, IN_OTHERS: {OTHER, QUOTE}}
    after, marks = np.zeros(99, np.uint8), np.zeros(99, np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            to, mark = begin[c], 1
            if s in stay and c in stay[s]:
                to, mark = s, 0
            elif s == AT_QUOTE and c in letters - {LETTER, EE}:
                to, mark = {ONE: FRESH, RV: AT_RV, EL: AT_EL}[c], 0
            elif s == AT_QUOTE and c in (OTHER, QUOTE):
                to, mark = IN_OTHERS, 0
            elif (s, c) in ((AT_RV, EE), (AT_EL, EL)):
                to, mark = FRESH, 0
            elif s in (AT_RV, AT_EL):  # it was no contraction: the letter began a word
                to, mark = (IN_LETTERS, 2) if c in letters else (begin[c], 3)
            elif s in (AT_SPACE, AT_BLANK) and c in (SPACE, BLANK):
                mark = 0
            elif s == AT_SPACE and c != END:  # the last space of a run goes with what follows
                to, mark = (IN_OTHERS if c == QUOTE else begin[c]), 2
            elif s == AT_BLANK and c != END:
                mark = 3
            after[s * N_CLASSES + c], marks[s * N_CLASSES + c] = to, mark
    return after, marks


UNKNOWN = 255


class CharacterClasses:
    """Class of each code point, asked of the library's own splitter when the code point is first met (its Unicode version decides)."""

    def __init__(self, pre_tokenizer):
        self.pre = pre_tokenizer
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.table[0x20], self.table[ord("'")] = SPACE, QUOTE
        for letters, kind in (("stmd", ONE), ("rv", RV), ("l", EL), ("e", EE)):
            for c in letters:
                self.table[ord(c)] = kind

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        new = np.unique(points[found == UNKNOWN])
        if len(new):
            for i in new.tolist():
                one = lambda head: len(self.pre.pre_tokenize_str(head + chr(i))) == 1  # noqa: B023, E731
                self.table[i] = LETTER if one("a") else NUMBER if one("1") else OTHER if one("!") else BLANK
            found = self.table[points]
        return found


def chunk_maps(classes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each chunk (a row of classes) the state after it, by the state before it.

    A chunk's map is its head's followed by its tail's; where the tail's is constant, it is the chunk's.
    White space after other text makes it so, and only chunks without such a tail are stepped whole.
    """

    def stepped(part: np.ndarray) -> np.ndarray:
        state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None, :], len(part), axis=0)
        for column in np.ascontiguousarray(part.T)[:, :, None]:
            state = after[state * np.uint8(N_CLASSES) + column]
        return state

    maps = stepped(classes[:, -TAIL:])
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_):
        maps[open_] = stepped(classes[open_])
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, by recursive doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def begins(classes: np.ndarray, after: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Positions at which pretokens begin; the text's last class must be END."""
    rows = -(-len(classes) // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[: len(classes)] = classes
    grid = grid.reshape(rows, CHUNK)
    first = np.zeros(rows, np.uint8)
    first[1:] = prefix_scan(chunk_maps(grid[:-1], after))[:, FRESH]
    columns, seen, state = np.ascontiguousarray(grid.T), np.empty((CHUNK, rows), np.uint8), first
    for i in range(CHUNK):
        at = state * np.uint8(N_CLASSES) + columns[i]
        seen[i] = marks[at]
        state = after[at]
    seen = np.ascontiguousarray(seen.T).reshape(-1)[: len(classes)]
    is_begin = (seen & 1).astype(bool)
    is_begin[:-1] |= (seen[1:] & 2).astype(bool)
    return np.flatnonzero(is_begin)


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The lazily made counting transducer of one BPE vocabulary."""

    def __init__(self, merges: list[tuple[str, str]]):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves = {b: (b, b) for b in range(256)}
        for order, (a, b) in enumerate(merges):
            a_raw, b_raw = raw(a), raw(b)
            to = self.ids.setdefault(a_raw + b_raw, len(self.ids))
            self.rank[self.ids[a_raw], self.ids[b_raw]] = (order, to)
            self.halves.setdefault(to, (self.ids[a_raw], self.ids[b_raw]))
        self.bytes = {i: s for s, i in self.ids.items()}
        self.tree: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for s, i in self.ids.items():
            node = 0
            for b in s:
                key = node << 8 | b
                if key not in self.tree:
                    self.tree[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.tree[key]
            self.token_at[node] = i
        self.parents = {key >> 8 for key in self.tree}
        self.below: list[list[int]] = [[] for _ in self.token_at]
        for s, i in self.ids.items():
            node = 0
            for b in s[:-1]:
                node = self.tree[node << 8 | b]
                self.below[node].append(i)
        self.opened: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.moves: dict[int, int] = {}

    def encode(self, data: bytes) -> list[int]:
        """Plain merging by rank; used to tell which pairs are encodings."""
        parts = list(data)
        while len(parts) > 1:
            best = min(((*self.rank.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 60:
                break
            parts[best[2] : best[2] + 2] = [best[1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens in a row are what their joined bytes encode to.

        Merges are undone on either side of the seam, latest first (numbers follow the merge order); if
        the parts that then meet could merge sooner than what was undone, merging would have crossed the seam.
        """
        if before < 0:
            if token not in self.whole:
                self.whole[token] = self.encode(self.bytes[token]) == [token]
            return self.whole[token]
        a, b, limit, rank, halves = before, token, 1 << 60, self.rank, self.halves
        while True:
            met = rank.get((a, b))
            if met is not None and met[1] < limit:
                return False
            if a < 256 and b < 256:
                return True
            if b < 256 or a > b and a >= 256:
                limit, a = a, halves[a][1]
            else:
                limit, b = b + 1, halves[b][0]

    def open(self, before: int, node: int) -> bool:
        """Whether some token below the node can follow `before`; other suffixes are dropped, which keeps states few."""
        key = (before, node)
        got = self.opened.get(key)
        if got is None:
            if len(self.opened) > MOST_KEPT:
                self.opened.clear()
            got = self.opened[key] = any(self.fits(before, t) for t in self.below[node])
        return got

    def make(self, state: int, byte: int) -> tuple[int, int]:
        moved, last, gain, parents = [], None, 0, self.parents
        for node, before, lag in self.states[state]:
            to = self.tree.get(node << 8 | byte)
            if to is None:
                continue
            if to in parents and self.open(before, to):
                moved.append((to, before, lag))
            token = self.token_at[to]
            if last is None and token >= 0 and self.fits(before, token):
                last, gain = token, lag + 1
        new = (*((n, b, lag - gain) for n, b, lag in moved), (0, last, 0))
        if new not in self.numbers:
            self.numbers[new] = len(self.states)
            self.states.append(new)
        return self.numbers[new], gain

    def count(self, data: bytes) -> int:
        if len(self.moves) > MOST_KEPT:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in data:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                to, gain = self.make(state, byte)
                move = moves[key] = to << 8 | gain + 128
            state = move >> 8
            total += (move & 255) - 128
        return total


class _Memo(dict):
    """Pretoken -> count."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        got = self[word] = self.counter.count(word.encode())
        return got


class Transducer:
    """Token counts of whole texts for one tokenizer file (a byte-level BPE without normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.after, self.marks = compile_splitter()
        self.classes = CharacterClasses(Tokenizer.from_file(path).pre_tokenizer)
        self.counter = Counter(merges)
        self.memo = _Memo(self.counter)

    def counts(self, texts: list[str]) -> list[int]:
        out, owners, parts, held = [0] * len(texts), [], [], 0
        for k, text in enumerate(texts):
            pieces = self.special.split(text) if self.special and "<" in text else [text]
            out[k] += len(pieces) - 1
            for piece in filter(None, pieces):
                owners.append(k)
                parts.append(piece)
                held += len(piece)
            if held > PIECE:
                self._add(parts, owners, out)
                owners, parts, held = [], [], 0
        self._add(parts, owners, out)
        return out

    def _add(self, parts: list[str], owners: list[int], out: list[int]) -> None:
        if not parts:
            return
        joined = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes.of(points)
        classes[ends] = END
        at = begins(classes, self.after, self.marks)
        mark = next(c for c in CUTS if c not in points)
        cut = np.empty(len(points) + len(at) - 1, np.uint32)
        cut[at[1:] + np.arange(len(at) - 1)] = mark
        shifted = np.zeros(len(points), np.int64)
        shifted[at[1:]] = 1
        cut[np.arange(len(points)) + np.cumsum(shifted)] = points
        words = cut.tobytes().decode("utf-32-le").split(chr(mark))
        if len(self.memo) > MOST_KEPT:
            self.memo.clear()
        counted = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        counted[classes[at] == END] = 0
        sums = np.concatenate([[0], np.cumsum(counted)])
        bounds = np.searchsorted(at, ends)
        lows = np.concatenate([[0], bounds[:-1]])
        for k, n in zip(owners, (sums[bounds] - sums[lows]).tolist(), strict=True):
            out[k] += n


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """Compiled once in each worker process."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text; a narrow pass."""
    place = path

    def run(batch: pa.RecordBatch):
        t = transducer(place or vocabulary_path())
        for part in common.rows_of(batch):
            found = common.texts(part)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(t.counts(found), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(common.table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
