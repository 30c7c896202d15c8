"""A byte-level BPE tokenizer compiled to deterministic transducers.

Two machines, both made from the tokenizer's file:

* Splitter: from character classes to piece boundaries, for the split pattern of byte-level tokenizers (contractions, letters,
  numbers, other signs, each with one space before; white space). A boundary that only later characters decide is emitted late, one
  character back. Texts are cut into chunks; every chunk's map from entry to exit state is computed for all chunks at once, the maps
  compose by a parallel prefix scan per text, and a second pass with the true entry states emits the boundaries.
* Counter: from the bytes of a piece to emitted-token counts. A state holds, for each way the last bytes can begin a token, the token
  that would stand before it; a transition's weight is the change in the number of tokens. States and transitions are determinised
  when first used, from the vocabulary and merges alone, and dropped beyond a fixed number.

The counter rests on two facts of BPE: every prefix of an encoding is the encoding of its bytes, and a sequence is an encoding if each two
neighbours are.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

import numpy as np

CHUNK = 256
PASS_CHARS = 1_000_000  # split at a time, about
MAX_STATES = 250_000  # about 1 KB each
MAX_PIECES = 400_000  # twice so many may be held

# character classes
SIGN, LETTER, NUMBER, BLANK, SPACE, QUOTE, PAD = 0, 1, 2, 3, 4, 5, 6
NAMED = "stmdrvle"  # letters of contractions, classes 7 to 14
CLASSES = PAD + 1 + len(NAMED)
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# states
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK = range(12)
STATES = 12
HERE, BACK = 1, 2  # boundary before this character, before the one before it


@cache
def classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = BLANK
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for k, c in enumerate(NAMED):
        out[ord(c)] = PAD + 1 + k
    return out


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next row (state * CLASSES) and emitted boundaries, indexed by row + class."""
    to, out = np.zeros((STATES, CLASSES), np.intp), np.zeros((STATES, CLASSES), np.uint8)
    letters = [LETTER, *range(PAD + 1, CLASSES)]
    named = {c: PAD + 1 + k for k, c in enumerate(NAMED)}
    inside = {SIGN: IN_SIGNS, QUOTE: IN_SIGNS, NUMBER: IN_NUMBERS, **{c: IN_LETTERS for c in letters}}
    fresh = {**inside, QUOTE: AT_QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK}
    for s in range(STATES):
        for c in range(CLASSES):
            if c == PAD:
                to[s, c] = s * CLASSES
                continue
            state, emit = fresh[c], HERE
            if s == IN_LETTERS and c in letters or s == IN_NUMBERS and c == NUMBER or s == IN_SIGNS and c in (SIGN, QUOTE):
                state, emit = s, 0
            elif s == AT_QUOTE:
                if c in (SIGN, QUOTE):
                    state, emit = IN_SIGNS, 0
                elif c in [named[x] for x in "stmd"]:
                    state, emit = FRESH, 0
                elif c in [named[x] for x in "rvl"]:
                    state, emit = {named["r"]: QUOTE_R, named["v"]: QUOTE_V, named["l"]: QUOTE_L}[c], 0
            elif s in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == named["l" if s == QUOTE_L else "e"]:
                    state, emit = FRESH, 0
                elif c in letters:
                    state, emit = IN_LETTERS, BACK
                else:
                    emit = HERE | BACK
            elif s in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
                if c in (SPACE, BLANK):
                    state, emit = RUN_SPACE if c == SPACE else RUN_BLANK, 0
                elif s in (ONE_SPACE, RUN_SPACE):  # the last space belongs to what follows
                    state, emit = inside[c], BACK if s == RUN_SPACE else 0
                elif s == RUN_BLANK:
                    emit = HERE | BACK
            to[s, c], out[s, c] = state * CLASSES, emit
    return to.reshape(-1), out.reshape(-1)


def chunk_maps(grid: np.ndarray) -> np.ndarray:
    """For each chunk (column of grid: classes, step by step) its exit state for every entry state."""
    to, _ = splitter()
    rows = np.broadcast_to(np.arange(STATES) * CLASSES, (grid.shape[1], STATES))
    for t in range(grid.shape[0]):
        if (rows == rows[:, :1]).all():  # all entries lead to one state: go on with one
            one = rows[:, 0].copy()
            for u in range(t, grid.shape[0]):
                one = to.take(one + grid[u])
            return np.repeat(one[:, None] // CLASSES, STATES, axis=1)
        rows = to.take(rows + grid[t][:, None])
    return rows // CLASSES


def scan(maps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Entry state of each chunk: the maps of all chunks before it in its text, composed by doubling steps. place: number in the text."""
    maps, step = maps.copy(), 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        maps[at] = np.take_along_axis(maps[at], maps[at - step], axis=1)
        step *= 2
    entry = np.full(len(place), FRESH)
    later = np.flatnonzero(place > 0)
    entry[later] = maps[later - 1, FRESH]
    return entry


def boundaries(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places where a piece starts, in texts that stand one after the other as code points."""
    to, out = splitter()
    lens = lens[lens > 0]
    if not len(lens):
        return np.zeros(0, np.int64)
    n_chunks = -(-lens // CHUNK)
    total = int(n_chunks.sum())
    place = np.arange(total) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    ends = np.cumsum(lens)
    # each text padded to whole chunks; a chunk is a column of the grid
    cell = np.arange(len(codes)) + np.repeat((np.cumsum(n_chunks) - n_chunks) * CHUNK - (ends - lens), lens)
    padded = np.full(total * CHUNK, PAD, np.uint8)
    padded[cell] = classes().take(codes)
    grid = np.ascontiguousarray(padded.reshape(total, CHUNK).T)
    row = scan(chunk_maps(grid), place) * CLASSES
    emitted = np.empty(grid.shape, np.uint8)
    for t in range(CHUNK):
        at = row + grid[t]
        out.take(at, out=emitted[t])
        row = to.take(at)
    emitted = np.ascontiguousarray(emitted.T).reshape(-1)[cell]
    marks = (emitted & HERE) > 0
    marks[:-1] |= (emitted[1:] & BACK) > 0
    # a quote and one letter at the end of a text were no contraction
    marks[ends[np.isin(row[np.cumsum(n_chunks) - 1] // CLASSES, (QUOTE_R, QUOTE_V, QUOTE_L))] - 1] = True
    return np.flatnonzero(marks)


class State:
    __slots__ = ("pending", "next")

    def __init__(self, pending: tuple):
        self.pending, self.next = pending, {}


class Counter:
    """The token counts of pieces, from the vocabulary (bytes to id) and the merges (pairs of bytes, by rank)."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.right: dict[bytes, list] = {}  # along the right edge of a token: part, rank that absorbs it
        self.left: dict[bytes, list] = {}
        never = len(merges)
        for b in range(256):
            self.right[bytes([b])] = self.left[bytes([b])] = [(bytes([b]), never)]
        whole = {bytes([b]) for b in range(256)}
        for r, (a, b) in enumerate(merges):
            token = a + b
            if token in self.right or a not in self.right or b not in self.right:
                continue
            if a in whole and b in whole and not self._crossed(a, b, r):
                whole.add(token)
            self.right[token] = [(token, never), (b, r), *self.right[b][1:]]
            self.left[token] = [(token, never), (a, r), *self.left[a][1:]]
        self.begins: dict[bytes, bytes | None] = {}  # beginnings of tokens; the token itself where one ends
        for token in vocabulary:
            if token in whole:
                for k in range(1, len(token)):
                    self.begins.setdefault(token[:k], None)
                self.begins[token] = token
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple, State] = {}
        self.root = self._state(((b"", None, 0),))

    def _crossed(self, a: bytes, b: bytes, limit: int) -> bool:
        """Whether a merge of lower rank than the limit joins the end of a with the start of b before either is whole. Of equal ranks the
        leftmost merge is done first."""
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < limit and r < x_until and r <= y_until:
                    return True
        return False

    def _fit(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2 * MAX_STATES:
                self.fits.clear()
            known = self.fits[a, b] = not self._crossed(a, b, len(self.rank) + 1)
        return known

    def _state(self, pending: tuple) -> State:
        state = self.states.get(pending)
        if state is None:
            state = self.states[pending] = State(pending)
        return state

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        b, going, done = bytes([byte]), [], None
        for begun, before, count in state.pending:  # longest first
            longer = begun + b
            if longer in self.begins:
                token = self.begins[longer]
                if done is None and token is not None and self._fit(before, token):
                    done = (token, count + 1)
                going.append((longer, before, count))
        token, weight = done
        pending = tuple((begun, before, count - weight) for begun, before, count in going) + ((b"", token, 0),)
        edge = state.next[byte] = (self._state(pending), weight)
        return edge

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.states.clear()
            self.root = self._state(((b"", None, 0),))
        state, total = self.root, 0
        for byte in piece:
            edge = state.next.get(byte)
            if edge is None:
                edge = self._step(state, byte)
            state = edge[0]
            total += edge[1]
        return total


@cache
def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Pieces(dict):
    """Values by piece, made when first asked for. When full, the pieces move to an older half, and come back when asked for again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str):
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


class Compiled:
    """A tokenizer's file compiled: token counts of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        self.added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        vocabulary = {raw(w): i for w, i in spec["model"]["vocab"].items() if w not in self.added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.counter = Counter(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.counts = Pieces(lambda piece: self.counter.count(piece.encode()))

    def cut(self, text: str) -> tuple[list[str], int]:
        """The parts between added tokens, and how many of these stand in the text."""
        parts = [text]
        for word in self.added:
            if word in text:
                parts = [y for x in parts for y in x.split(word)]
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for lo, hi in passes(texts):
            parts, owner = [], []
            for k in range(lo, hi):
                cut, n_added = self.cut(texts[k])
                out[k] += n_added
                parts += cut
                owner += [k] * len(cut)
            pieces, lens = split(parts)
            values = np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))
            ends = np.cumsum(lens)
            sums = np.concatenate(([0], np.cumsum(values)))
            for k, n in zip(owner, (sums[ends] - sums[ends - lens]).tolist()):
                out[k] += n
        return out


def passes(texts: list[str]):
    """Ranges of texts of about PASS_CHARS characters; a longer text alone."""
    lo, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PASS_CHARS:
            yield lo, k
            lo, size = k, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def split(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the parts, and the number of pieces of each part."""
    whole = "".join(parts)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = boundaries(np.frombuffer(whole.encode("utf-32-le"), np.uint32), lens)
    ends = np.cumsum(lens)
    n = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lens)
    at = [*starts.tolist(), len(whole)]
    return [whole[a:b] for a, b in zip(at, at[1:])], n


@cache
def compiled(path: str) -> Compiled:
    return Compiled(path)
