"""Byte-level BPE: encode whole texts to token ids, and ids back to bytes.

Pre-tokenisation uses no regex. Each code point becomes a class; a class acts on the states
of a small automaton as a transition function, and functions compose associatively, so
the state before every code point of a batch comes from a blocked scan (compose within
blocks, doubling scan across blocks, apply within blocks). State, class and the next class
then tell where a piece starts. Pieces feed pair merging through a cache of pieces.

Defined results: a null text counts as empty; an empty text has no ids; null or repeated
`doc_id`s and repeated texts are encoded row by row; other columns are ignored; an empty
table gives an empty table. A very long text is one chunk of its own and never cut; one
very long piece is merged with a heap in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideglass.llm.common import chunks, id_and_text, lean, rows_batch, ship

# Classes of code points. The letters of contractions need classes of their own.
OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE, L_SIMPLE, L_R, L_V, L_L, L_E = range(11)
CLASSES = 11
# States: what the last code point was, as far as the next boundary depends on it.
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_QUOTE, S_QR, S_QV, S_QL, S_DONE) = range(11)
STATES = 11

_LETTERS = {"s": L_SIMPLE, "t": L_SIMPLE, "m": L_SIMPLE, "d": L_SIMPLE, "r": L_R, "v": L_V, "l": L_L, "e": L_E}

_BLOCK = 64
_CACHE_PIECES = 400_000
#: Pieces that a worker keeps from task to task; more go when a task ends.
_KEPT_PIECES = 100_000
_HEAP_FROM = 64

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point.

    Letters, numbers and white space are asked of the tokenizer library's own Unicode
    tables, once per worker, so that both use the same Unicode version.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, code in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        probe = tiktoken.Encoding(
            "classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
        )
        for begin in range(0, len(every), 1 << 16):
            found = bytes(probe.encode_ordinary(every[begin : begin + (1 << 16)])).decode()
            table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = code
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letter, code in _LETTERS.items():
        table[ord(letter)] = code
    return table


def _next_state(state: int, code: int) -> int:
    contraction = {
        S_QUOTE: {L_SIMPLE: S_DONE, L_R: S_QR, L_V: S_QV, L_L: S_QL},
        S_QR: {L_E: S_DONE},
        S_QV: {L_E: S_DONE},
        S_QL: {L_L: S_DONE},
    }
    if code in contraction.get(state, {}):
        return contraction[state][code]
    if code == QUOTE:
        # Starts a piece, and perhaps a contraction, unless it goes on with one.
        return S_OTHER if state in (S_OTHER, S_SPACE, S_QUOTE) else S_QUOTE
    if code >= L_SIMPLE or code == LETTER:
        return S_LETTER
    return {NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, WHITE: S_WHITE}[code]


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """Next state by class and state; classes from CLASSES on also begin a document."""
    table = np.empty((2 * CLASSES, STATES), dtype=np.uint8)
    for code in range(CLASSES):
        table[code] = [_next_state(state, code) for state in range(STATES)]
        table[CLASSES + code] = _next_state(S_START, code)
    return table


def scan_states(codes: np.ndarray) -> np.ndarray:
    """State after each position, by an associative scan over transition functions."""
    step = transitions()
    n = len(codes)
    if n == 0:
        return np.empty(0, dtype=np.uint8)
    rows = -(-n // _BLOCK)
    padded = np.zeros(rows * _BLOCK, dtype=np.uint8)
    padded[:n] = codes
    grid = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    # Compose each block's functions: composed[b, s] is the state after block b from s.
    composed = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for column in grid:
        composed = step[column[:, None], composed]
    # Inclusive doubling scan across blocks.
    shift = 1
    while shift < rows:
        composed = np.concatenate(
            [composed[:shift], np.take_along_axis(composed[shift:], composed[:-shift].astype(np.intp), axis=1)]
        )
        shift *= 2
    state = np.empty(rows, dtype=np.uint8)
    state[0] = S_START
    state[1:] = composed[:-1, S_START]
    out = np.empty((_BLOCK, rows), dtype=np.uint8)
    for i, column in enumerate(grid):
        state = step[column, state]
        out[i] = state
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a piece starts, in documents laid end to end that begin at `first`."""
    n = len(points)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    kinds = class_table()[points]
    codes = kinds.copy()
    codes[first] += CLASSES
    after = scan_states(codes)
    before = np.empty(n, dtype=np.uint8)
    before[0] = S_START
    before[1:] = after[:-1]
    before[first] = S_START

    white = (kinds == SPACE) | (kinds == WHITE)
    last = np.zeros(n, dtype=bool)
    last[first[1:] - 1] = True
    last[n - 1] = True
    solid_next = np.zeros(n, dtype=bool)
    solid_next[:-1] = ~white[1:]
    solid_next[last] = False
    was_white = (before == S_SPACE) | (before == S_WHITE)

    # What a piece may go on as, by the state before; a contraction goes on in its own states.
    goes_on = np.zeros((STATES, STATES), dtype=bool)
    for a, b in (
        (S_LETTER, S_LETTER), (S_NUMBER, S_NUMBER), (S_OTHER, S_OTHER), (S_QUOTE, S_OTHER),
        (S_SPACE, S_LETTER), (S_SPACE, S_NUMBER), (S_SPACE, S_OTHER),
        (S_QUOTE, S_DONE), (S_QUOTE, S_QR), (S_QUOTE, S_QV), (S_QUOTE, S_QL),
        (S_QR, S_DONE), (S_QV, S_DONE), (S_QL, S_DONE),
    ):
        goes_on[a, b] = True
    start = np.where(white, ~was_white | solid_next, ~goes_on[before, after])
    start[first] = True
    starts = np.flatnonzero(start)

    # `'r`, `'v` and `'l` that do not complete: the quote stands alone, letters start anew.
    opened = np.flatnonzero((after == S_QR) | (after == S_QV) | (after == S_QL))
    if len(opened):
        following = np.minimum(opened + 1, n - 1)
        complete = (after[following] == S_DONE) & (following > opened) & ~last[opened]
        broken = opened[~complete]
        starts = np.union1d(starts, broken)
        resumed = broken[~last[broken]] + 1
        letter = after[resumed] == S_LETTER
        starts = np.setdiff1d(starts, resumed[letter], assume_unique=True)
    return starts


class Vocabulary:
    """Ranks of a byte-level BPE file, with a bounded cache of encoded pieces."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.lengths = np.diff(self.ends, prepend=0)
        self.pieces: dict[str, tuple[str, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the pair of lowest rank, leftmost first, is merged."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) >= _HEAP_FROM:
            return self._merge_long(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or end[i] != middle or end[j] != stop:
                continue
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def encoded(self, piece: str) -> tuple[str, bytes]:
        known = self.pieces.get(piece)
        if known is None:
            ids = self.merge(piece.encode())
            known = (" ".join(map(str, ids)), np.array(ids, dtype=np.uint32).tobytes())
            if len(piece) <= 64:
                if len(self.pieces) >= _CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids laid end to end, and the offset behind each id's bytes."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.ends[ids] - ends, sizes)
        return self.bytes[np.arange(total) + shift], ends


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[str, np.ndarray]]:
    """For each text its decimal ids joined by one space, and the ids."""
    words = vocabulary(path)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    first = (ends - lengths)[lengths > 0]
    starts = piece_starts(points, first)
    edges = [*starts.tolist(), len(joined)]
    pieces = [joined[a:b] for a, b in zip(edges, edges[1:])]
    known, encoded = words.pieces.get, words.encoded
    coded = [known(p) or encoded(p) for p in pieces]
    bounds = np.searchsorted(starts, np.concatenate([[0], ends])).tolist()
    for i in range(len(texts)):
        own = coded[bounds[i] : bounds[i + 1]]
        yield " ".join([c[0] for c in own]), np.frombuffer(b"".join([c[1] for c in own]), dtype=np.uint32)


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode every whole text and decode the ids again; digests of both, one row per row."""

    def run(batches):
        words = vocabulary(vocabulary_path)
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                rows = list(encode_texts(texts, vocabulary_path))
                ids = np.concatenate([r[1] for r in rows])
                data, ends = words.decode(ids)
                raw = data.tobytes()
                counts = [len(r[1]) for r in rows]
                edges = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
                yield rows_batch(
                    _ARROW,
                    [
                        part.column("doc_id"),
                        counts,
                        [hashlib.sha256(r[0].encode()).hexdigest() for r in rows],
                        [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edges, edges[1:])],
                    ],
                )
        if len(words.pieces) > _KEPT_PIECES:
            words.pieces.clear()

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(lean(run), SCHEMA)
