"""Fill-in-middle: texts cut in three and laid out anew by displacement scatter, and back.

A text is cut into units, runs of ASCII letters and single other code points. Two numbers
drawn from the row's id choose the units where prefix and middle end, two more the form:

    plain  the text as it is: empty texts, texts that hold a mark, and the share of rows
           that stays as it is
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

All texts of a batch are one byte array. The two cuts of each text go, with the change of
shift that each part of the layout asks for, into a difference array; its cumulative sum is
every byte's shift, and one scatter builds all outputs. The way back knows outputs and
forms only: it finds the marks, which stand once each, reads off the parts, and gathers the
bytes with the same shifts. Arrays of shifts are held for `BLOCK` bytes at a time, so a text
of any length costs little more than its own bytes twice.

Map only, nothing is shuffled. Defined results: a null text is empty, hence plain, with null
lengths of parts; a null id draws as the text `1:` alone; equal rows give equal rows; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideglass.llm.common import chunks, id_and_text, rows_batch, sha256_hex, ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = "1"
#: Of a hundred rows so many stay plain, and of a hundred others so many put the suffix first.
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Bytes for which arrays of shifts are held at a time.
BLOCK = 1 << 20

FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Order of the parts (0 prefix, 1 middle, 2 suffix) in the output of each form but plain.
LAYOUT = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
_PART_MARK = (PREFIX, MIDDLE, SUFFIX)
_WIDTH = 3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CONTINUED = np.zeros(256, dtype=bool)
_CONTINUED[0x80:0xC0] = True

COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"


def draws(key: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row: the first four groups of a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each byte; texts begin at `begins`."""
    letter = _LETTER[data]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    # A run of letters does not reach across from the text before; empty texts at the end own no byte.
    inner[begins[begins < len(data)]] = False
    return ~(inner | _CONTINUED[data])


@dataclass
class _Ranks:
    """Places of the set bits of a mask by rank, with counts per stretch instead of all places."""

    mask: np.ndarray
    stretch: int = 1 << 12

    def __post_init__(self) -> None:
        at = np.arange(0, len(self.mask), self.stretch)
        counts = np.add.reduceat(self.mask, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def upto(self, place: int) -> int:
        """Set bits before `place`."""
        k = place // self.stretch
        return int(self.before[k]) + int(np.count_nonzero(self.mask[k * self.stretch : place]))

    def place(self, rank: int) -> int:
        """Place of the set bit with `rank` set bits before it."""
        k = int(np.searchsorted(self.before, rank, side="right")) - 1
        inside = np.flatnonzero(self.mask[k * self.stretch : (k + 1) * self.stretch])
        return k * self.stretch + int(inside[rank - int(self.before[k])])


def _shifts(changes: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, shift of each byte) for blocks of `size` bytes, from changes by place."""
    at = np.array([c[0] for c in changes], dtype=np.int64)
    by = np.array([c[1] for c in changes], dtype=np.int64)
    carried = 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        difference = np.zeros(end - begin, dtype=np.int64)
        here = slice(*np.searchsorted(at, [begin, end], side="left"))
        np.add.at(difference, at[here] - begin, by[here])
        difference[0] += carried
        shift = np.cumsum(difference)
        carried = int(shift[-1])
        yield begin, end, shift


@dataclass(frozen=True)
class Moves:
    """Where the parts of a batch's texts go: changes of shift by source place, and marks."""

    changes: list[tuple[int, int]]
    marks: list[tuple[int, bytes]]
    ends: np.ndarray  # of the outputs

    def scatter(self, source: np.ndarray) -> np.ndarray:
        out = np.empty(int(self.ends[-1]) if len(self.ends) else 0, dtype=np.uint8)
        for begin, end, shift in _shifts(self.changes, len(source)):
            out[np.arange(begin, end) + shift] = source[begin:end]
        places = np.array([p for p, _ in self.marks], dtype=np.int64)
        signs = np.frombuffer(b"".join(m for _, m in self.marks), dtype=np.uint8).reshape(-1, _WIDTH)
        for i in range(_WIDTH):
            out[places + i] = signs[:, i]
        return out

    def gather(self, moved: np.ndarray, size: int) -> np.ndarray:
        source = np.empty(size, dtype=np.uint8)
        for begin, end, shift in _shifts(self.changes, size):
            source[begin:end] = moved[np.arange(begin, end) + shift]
        return source


def moves(parts: list[tuple[int, int, int]], forms: list[int]) -> Moves:
    """Lay out texts of (prefix, middle, suffix) bytes each in their forms, one after the other."""
    changes, marks, ends = [], [], []
    read = write = shift = 0
    for sizes, form in zip(parts, forms, strict=True):
        starts = [read, read + sizes[0], read + sizes[0] + sizes[1]]
        goes = starts
        if form == PLAIN:
            goes = [write, write + sizes[0], write + sizes[0] + sizes[1]]
            write += sum(sizes)
        else:
            goes = [0, 0, 0]
            for part in LAYOUT[form]:
                marks.append((write, _PART_MARK[part]))
                goes[part] = write + _WIDTH
                write = goes[part] + sizes[part]
        for start, goal, size in zip(starts, goes, sizes):
            if size:
                changes.append((start, goal - start - shift))
                shift = goal - start
        read += sum(sizes)
        ends.append(write)
    return Moves(changes, marks, np.array(ends, dtype=np.int64))


def parts_of(output: bytes, form: int) -> tuple[int, int, int]:
    """Bytes of prefix, middle and suffix, read off an output's marks."""
    if form == PLAIN:
        return len(output), 0, 0
    sizes = [0, 0, 0]
    layout = LAYOUT[form]
    at = _WIDTH
    for part, following in zip(layout, [*layout[1:], None]):
        # No text in this form holds a mark, and marks do not overlap: the first found is the one.
        end = len(output) if following is None else output.index(_PART_MARK[following], at)
        sizes[part] = end - at
        at = end + _WIDTH
    return tuple(sizes)


@dataclass(frozen=True)
class Infilled:
    """What became of one text."""

    units: int
    form: int
    prefix_chars: int
    middle_chars: int
    output: bytes


def transform(keys: list[int | None], texts: list[bytes], seed: str = SEED) -> list[Infilled]:
    """Cut and lay out texts together."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = ends - [len(t) for t in texts]
    units = _Ranks(unit_starts(data, begins))
    points = _Ranks(~_CONTINUED[data])
    found, parts, forms = [], [], []
    first = 0
    for key, text, begin, end in zip(keys, texts, begins.tolist(), ends.tolist()):
        last = units.upto(end)
        n = last - first
        h = draws(key, seed)
        if not text or any(mark in text for mark in MARKS) or h[2] % 100 >= 100 - PLAIN_PERCENT:
            form, low, high = PLAIN, end, end
        else:
            form = SPM if h[3] % 100 < SPM_PERCENT else PSM
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            low = end if a == n else units.place(first + a)
            high = end if b == n else units.place(first + b)
        before = points.upto(begin)
        upto_low, upto_high = points.upto(low), points.upto(high)
        found.append((n, form, upto_low - before, upto_high - upto_low))
        parts.append((low - begin, high - low, end - high))
        forms.append(form)
        first = last
    layout = moves(parts, forms)
    moved = layout.scatter(data).tobytes()
    stops = layout.ends.tolist()
    return [Infilled(*f, moved[a:b]) for f, a, b in zip(found, [0, *stops], stops)]


def restore(outputs: list[bytes], forms: list[int]) -> list[bytes]:
    """The texts again, from outputs and forms alone."""
    parts = [parts_of(o, f) for o, f in zip(outputs, forms, strict=True)]
    layout = moves(parts, forms)
    ends = np.cumsum([sum(p) for p in parts], dtype=np.int64).tolist()
    moved = np.frombuffer(b"".join(outputs), dtype=np.uint8)
    source = layout.gather(moved, ends[-1] if ends else 0).tobytes()
    return [source[a:b] for a, b in zip([0, *ends], ends)]


def _read(docs: DataFrame, seed: str, schema: pa.Schema, columns) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                keys = part.column("doc_id").to_pylist()
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                yield rows_batch(schema, columns(keys, transform(keys, texts, seed)))

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in schema))


_SQL_TYPES = {pa.int64(): "bigint", pa.string(): "string"}
_SHAPE = [
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
]


def _shape(keys: list, done: list[Infilled]) -> list:
    return [
        keys,
        [d.units for d in done],
        [FORMS[d.form] for d in done],
        [None if d.form == PLAIN else d.prefix_chars for d in done],
        [None if d.form == PLAIN else d.middle_chars for d in done],
    ]


def infilled(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The texts in their new forms, as `output`, beside their shape."""
    schema = pa.schema([*_SHAPE, ("output", pa.string())])
    return _read(docs, seed, schema, lambda keys, done: [*_shape(keys, done), [d.output.decode() for d in done]])


def restored(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) from the columns doc_id, form and output of `infilled`."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "output"):
                forms = [FORMS.index(f) for f in part.column("form").to_pylist()]
                texts = restore([t.as_buffer().to_pybytes() for t in part.column("output")], forms)
                yield rows_batch(schema, [part.column("doc_id"), [t.decode() for t in texts]])

    ship(outputs.sparkSession)
    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id bigint, text string")


def report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Shape of every text, and digests of its output and of the text restored from it."""
    schema = pa.schema([*_SHAPE, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def columns(keys, done):
        outputs = [d.output for d in done]
        back = restore(outputs, [d.form for d in done])
        return [*_shape(keys, done), [sha256_hex(o) for o in outputs], [sha256_hex(t) for t in back]]

    return _read(docs, seed, schema, columns)
