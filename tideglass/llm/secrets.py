"""Secret scan: patterns over the text and over every layer that can be unwrapped from it.

A worklist starts with the text itself. Each layer is scanned; then its percent escapes
are decoded in place (as text, and as single bytes where these differ), its character escapes
likewise, those of JSON included, and every base64 token, also in lines or glued to other
characters, gives a layer of its bytes for each of its four alignments. UTF-16 and UTF-32 in a
layer give further ones. New layers go to the worklist until none is left; a layer seen
before at the same place is not taken again.

Compressed streams begin anywhere in the bytes of a layer, however it was unwrapped, and have
any number of members: gzip, zlib (any header that holds its check), bz2, xz, lzma alone and
deflated zip members; raw deflate, which has no mark, where a base64 token begins. They are
unpacked a piece at a time to their end, and what they hold is searched in the same ways,
further streams too; contents that were searched before, of whatever size, are not searched
again, so streams that unpack to themselves end. All finds in a stream stand for its range in
the layer, so only the kinds that occur are kept and no character of it needs a place.
Each layer knows, for each of its characters, the range of the original text it came from,
so every find is reported as a range of the original text.

Base finds are those of the text itself; finds in layers are added where the same kind
and range is not there yet. Everything happens row by row: documents are never shuffled.

Defined results: a null or empty text has no finds (digest of the empty string); repeated
rows are scanned row by row; other columns are ignored; an empty table gives an empty
table; long texts are scanned whole. A damaged stream is scanned up to the damage. Layers
are counted (`n_layers`) when they hold a run of 12 printable characters, the least any find
takes. Nothing is cut, so `n_cut` is 0. Time grows with what is unpacked, memory does not: a
stream that asks for more than `LZMA_BYTES` of dictionary counts as damaged, and an unbroken
run beyond `PIECE` spills to the task's own temporary file, which a retried task writes anew.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import mmap
import re
import sys
import tempfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, give_back, id_and_text, lean, rows_batch, sha256_hex, ship

# Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([nrtbf\"'\\/])"
)
_SHORT = {"n": 10, "r": 13, "t": 9, "b": 8, "f": 12}
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64; a run starts where its first line does.
RUN = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_ \t\r\n-]{17})"
    r"[A-Za-z0-9+/_-]++(?:[ \t]*+[\r\n][ \t\r\n]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
#: ASCII runs in UTF-16 and UTF-32, with the bytes a character takes and the one that counts.
WIDE = [
    (re.compile(f"(?:{body}){{12,}}"), step, place)
    for body, step, place in (
        (r"[\t-\r -~]\x00", 2, 0), (r"\x00[\t-\r -~]", 2, 1),
        (r"[\t-\r -~]\x00\x00\x00", 4, 0), (r"\x00\x00\x00[\t-\r -~]", 4, 3),
    )
]

#: The same over bytes, as compressed content has no places of its own.
ASSIGN_BYTES, ACCESS_BYTES, HEX_BYTES, PERCENT_BYTES, ESCAPE_BYTES, BASE64_BYTES, RUN_BYTES = (
    re.compile(p.pattern.encode(), p.flags & re.IGNORECASE)
    for p in (ASSIGN, ACCESS, HEX, PERCENT, ESCAPE, BASE64, RUN)
)
WIDE_BYTES = [(re.compile(p.pattern.encode()), step, place) for p, step, place in WIDE]
#: The least run that any secret, wrapped or not, takes.
PRINTABLE = re.compile(rb"[\t-\r -~]{12}|" + b"|".join(p.pattern for p, *_ in WIDE_BYTES))
#: Two bytes begin a zlib stream if they name deflate, no dictionary, and divide by 31.
_ZLIB = b"|".join(
    re.escape(bytes([kind]))
    + b"["
    + b"".join(re.escape(bytes([more])) for more in range(256) if (256 * kind + more) % 31 == 0 and not more & 32)
    + b"]"
    for kind in range(0x08, 0x80, 0x10)
)
#: First bytes of gzip, bz2, xz, lzma alone, a deflated zip member, and zlib.
MAGIC = re.compile(
    rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x5d\x00\x00..(?:\xff{8}|....\x00{4})|PK\x03\x04....\x08\x00|" + _ZLIB,
    re.DOTALL,
)
MAGIC_BYTES = 13
#: Memory that one xz or lzma stream may ask for.
LZMA_BYTES = 100 << 20
#: A byte that is in no find, escape or token, also not in one of wider characters.
BREAK = re.compile(rb"[!$()*,<>?@\[\]^`|~\x01-\x08\x0e-\x1f\x7f-\xff]|\x00{8}")
LAST_BREAK = re.compile(rb"(?s:.*)(?:" + BREAK.pattern + rb")")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: Bytes unpacked at a time, and compressed bytes given at a time.
PIECE, STEP = 1 << 20, 1 << 14

MARK = "[secret]"
#: Streams in streams are unpacked in each other.
DEPTH = 100_000
sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "n_layers bigint, n_cut bigint"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_cut", pa.int64()),
    ]
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the finds in one text, sorted; leftmost, none overlaps its kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is found whole; a shorter run holds no match.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A text with, for each character, the range of the original text it stands for."""

    text: str
    low: np.ndarray
    high: np.ndarray


def _replaced(layer: Layer, parts: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with ranges replaced; each part's characters have ranges within it."""
    texts, lows, highs, at = [], [], [], 0
    for start, end, text, ranges in parts:
        texts += (layer.text[at:start], text)
        lows += (layer.low[at:start], layer.low[[start + a for a, _ in ranges]] if ranges else layer.low[:0])
        highs += (layer.high[at:start], layer.high[[start + b - 1 for _, b in ranges]] if ranges else layer.high[:0])
        at = end
    texts.append(layer.text[at:])
    lows.append(layer.low[at:])
    highs.append(layer.high[at:])
    return Layer("".join(texts), np.concatenate(lows), np.concatenate(highs))


def _text_of(data: bytes) -> tuple[str, list[int]]:
    """Characters of UTF-8 bytes with the bytes each takes; a bad byte is one Latin-1 character."""
    try:
        text = data.decode()
        return text, [len(c.encode()) for c in text]
    except UnicodeDecodeError:
        pass
    text, sizes, at = [], [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                text.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            text.append(data[at : at + 1].decode("latin-1"))
        sizes.append(min(size, len(data) - at))
        at += sizes[-1]
    return "".join(text), sizes


def unwrap_percent(layer: Layer) -> list[Layer]:
    """The layer with percent escapes as UTF-8 text, and as single bytes where that differs."""
    if "%" not in layer.text:
        return []
    parts, single = [], []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        text, sizes = _text_of(data)
        ends = np.cumsum(sizes)
        parts.append((*m.span(), text, [(3 * (e - n), 3 * e) for e, n in zip(ends.tolist(), sizes)]))
        single.append((*m.span(), data.decode("latin-1"), [(3 * i, 3 * i + 3) for i in range(len(data))]))
    if not parts:
        return []
    differs = any(a[2] != b[2] for a, b in zip(parts, single))
    return [_replaced(layer, p) for p in ([parts, single] if differs else [parts])]


def _number(groups: tuple[str | None, ...]) -> int:
    """Code point of a character escape, by its groups."""
    at, digits = next((i, g) for i, g in enumerate(groups) if g is not None)
    if at == 6:
        return _SHORT.get(digits, ord(digits))
    return int(digits, 10 if at == 5 else 16)


def unwrap_escapes(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    parts, pending = [], None
    for m in ESCAPE.finditer(layer.text):
        number = _number(m.groups())
        if pending and pending[1] == m.start() and 0xDC00 <= number < 0xE000:
            number = 0x10000 + ((pending[2] - 0xD800) << 10) + (number - 0xDC00)
            parts.append((pending[0], m.end(), chr(number), [(0, m.end() - pending[0])]))
            pending = None
            continue
        pending = (m.start(), m.end(), number) if 0xD800 <= number < 0xDC00 else None
        if number < 0xD800 or 0xE000 <= number < 0x110000:
            parts.append((*m.span(), chr(number), [(0, m.end() - m.start())]))
    return _replaced(layer, parts) if parts else None


def _parts(data, match: re.Match, decoded: Callable[[re.Match], bytes], pattern: re.Pattern) -> Iterator[bytes]:
    """Data with the places of a pattern decoded, from its first match on, a piece at a time."""
    at = 0
    for m in chain([match], pattern.finditer(data, match.end())):
        for start in range(at, m.start(), PIECE):
            yield data[start : min(start + PIECE, m.start())]
        yield decoded(m)
        at = m.end()
    for start in range(at, len(data), PIECE):
        yield data[start : start + PIECE]


def _escaped(m: re.Match) -> bytes:
    number = _number(tuple(g if g is None else g.decode() for g in m.groups()))
    # No find, token or stream has characters beyond a byte.
    return bytes([number]) if number < 256 else b"\xff"


def _decoded(data, start: int, end: int, skip: int) -> Iterator[bytes]:
    """The bytes of base64 characters from start to end without white space and the first `skip`."""
    rest = b""
    for at in range(start, end, PIECE):
        piece = data[at : min(at + PIECE, end)].translate(_STANDARD, b" \t\r\n=")
        piece, skip = rest + piece[skip:], max(0, skip - len(piece))
        whole = len(piece) // 4 * 4
        yield binascii.a2b_base64(piece[:whole])
        rest = piece[whole:]
    if len(rest) > 1:
        yield binascii.a2b_base64(rest + b"=" * (4 - len(rest)))


@dataclass
class Inside:
    """What compressed tokens hold: kinds of finds, layers met, contents seen whole."""

    kinds: set[int] = field(default_factory=set)
    layers: int = 0
    seen: set[bytes] = field(default_factory=set)


class Unpacker:
    """Members of one compressed stream, one after the other; their contents are scanned together.

    `used` is the number of bytes up to the end of the last member, `starts` where members begin.
    A raw one is deflated data without a head.
    """

    def __init__(self, inside: Inside, raw: bool = False):
        self.content = Content(inside)
        self.tool, self.pending, self.starts = None, b"", []
        if raw:
            self.tool, self.starts = zlib.decompressobj(-15), [0]
        self.fed = self.used = 0
        self.done = self.ended = False

    def _open(self, data: bytes) -> int | None:
        """Bytes ahead of the member's stream, -1 while its head is not whole; None if it is no member."""
        if not MAGIC.match(data):
            return None
        if data[:4] == b"PK\x03\x04":
            names = int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")
            if len(data) < 30 or len(data) < 30 + names:
                return -1
            self.tool = zlib.decompressobj(-15)
            return 30 + names
        if data[:1] == b"\x1f":
            self.tool = zlib.decompressobj(31)
        elif data[:1] == b"B":
            self.tool = bz2.BZ2Decompressor()
        elif data[:1] in b"\xfd\x5d":
            self.tool = lzma.LZMADecompressor(memlimit=LZMA_BYTES)
        else:
            self.tool = zlib.decompressobj()
        return 0

    def feed(self, data) -> None:
        for at in range(0, len(data), STEP):
            if self.done:
                return
            self._feed(bytes(data[at : at + STEP]))

    def _feed(self, data: bytes) -> None:
        data, self.pending = self.pending + data, b""
        self.fed += len(data)
        while data:
            if self.tool is None:
                # Members may be padded; the next one is known by its first bytes.
                data = data.lstrip(b"\0") if self.starts else data
                if self.starts and len(data) < MAGIC_BYTES:
                    self.pending = data
                    self.fed -= len(data)
                    return
                head = self._open(data)
                if head is None:
                    self.finish()
                    return
                if head < 0:
                    self.pending = data
                    self.fed -= len(data)
                    return
                self.starts.append(self.fed - len(data))
                data = data[head:]
            data = self._contents(data)
            if data is None:
                self.finish()
                return
            if self.tool.eof:
                self.tool, self.used = None, self.fed - len(data)

    def _contents(self, data: bytes) -> bytes | None:
        """Push what the bytes unpack to; the bytes behind the member are returned, None if damaged."""
        deflate = not isinstance(self.tool, (bz2.BZ2Decompressor, lzma.LZMADecompressor))
        while True:
            try:
                piece = self.tool.decompress(data, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return None
            self.content.push(piece)
            if self.tool.eof:
                return self.tool.unused_data
            data = self.tool.unconsumed_tail if deflate else b""
            if not data and (len(piece) < PIECE if deflate else self.tool.needs_input):
                return b""

    def finish(self) -> None:
        if not self.done:
            self.done = True
            self.ended = self.tool is None and self.used > 0
            self.content.end()


class Content:
    """Bytes that all stand for one range, taken in pieces.

    They are held up to the last byte that no find, escape or token can hold, and what is
    before is searched. A run without such a byte goes to a file when it is long, and is
    searched there, so memory does not grow with it. `raw`: they may begin with raw deflate.
    """

    def __init__(self, inside: Inside, raw: bool = False):
        self.inside, self.raw = inside, raw
        self.held, self.size = [], 0
        self.digest = hashlib.blake2b(digest_size=16)
        self.file, self.counted = None, False
        #: Open streams; the last bytes, their place, and where members of open streams begin.
        self.unpackers, self.tail, self.at, self.taken = [], b"", 0, set()

    def push(self, piece: bytes) -> None:
        if not piece:
            return
        self.digest.update(piece)
        if self.file is not None:
            m = BREAK.search(piece)
            self.file.write(piece if m is None else piece[: m.end()])
            if m is None:
                return
            self._filed()
            piece = piece[m.end() :]
        self.held.append(piece)
        self.size += len(piece)
        if self.size < PIECE:
            return
        data = b"".join(self.held)
        m = LAST_BREAK.match(data)
        if m:
            self._search(data[: m.end()])
            self.held, self.size = [data[m.end() :]], len(data) - m.end()
        else:
            self.file = tempfile.TemporaryFile()
            self.file.write(data)
            self.held, self.size = [], 0

    def _filed(self) -> None:
        self.file.flush()
        data, file = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), self.file
        self.file = None
        self._search(data)
        file.close()

    def end(self) -> None:
        """Search what is left, unless the same contents, of any size, were searched to their end."""
        unpackers, held, file = self.unpackers, self.held, self.file
        self.unpackers, self.held = [], []
        if self._known(self.digest, self.raw):
            if file is not None:
                file.close()
            return
        self.unpackers = unpackers
        if file is not None:
            self._filed()
        else:
            self._search(b"".join(held))
        for one in self.unpackers:
            one.finish()
        self.unpackers = []

    def _known(self, digest, raw: bool) -> bool:
        key = digest.digest() + bytes([raw])
        if key in self.inside.seen:
            return True
        self.inside.seen.add(key)
        return False

    def _search(self, data) -> None:
        if not len(data):
            return
        self._unpack(data)
        work, derived = deque([data]), False
        while work:
            data = work.popleft()
            if not PRINTABLE.search(data):
                continue
            if derived or not self.counted:
                self.inside.layers += 1
            derived = self.counted = True
            self._kinds(data)
            for parts, raw in self._derived(data):
                if isinstance(data, bytes):
                    new = b"".join(parts)
                    if new and not self._known(hashlib.blake2b(new, digest_size=16), raw):
                        deque(members(new, self.inside, raw), maxlen=0)
                        work.append(new)
                else:
                    inner = Content(self.inside, raw)
                    for part in parts:
                        inner.push(part)
                    inner.end()

    def _unpack(self, data) -> None:
        """Go on with open streams, and open those that begin here, also across the last end."""
        for one in self.unpackers:
            before = len(one.starts)
            one.feed(data)
            self.taken.update(one.origin + s for s in one.starts[before:])
        tail = len(self.tail)
        joined = self.tail + data[: MAGIC_BYTES - 1]
        found = [a - tail for a, b in _marks(joined) if a < tail < b]
        if self.raw and not self.at:
            one = Unpacker(self.inside, raw=True)
            one.origin = 0
            one.feed(data)
            self.unpackers.append(one)
        for start in chain(found, (a for a, _ in _marks(data))):
            place = self.at + start
            if place not in self.taken:
                one = Unpacker(self.inside)
                one.origin = place
                if start < 0:
                    one.feed(self.tail[start:] + data[:MAGIC_BYTES])
                one.feed(_Slice(data, start if start >= 0 else MAGIC_BYTES))
                self.taken.update(place + s for s in one.starts)
                self.unpackers.append(one)
        self.unpackers = [one for one in self.unpackers if not one.done]
        self.at += len(data)
        self.tail = (self.tail + data[-MAGIC_BYTES + 1 :])[-MAGIC_BYTES + 1 :]

    def _kinds(self, data) -> None:
        kinds = self.inside.kinds
        # A mapped file is not copied to look for the words first.
        lowered = data.lower() if isinstance(data, bytes) else None
        told = lowered is None or any(word.encode() in lowered for word in _KEYWORDS)
        if told and 0 not in kinds and any(m.end(2) - m.start(2) >= 6 for m in ASSIGN_BYTES.finditer(data)):
            kinds.add(0)
        if 1 not in kinds and any(m.end() - m.start() >= 20 for m in ACCESS_BYTES.finditer(data)):
            kinds.add(1)
        if 2 not in kinds and HEX_BYTES.search(data):
            kinds.add(2)

    def _derived(self, data) -> Iterator[tuple[Iterator[bytes], bool]]:
        """What can be unwrapped, in pieces, and whether it may begin with raw deflate."""
        m = PERCENT_BYTES.search(data) if data.find(b"%") >= 0 else None
        if m:
            yield _parts(data, m, lambda m: bytes.fromhex(m[0].replace(b"%", b"").decode()), PERCENT_BYTES), False
        m = ESCAPE_BYTES.search(data)
        if m:
            yield _parts(data, m, _escaped, ESCAPE_BYTES), False
        for pattern, step, place in WIDE_BYTES if data.find(b"\0") >= 0 else ():
            for m in pattern.finditer(data):
                ends = range(m.start(), m.end(), PIECE * step)
                yield (data[i : min(i + PIECE * step, m.end())][place::step] for i in ends), False
        for pattern in (RUN_BYTES, BASE64_BYTES):
            for m in pattern.finditer(data):
                for skip in range(4):
                    yield _decoded(data, *m.span(), skip), True


class _Slice:
    """The rest of bytes or of a mapped file, sliced without a copy of the whole."""

    def __init__(self, data, start: int):
        self.data, self.start = data, start

    def __len__(self) -> int:
        return max(0, len(self.data) - self.start)

    def __getitem__(self, part: slice) -> bytes:
        return self.data[self.start + part.start : self.start + part.stop]


def _marks(data) -> Iterator[tuple[int, int]]:
    """Places of the first bytes of streams; they may overlap."""
    m = MAGIC.search(data)
    while m:
        yield m.span()
        m = MAGIC.search(data, m.start() + 1)


def members(data: bytes, inside: Inside | None = None, raw: bool = False) -> Iterator[tuple[int, Unpacker]]:
    """The compressed streams in some bytes, each with its start; they may begin anywhere."""
    taken = set()
    for start, plain in chain([(0, True)] if raw else [], ((a, False) for a, _ in _marks(data))):
        if plain or start not in taken:
            one = Unpacker(inside or Inside(), plain)
            one.feed(_Slice(data, start))
            one.finish()
            if not plain:
                taken.update(start + s for s in one.starts)
            yield start, one


def streams(data: bytes, raw: bool = False) -> Iterator[tuple[int, int, set[int], int]]:
    """(start, end, kinds of finds, layers) of the compressed streams in some bytes.

    One that is damaged, or cut, stands for all that follows.
    """
    for start, one in members(data, raw=raw):
        inside = one.content.inside
        end = start + one.used if one.ended else len(data)
        yield start, end, inside.kinds, inside.layers


def unwrap_wide(layer: Layer) -> list[Layer]:
    """Layers of the ASCII runs of UTF-16 and UTF-32 bytes."""
    layers = []
    if "\0" in layer.text:
        for pattern, step, place in WIDE:
            for m in pattern.finditer(layer.text):
                low, high = layer.low[m.start() : m.end()], layer.high[m.start() : m.end()]
                layers.append(Layer(m[0][place::step], low[::step], high[step - 1 :: step]))
    return layers


def unwrap_base64(layer: Layer) -> tuple[list[Layer], set[tuple[int, int, int]], int]:
    """Layers of base64 tokens; finds in compressed ones, as ranges of the text; layers in these.

    A token is a run of its characters, or lines of them with the white space taken out. It may
    be glued to other characters, so it is decoded from each of its first four.
    """
    layers, spans, count = [], set(), 0
    for pattern in (RUN, BASE64):
        for m in pattern.finditer(layer.text):
            whole = np.arange(m.start(), m.end())
            if pattern is RUN:
                codes = np.frombuffer(m[0].encode(), dtype=np.uint8)
                whole = whole[(codes > 32) & (codes != 61)]
            last = int(layer.high[m.end() - 1])
            token = m[0].encode()
            for skip in range(4):
                data = b"".join(_decoded(token, 0, len(token), skip))
                places = whole[skip:]
                for start, end, kinds, inner in streams(data, raw=True):
                    count += inner
                    if kinds:
                        high = int(layer.high[places[((end - 1) * 8 + 7) // 6]]) if end < len(data) else last
                        spans.update((int(layer.low[places[start * 8 // 6]]), kind, high) for kind in kinds)
                if not PRINTABLE.search(data):
                    continue
                at = np.arange(len(data))
                # Byte i comes from the base64 characters i*8//6 to (i*8+7)//6.
                layers.append(Layer(data.decode("latin-1"), layer.low[places[at * 8 // 6]], layer.high[places[(at * 8 + 7) // 6]]))
    return layers, spans, count


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base finds, all finds (start, kind, end), number of layers unwrapped and of cut tokens."""
    base = scan(text)
    spans = set(base)
    identity = np.arange(len(text), dtype=np.int64)
    work = deque([Layer(text, identity, identity + 1)])
    seen = {(text, 0, len(text))}
    layers = 0
    while work:
        layer = work.popleft()
        inner, packed, more = unwrap_base64(layer)
        spans.update(packed)
        layers += more
        unwrapped = [*unwrap_percent(layer), unwrap_escapes(layer), *unwrap_wide(layer)]
        for n, new in enumerate(chain(unwrapped, inner)):
            if new is None or not new.text:
                continue
            key = (new.text, int(new.low[0]), int(new.high[-1]))
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            spans.update((int(new.low[a]), kind, int(new.high[b - 1])) for a, kind, b in scan(new.text))
            work.append(new)
            if n < len(unwrapped):
                # Those of base64 tokens are known already.
                for start, end, kinds, more in streams(new.text.encode("latin-1", "replace")):
                    layers += more
                    spans.update((int(new.low[start]), kind, int(new.high[end - 1])) for kind in kinds)
    return base, sorted(spans), layers, 0


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str) -> str:
    """The text with every find, merged where they overlap, replaced by a mark."""
    out, at = [], 0
    for start, _, end in find_all(text)[1]:
        if start >= at:
            out += (text[at:start], MARK)
        at = max(at, end)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base finds by kind and digest, and the ranges of all finds."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = [find_all(text) for text in part.column("text").to_pylist()]
                counts = [[sum(1 for s in base if s[1] == kind) for base, *_ in found] for kind in range(3)]
                yield rows_batch(
                    _ARROW,
                    [
                        part.column("doc_id"),
                        *counts,
                        [sha256_hex(_joined(base).encode()) for base, *_ in found],
                        [_joined(spans) for _, spans, *_ in found],
                        [f[2] for f in found],
                        [f[3] for f in found],
                    ],
                )

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(lean(run), SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their finds replaced by a mark; `n_chars`, if there, is recounted."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        cleaned = pa.array([t if t is None else redact(t) for t in texts.to_pylist()], type=pa.string())
        give_back()
        return cleaned

    ship(docs.sparkSession)
    marked = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        marked = marked.withColumn("n_chars", F.char_length("text").cast(kind))
    return marked
