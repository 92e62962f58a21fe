"""Token-id files: interleaved range asymmetric numeral system blocks of shared static tables.

Texts are encoded by a tokenizer file of the `tokenizers` library; each document's ids end
with `END_ID`. The counts of all ids over all documents give one table of frequencies that
every block shares. Documents go to files in ascending `doc_id`: quantiles of the ids cut
them into ranges, each range is sorted and cut into blocks of whole documents. A block
decodes on its own: its ids are dealt over lanes whose states advance together, one word
stream serves all lanes, and checkpoints (all states and the place in the stream) allow to
start in the middle. Checksums cover the stored bytes and the decoded ids.

A file is a sequence of blocks, each followed by a line feed. Blocks are written by Spark's
text writer, so only committed task attempts count and any file system will do.

Defined results: a null or empty text is the end id alone; null `doc_id`s sort first; rows
with the same `doc_id` keep one place each, ordered by their ids' checksum and number;
other columns are ignored; an empty table gives files without blocks and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.common import chunks, id_and_text, rows_batch, ship
from tideglass.session import materialise, scratch_folder

END_ID = 1
BLOCK_IDS = 1 << 18
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCKS_PER_FILE = 128
_CACHE_WORDS = 600_000

SCALE_BITS = 20
_LOW = 1 << 31  # states live in [2^31, 2^63) and give or take 32 bits at a time
_MAGIC = b"TGR1"
_HEADER = struct.Struct("<4sIQQQQIIIIII")


# Tokenizing.

#: Words of letters whose lower case and byte spelling need no Unicode tables (ASCII, Latin-1),
#: and what may stand behind them: ASCII that is neither letter, number nor white space.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_PROBES = ("a", "Word", "ÉTÉ", "straße", "ñandú", "ÿ", "Þing", "supercalifragilistic", "l", "ÄÖÜäöü")
_TAILS = ("", "?!", "&&&", "'", "''", "%%%", "--", "](", "_\"", *_TAIL)
#: Whole Latin-1 texts to try lower-casing on: contractions, numbers, marks and letters without a case.
_CASES = ("It'S ÉTÉ'LL 4X", "A1B2 (QUI)DON'T", "µM ªº ÷×ß ÐÞ", "X_Y@Z.COM \"Ñ\" ¿QUÉ?", "\xad\xa0A\x85B\x1cC\u00bd")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level tokenizers: printable Latin-1 stays, the rest moves up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordIds(dict):
    """Ids of words as bytes, encoded by the library on first sight.

    A word of plain letters goes straight to the library's merge model, lower-cased and in
    byte letters as its pipeline would hand it on; punctuation at its end is a piece of its
    own. Every other word goes through the whole pipeline. Whether the short way holds for
    this tokenizer, and whether it takes lower-cased texts for the same, is tried out on
    probes when it is loaded.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}
        # Found in a text as they stand, in upper or lower case.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        probes = [p + t for p in _PROBES for t in _TAILS]
        self.short = True
        self.short = all(self._short(p) == self._whole(p) for p in probes)
        self.caseless = all(self._whole(p) == self._whole(p.lower()) for p in (*probes, *_CASES))
        self.clear()

    def _whole(self, word: str) -> bytes:
        (coded,) = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)
        return array("I", coded.ids).tobytes()

    def _short(self, word: str) -> bytes | None:
        found = _WORD.fullmatch(word)
        if found is None:
            return None
        core, tail = found.groups()
        if tail:
            return self[core] + self[tail]
        lowered = core.lower()
        if lowered != core:
            return self[lowered]
        if not core.isascii():
            core = "".join([self.letters[b] for b in core.encode()])
        return array("I", [t.id for t in self.merge(core)]).tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text; lower-cased before they are cut where that changes no id."""
        if self.caseless and _is_latin(text):
            lowered = text.lower()
            # Lower-casing must not make a token that is not there.
            if not any(token in lowered for token in self.added):
                text = lowered
        return text.replace("\n", " ").split(" ")

    def __missing__(self, word: str) -> bytes:
        coded = self.older.get(word)
        if coded is None:
            coded = (self.short and self._short(word)) or self._whole(word)
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                # The words of late live on in the older half.
                self.older = dict(self)
                self.clear()
            self[word] = coded
        return coded


def _is_latin(text: str) -> bool:
    """Whether all characters are Latin-1, whose lower case is a table of single letters."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts without the end id.

    No token of this kind of tokenizer spans white space, and white space gives none, so
    texts are cut at spaces and line feeds and each distinct word is encoded once.
    """
    known = word_ids(path)
    get = known.__getitem__
    return [np.frombuffer(b"".join(map(get, known.words(text))), dtype="<u4") for text in texts]


# The coder.


@dataclass(frozen=True)
class Table:
    """Frequencies of ids that add up to 2 ** SCALE_BITS."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        total, scale = int(counts.sum()), 1 << SCALE_BITS
        seen = counts > 0
        if int(seen.sum()) > scale:
            raise ValueError("more distinct ids than the table has places")
        freq = np.where(seen, np.maximum(1, np.round(counts * (scale / max(total, 1)))), 0).astype(np.int64)
        if total:
            # Rounding is made up where it matters least: at the most frequent ids.
            for i in np.argsort(-freq, kind="stable"):
                off = scale - int(freq.sum())
                if off == 0:
                    break
                freq[i] = max(1, int(freq[i]) + off)
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        return cls(freq.astype(np.uint64), start.astype(np.uint64), symbol)


def encode_ids(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final states, 32-bit words and checkpoints (word place and states) of ids dealt over lanes."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    words, kept = [], []
    shift, scale = np.uint64(32), np.uint64(SCALE_BITS)
    room = np.uint64(31 - SCALE_BITS + 32)
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << room)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> shift, x)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + c
        if step and step % CHECKPOINT_STEPS == 0:
            kept.append((len(words), state.copy()))
    total = sum(map(len, words))
    # Words read forwards: the last step encoded is the first one decoded.
    sizes = np.cumsum([len(w) for w in words])
    checkpoints = np.array(
        [[total - int(sizes[n - 1]), *s.tolist()] for n, s in reversed(kept)], dtype=np.uint64
    ).reshape(-1, lanes + 1)
    stream = np.concatenate(words[::-1]) if words else np.empty(0, dtype=np.uint32)
    return state, stream, checkpoints


def decode_ids(
    state: np.ndarray, stream: np.ndarray, n: int, table: Table, at: int = 0, first: int = 0, stop: int | None = None
) -> np.ndarray:
    """Ids from step `first` on, given the lanes' states and the place in the stream there."""
    lanes = len(state)
    steps = -(-n // lanes) if stop is None else min(stop, -(-n // lanes))
    state = state.copy()
    mask, shift, scale = np.uint64((1 << SCALE_BITS) - 1), np.uint64(32), np.uint64(SCALE_BITS)
    out = []
    for step in range(first, steps):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        symbol = table.symbol[slot]
        x = table.freq[symbol] * (x >> scale) + slot - table.start[symbol]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << shift) | stream[at : at + len(low)].astype(np.uint64)
        at += len(low)
        state[:width] = x
        out.append(symbol)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def lanes_for(n: int) -> int:
    """Lanes for a block of n ids: fewer where their states would outweigh the ids."""
    lanes = LANES
    while lanes > 1 and n < lanes * 32:
        lanes //= 2
    return lanes


def pack_block(part: int, number: int, offset: int, keys: list, counts: list[int], ids: np.ndarray, table: Table) -> bytes:
    lanes = lanes_for(len(ids))
    state, stream, checkpoints = encode_ids(ids, table, lanes)
    body = b"".join(
        [
            np.array([k is not None for k in keys], dtype=np.uint8).tobytes(),
            np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
            np.array(counts, dtype="<u8").tobytes(),
            state.astype("<u8").tobytes(),
            checkpoints.astype("<u8").tobytes(),
            stream.astype("<u4").tobytes(),
        ]
    )
    header = _HEADER.pack(
        _MAGIC, part, number, offset, len(ids), len(body), len(keys), lanes, len(checkpoints), len(stream),
        zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body),
    )
    return header + body


@dataclass
class Block:
    part: int
    number: int
    offset: int
    keys: list
    counts: np.ndarray
    n_ids: int
    state: np.ndarray
    checkpoints: np.ndarray
    stream: np.ndarray
    ids_crc: int

    def ids(self, table: Table) -> np.ndarray:
        ids = decode_ids(self.state, self.stream, self.n_ids, table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError(f"block {self.part}/{self.number}: decoded ids do not match their checksum")
        return ids

    def slice(self, begin: int, end: int, table: Table) -> np.ndarray:
        """Ids begin to end of the block, decoded from the nearest checkpoint on."""
        lanes = len(self.state)
        near = min(begin // lanes // CHECKPOINT_STEPS, len(self.checkpoints))
        first, at, state = 0, 0, self.state
        if near:
            first, at = near * CHECKPOINT_STEPS, int(self.checkpoints[near - 1, 0])
            state = self.checkpoints[near - 1, 1:]
        ids = decode_ids(state, self.stream, self.n_ids, table, at, first, -(-end // lanes))
        return ids[begin - first * lanes : end - first * lanes]


def read_blocks(data: bytes):
    at = 0
    while at < len(data):
        fields = _HEADER.unpack_from(data, at)
        magic, part, number, offset, n_ids, size, n_docs, lanes, n_checks, n_words, ids_crc, body_crc = fields
        begin = at + _HEADER.size
        body = data[begin : begin + size]
        if magic != _MAGIC or len(body) != size or zlib.crc32(body) != body_crc:
            raise ValueError(f"damaged block at byte {at}")
        place = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            values = np.frombuffer(body, dtype=kind, count=count, offset=place)
            place += values.nbytes
            return values

        known, keys, counts = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
        state = take("<u8", lanes)
        checks = take("<u8", n_checks * (lanes + 1)).reshape(-1, lanes + 1)
        yield Block(
            part, number, offset, [k if ok else None for k, ok in zip(keys.tolist(), known)], counts, n_ids, state,
            checks, take("<u4", n_words), ids_crc,
        )
        at = begin + size + 1  # and a line feed


# The jobs.


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, and the frequencies they were written with."""

    path: str
    counts: np.ndarray


def _parts(docs: DataFrame, wanted: int) -> list[int]:
    """Bounds that cut `doc_id` into ranges of about as many documents."""
    steps = [i / wanted for i in range(1, wanted)]
    if not steps:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", steps, 10 * wanted)).first()[0]
    return sorted(set(cuts or []))


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str) -> TokenFiles:
    """Write the ids of all documents below `path`, a folder that all executors share."""
    spark = ship(docs.sparkSession)
    rows = id_and_text(docs)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _parts(rows, wanted)

    def tokenize(batches):
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for part in chunks(batch):
                keys = part.column("doc_id").to_pylist()
                coded = [
                    ids.tobytes() + struct.pack("<I", END_ID)
                    for ids in encode_texts(part.column("text").to_pylist(), tokenizer_path)
                ]
                places = [0 if k is None else int(np.searchsorted(bounds, k)) for k in keys]
                small = [np.frombuffer(c, dtype="<u4") for c in coded]
                packed = [
                    (b"\2" + s.astype("<u2").tobytes()) if s.max() < 1 << 16 else b"\4" + c
                    for s, c in zip(small, coded)
                ]
                yield rows_batch(schema, [places, keys, [zlib.crc32(c) for c in coded], packed])

    coded = materialise(rows.mapInArrow(tokenize, "part int, doc_id bigint, crc bigint, ids binary"))

    def count(batches):
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            packed = batch.column("ids").to_pylist()
            for begin in range(0, len(packed), 512):
                found = np.bincount(np.concatenate([_unpacked(p) for p in packed[begin : begin + 512]]))
                if len(found) > len(counts):
                    counts = np.pad(counts, (0, len(found) - len(counts)))
                counts[: len(found)] += found
        seen = np.flatnonzero(counts)
        yield rows_batch(pa.schema([("id", pa.int64()), ("n", pa.int64())]), [seen, counts[seen]])

    # At most one row per id of the vocabulary comes to the driver.
    found = coded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.int64)
    for row in found:
        counts[row["id"]] = row["n"]
    shared = spark.sparkContext.broadcast(counts)

    def pack(batches):
        table = Table.of(shared.value)
        schema = pa.schema([("block", pa.binary())])
        part, number, offset, keys, ids = None, 0, 0, [], []

        def flush():
            nonlocal number, offset, keys, ids
            if keys:
                joined = np.concatenate(ids)
                block = pack_block(part, number, offset, keys, [len(i) for i in ids], joined, table)
                number, offset, keys, ids = number + 1, offset + len(joined), [], []
                yield rows_batch(schema, [[block]])

        held = 0
        for batch in batches:
            for own, key, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if own != part or held >= BLOCK_IDS:
                    yield from flush()
                    held = 0
                if own != part:
                    part, number, offset = own, 0, 0
                keys.append(key)
                ids.append(_unpacked(packed))
                held += len(ids[-1])
        yield from flush()

    (
        coded.repartition(wanted, "part")
        .sortWithinPartitions("part", "doc_id", "crc", F.octet_length("ids"))
        .select("part", "doc_id", "ids")
        .mapInArrow(pack, "block binary")
        # Bytes as they are: a cast from binary checks and changes nothing.
        .select(F.col("block").cast("string"))
        .write.option("maxRecordsPerFile", BLOCKS_PER_FILE)
        .text(path)
    )
    return TokenFiles(path, counts)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.uint32)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document what its file holds: `start`, `n_tokens`, `ids_crc32`."""
    shared = spark.sparkContext.broadcast(files.counts)
    schema = "part int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = pa.schema(
        [
            ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )

    def unpack(batches):
        table = Table.of(shared.value)
        for batch in batches:
            for content in batch.column("content"):
                for block in read_blocks(content.as_buffer().to_pybytes()):
                    data = block.ids(table).astype("<u4").tobytes()
                    ends = np.cumsum(block.counts.astype(np.int64))
                    begins = ends - block.counts.astype(np.int64)
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield rows_batch(
                        arrow, [[block.part] * len(sums), begins + block.offset, block.keys, ends - begins, sums]
                    )

    found = spark.read.format("binaryFile").load(files.path).select("content").mapInArrow(unpack, schema)
    read = materialise(found)
    # One row per range: as many as the job had partitions.
    sizes = {r["part"]: r["n"] for r in read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = [], 0
    for part in sorted(sizes):
        bases.append((part, total))
        total += sizes[part]
    base = F.broadcast(spark.createDataFrame(bases, "part int, _base bigint"))
    return read.join(base, "part").select(
        "doc_id", (F.col("place") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write token files (below the session's shared folder unless told otherwise), read them back."""
    spark = docs.sparkSession
    path = path or f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(docs, tokenizer_path, path))
