"""Quality classifier: supervised subword embeddings, averaged, with a softmax output.

Features of a text are its words, the character 3- to 5-grams within a word and its
neighbouring blanks, and a mark for each word that repeats the word before it or the one
before that, hashed into `BUCKETS` rows of one table of vectors. A document is
the mean of the vectors of all its features; a linear layer and a softmax turn it into
class probabilities. Vectors and layer are learned together by stochastic gradient descent
in numpy, on a bounded sample of labelled rows: the `SAMPLE_ROWS` rows that may be learned
from with the smallest hash of their id, whole texts. Rows whose crc32(doc_id) mod 4 is 2
are held out. Labels, language, source and id are never inputs of a score.

Scoring is one pass without a shuffle. A mean and a linear layer commute, so each table
row is first reduced to its share of the two classes' difference, a table of 256 KiB.

Defined results: a null or empty text has no features and gets the score of the layer's
bias alone; repeated rows are scored row by row; a repeated label row counts again; labels
that are null are left out. Without rows of both classes there is nothing to learn: the
score is then the smoothed share (ones + 1) / (rows + 1). Other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import give_back, lean, ship

SAMPLE_ROWS = 4000
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 5
#: Steps at least, so that few rows are gone over more often.
LEAST_STEPS = 8000
RATE = 2.0
SEED = 11
THRESHOLD = 0.7
GRAMS = (3, 4, 5)
#: Characters held as arrays at a time; features do not reach across a cut between words.
_SPAN = 1 << 17

_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _SPREAD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position of every feature in code points that begin and end with a blank.

    `starts` are the places where documents start, so that no mark looks past its document.
    """
    blank = (points <= 32) | (points == 0x85) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A))
    codes = np.where(blank, np.uint64(32), points.astype(np.uint64))
    buckets, places = [], []
    gaps = np.concatenate([[0], np.cumsum(blank)])
    rolling = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolling = rolling[:size] * _PRIME + codes[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            # No blank inside; a blank at either end marks the edge of a word.
            inside = gaps[n - 1 : n - 1 + size] - gaps[1 : 1 + size]
            at = np.flatnonzero(inside == 0)
            buckets.append(_bucket(rolling[at] ^ np.uint64(n)))
            places.append(at)
    # Words: sums of position-weighted code points between blanks.
    edge = np.diff((~blank).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(7)) * up[: len(codes)])])
    words = (sums[end] - sums[begin]) * down[begin]
    buckets.append(_bucket(words ^ (words >> np.uint64(29))))
    places.append(begin)
    owner = np.searchsorted(starts, begin, side="right")
    for back in (1, 2):
        again = np.flatnonzero((words[back:] == words[:-back]) & (owner[back:] == owner[:-back])) + back
        buckets.append(np.full(len(again), back, dtype=np.int64))
        places.append(begin[again])
    return np.concatenate(buckets), np.concatenate(places)


_tables: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if len(_tables[0]) < n:
        up = np.full(n, _SPREAD, dtype=np.uint64)
        down = np.full(n, pow(int(_SPREAD), -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _tables = (np.cumprod(up), np.cumprod(down))
    return _tables


def batches_of_features(texts: list[str]):
    """(document, bucket) of the features of texts, in runs of bounded size."""
    run, held, first = [], 0, 0
    for i, text in enumerate([*texts, None]):
        if run and (text is None or held + len(text) > _SPAN):
            joined = " " + " ".join(run) + " "
            points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            # Each text owns the places from its leading blank up to the next one's.
            starts = np.cumsum([0, *[len(t) + 1 for t in run[:-1]]])
            buckets, places = features(points, starts)
            yield np.searchsorted(starts, places, side="right") - 1 + first, buckets
            run, held, first = [], 0, i
        if text is not None:
            run.append(text)
            held += len(text) + 1


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's share of the difference of the classes, and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, buckets in batches_of_features(texts):
            # Exact sums by document: independent of what shares the batch.
            total += np.bincount(owner, self.weight[buckets], len(texts))
            count += np.bincount(owner, minlength=len(texts))
        margin = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Vectors and output layer by stochastic gradient descent, one document a step."""
    rows, ones = len(labels), int(np.sum(labels))
    if ones in (0, rows):
        share = min((ones + 1) / (rows + 1), 1 - 1e-9)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    bags: list[tuple[np.ndarray, np.ndarray]] = [None] * rows
    for owner, buckets in batches_of_features(texts):
        # Counted in a few large arrays: a worker gives their memory back, that of many small ones it keeps.
        keys, times = np.unique(owner * BUCKETS + buckets, return_counts=True)
        total = np.bincount(owner)
        held = keys // BUCKETS
        kinds = (keys % BUCKETS).astype(np.int32)
        share = (times / total[held]).astype(np.float32)
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(held)]):
            bags[held[first]] = (kinds[first:last], share[first:last])
    empty = (np.empty(0, np.int32), np.empty(0, np.float32))
    epochs = max(EPOCHS, -(-LEAST_STEPS // rows))
    step, steps = 0, epochs * rows
    for _ in range(epochs):
        for i in rng.permutation(rows):
            rate = RATE * (1 - step / steps)
            kinds, share = bags[i] or empty
            hidden = share @ vectors[kinds]
            logits = layer @ hidden + bias
            grown = np.exp(logits - logits.max())
            error = grown / grown.sum()
            error[int(labels[i])] -= 1
            back = layer.T @ error
            layer -= rate * np.outer(error, hidden)
            bias -= rate * 0.1 * error
            vectors[kinds] -= (rate * share[:, None]) * back
            step += 1
    difference = layer[1] - layer[0]
    return Model(vectors @ difference, float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most `sample_rows` labelled documents that are not held out.

    One task trains on the sample; only the weights, 256 KiB, come to the driver.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Choose by id before any text is touched; ties in the hash go by id.
    chosen = marked.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most sample_rows small rows: the bound of the sample is the bound of the broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text"))

    def run(batches):
        rows = [(t, q) for b in batches for t, q in zip(b.column("text").to_pylist(), b.column("quality").to_pylist())]
        model = train([t for t, _ in rows], np.array([q for _, q in rows], dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "bias": [model.bias]})

    # A limit after a sort leaves one partition, in order.
    ship(docs.sparkSession)
    sample = found.limit(sample_rows).select("text", "quality").coalesce(1)
    row = sample.mapInArrow(lean(run), "weight binary, bias double").first()
    if row is None:  # an empty sample may be planned away with its task
        return train([], np.empty(0, dtype=np.int64))
    return Model(np.frombuffer(bytes(row.weight), dtype=np.float64), row.bias)


def score(model: Model, docs: DataFrame) -> Column:
    """Column expression: score of `text`."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        values = texts.to_pylist()
        for begin in range(0, len(values), 256):
            out.append(shared.value.scores([t or "" for t in values[begin : begin + 256]]))
        del values
        give_back()
        return pa.array(np.concatenate(out) if out else [], type=pa.float64())

    return F.arrow_udf(run, "double")(F.col("text"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held out or not, score, and the class at the threshold."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = own.withColumn("score", score(fit(own, labels), own))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.withColumn("_score", score(model, docs)).where(F.col("_score") >= THRESHOLD).drop("_score")
