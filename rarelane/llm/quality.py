"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams of words (lower case) and of word shapes (runs
of upper case, lower case, digits; marks as they are; whether a word repeats the
one before), hashed to a fixed number of places.  Each indicator is scaled by its
log-count ratio between the two classes, a document's vector is scaled to length
one, and a linear model with squared hinge loss is fitted by dual coordinate
descent.  Margins become probabilities by a logistic curve fitted to margins of
sample documents that were held back from a first fit.

The model is fitted on at most ``SAMPLE`` labelled documents of at most ``LONGEST`` characters, those with the lowest
hash of their key, in one task; scoring reads every document and keeps no state but
the weights, a vector of fixed length.

Null text: empty; a text without words has no features and gets the score of a zero
margin.  Null labels and labels without a document are not learnt from; of several
labels of one key the smallest counts.  Repeated keys are scored row by row, null
keys too.  With one class or none, every score is the smoothed share of label 1.  An
empty table of documents gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rarelane.llm.tables import keyed_text, text_batches
from rarelane.session import stage_table

#: Labelled documents that the model is fitted on at most.
SAMPLE = 6_000
#: Characters of a text that is fitted on, at most; longer ones are scored like all others.
LONGEST = 20_000
#: Places of the hashed features.
PLACES = 1 << 18
#: Strength of the hinge loss, and rounds of the dual descent.
COST, ROUNDS = 4.0, 8
#: Texts whose features are sorted together.
_TEXTS = 256
#: Words a task remembers the hashes of.
MEMO = 150_000

_RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[^\W\dA-ZÀ-ÖØ-Þ_]+|\d+|(.)\1*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """Runs of one kind as one letter, marks as one mark each."""

    def kind(run: re.Match) -> str:
        if run[1]:
            return run[1]
        first = run[0][0]
        return "0" if first.isdigit() else "A" if first.isupper() else "a"

    return _RUNS.sub(kind, word)


class _Hashes(dict):
    """Word -> its hash in the lower half and its shape's hash in the upper half."""

    def __missing__(self, word: str) -> int:
        low = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        value = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) << 32 | low
        if len(self) < MEMO:
            self[word] = value
        return value


_HASHES = _Hashes()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, places): the distinct feature places of each text, one text after the other."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    both = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, counts.sum())
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    same = (word[pair] == word[pair + 1]).astype(np.uint64)
    bits = np.uint64(64 - PLACES.bit_length() + 1)
    keys = []
    for at, mixed in (
        (owner, word * _MIX),
        (owner[pair], (word[pair] * _MIX ^ word[pair + 1]) * _MIX + np.uint64(1)),
        (owner[pair], ((shape[pair] * _MIX ^ shape[pair + 1]) + same) * _MIX + np.uint64(2)),
        (owner, shape * _MIX + np.uint64(3)),
    ):
        keys.append(at * np.uint64(PLACES) + ((mixed ^ mixed >> np.uint64(31)) * _MIX >> bits))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=np.uint64(2**64 - 1)))]
    ends = np.searchsorted(keys, np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(PLACES))
    return ends, (keys % np.uint64(PLACES)).astype(np.int32)


def ratios(ends: np.ndarray, places: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log-count ratio of each place between documents of label 1 and of label 0."""
    counts = np.ones((2, PLACES))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for at in range(0, len(ends), _TEXTS):
        some = slice(at, at + _TEXTS)
        size = ends[some] - begins[some]
        own = np.repeat(labels[some], size)
        part = places[begins[at] : begins[at] + size.sum()]
        for y in (0, 1):
            counts[y] += np.bincount(part[own == y], minlength=PLACES)
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def descend(ends: np.ndarray, places: np.ndarray, values: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss; the last weight is the constant's.

    ``ends, places, values``: the features of all documents, one after the other; each has a constant 1 besides.
    """
    w = np.zeros(PLACES + 1)
    dual = np.zeros(len(ends))
    slack = 1.0 / (2.0 * COST)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    owns = (values[b:e] for b, e in zip(begins.tolist(), ends.tolist()))
    curve = np.fromiter((float(v @ v) for v in owns), float, len(ends)) + 1.0 + slack
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(ends)).tolist():
            own = slice(begins[i], ends[i])
            at, value = places[own], values[own]
            slope = signs[i] * (w[at] @ value + w[PLACES]) - 1.0 + slack * dual[i]
            new = max(dual[i] - slope / curve[i], 0.0)
            step = new - dual[i]
            if step:
                w[at] += step * signs[i] * value
                w[PLACES] += step * signs[i]
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _values(ends: np.ndarray, places: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features, each document's of length 1 (or 0)."""
    values = scale.astype(np.float32)[places]
    begin = 0
    for end in ends.tolist():
        own = values[begin:end]
        own /= np.sqrt(float(own @ own)) or 1.0
        begin = end
    return values


def _fit_weights(ends, places, labels) -> tuple[np.ndarray, np.ndarray]:
    scale = ratios(ends, places, labels)
    return scale, descend(ends, places, _values(ends, places, scale), np.where(labels == 1, 1.0, -1.0))


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve from margins to probabilities (Newton steps)."""
    a, b = 1.0, 0.0
    # targets are drawn in from 0 and 1 so that separable margins give a finite curve
    target = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (target - p) - 1e-6 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Scales of the places, weights of the scaled places and the constant, slope and constant of the curve."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(PLACES), np.zeros(PLACES + 1), 0.0, float(np.log(share / (1 - share)))
    found = [features(texts[at : at + _TEXTS]) for at in range(0, len(texts), _TEXTS)]
    places = np.concatenate([p for _, p in found])
    ends = np.cumsum(np.concatenate([np.diff(e, prepend=0) for e, _ in found]))
    held = np.arange(len(labels)) % 5 == 0

    def part(keep):
        rows = np.flatnonzero(keep)
        starts = np.concatenate([[0], ends[:-1]])
        picked = [places[starts[i] : ends[i]] for i in rows]
        return np.cumsum([len(p) for p in picked]), np.concatenate(picked), labels[rows]

    both = len(set(labels[held].tolist())) == 2 and len(set(labels[~held].tolist())) == 2
    scale, w = _fit_weights(*part(~held if both else held | ~held))
    ends_held, places_held, labels_held = part(held if both else held | ~held)
    values_held, begin, tops = _values(ends_held, places_held, scale), 0, []
    for end in ends_held.tolist():
        tops.append(float(w[places_held[begin:end]] @ values_held[begin:end]) + w[PLACES])
        begin = end
    del values_held
    curve = _curve(np.array(tops), labels_held)
    return (*_fit_weights(ends, places, labels), *curve)


def scores(texts: list[str], model: tuple) -> np.ndarray:
    scale, w, slope, constant = model
    out = [margins(texts[at : at + _TEXTS], scale, w) for at in range(0, len(texts), _TEXTS)]
    return 1 / (1 + np.exp(-np.clip(slope * np.concatenate([*out, np.empty(0)]) + constant, -500, 500)))


def margins(texts: list[str], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    ends, places = features(texts)
    value = scale[places]
    sums = np.concatenate([[0.0], np.cumsum(value * w[places])])
    squares = np.concatenate([[0.0], np.cumsum(value * value)])
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = np.sqrt(np.maximum(squares[ends] - squares[begin], 0))
    top = sums[ends] - sums[begin]
    return np.divide(top, size, out=np.zeros(len(texts)), where=size > 0) + w[PLACES]


def held_out(key: str = "doc_id"):
    """Whether a row is kept from the fit: the checksum of its key leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple:
    """The model of :func:`scores`, fitted in one task on a bounded sample of labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    sample = stage_table(
        known.groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE),
        "sample",
    )
    # at most SAMPLE short rows are broadcast
    texts = keyed_text(docs).where(F.length("text") <= LONGEST).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            row for b in batches
            for row in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist())
        )
        scale, w, slope, constant = fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
        yield pa.RecordBatch.from_pydict({
            "scale": [scale.tobytes()], "weights": [w.tobytes()], "slope": [slope], "constant": [constant]
        })

    kinds = "scale binary, weights binary, slope double, constant double"
    row = texts.repartition(1).mapInArrow(learn, kinds).first()
    if row is None:  # nothing is labelled
        return fit([], np.empty(0, np.int64))
    return np.frombuffer(row["scale"]), np.frombuffer(row["weights"]), row["slope"], row["constant"]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()), "score": pa.array(scores(texts, sent.value))
            })

    scored = keyed_text(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.string())
            stays = []
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in column.slice(at, 256).to_pylist()]
                stays.extend((scores(texts, sent.value) >= 0.5).tolist())
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
