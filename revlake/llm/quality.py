"""Document quality by random Fourier features of document statistics.

Statistics of a text's characters, words and lines are standardised and sent
through random Fourier features, which approximate a Gaussian kernel. Ridge
regression on the labels solves normal equations summed up by partition, and
isotonic regression on a fold of its own turns raw scores into probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm import bytetext as B
from revlake.llm.tables import fold, written

RANDOM_FEATURES = 256
RIDGE = 1e-3
BINS = 1000
CALIBRATION_FOLD = 3
THRESHOLD = 0.7

_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "shout", "quote", "bracket", "symbol", "long", "rest")
_CLASS = np.full(256, 11, np.int64)
for _i, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?",
    b"\"'`", b"()[]{}<>", b"#$%&*+-/=@\\^_|~",
)):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:] = 10
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False
_NAMES = (
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "top_word",
    "capital_words", "ends_in_mark", "holds_symbol", "words_a_line", "short_lines", "repeated_lines", "repeated_runs", "letter_entropy",
)
FEATURES = tuple(f"f_{n}" for n in _NAMES)


def _shares(codes: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(owner * size + codes, minlength=n * size).reshape(n, size)


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: number of distinct hashes and the count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
        count = np.diff(np.append(first, len(h)))
        distinct = np.bincount(o[first], minlength=n).astype(float)
        np.maximum.at(top, o[first], count)
    return distinct, top


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x features; zeros for an empty text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    classes = _shares(_CLASS[body], owner, n, len(_CLASSES)).astype(float)
    begins, ends, hashes = B.words(body, offsets, B.NOT_SPACE)
    words = B.counts_by_text(begins, offsets).astype(float)
    of = np.repeat(np.arange(n), words.astype(np.int64))
    some, many = np.maximum(words, 1), np.maximum(sizes, 1)
    length = (ends - begins).astype(float)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
    distinct, top = _repeats(hashes, of, n)
    kind = _CLASS[body]
    symbols = np.append(0, np.cumsum(kind == 9))
    capital = (kind[begins] == 1) & (length > 1) & (kind[np.minimum(begins + 1, ends - 1)] == 1)
    marked = (kind[ends - 1] == 6) | (kind[ends - 1] == 9)
    holds = symbols[ends] > symbols[begins]
    share = lambda x: np.bincount(of, x, n) / some
    runs, run_of = B.shingles(hashes, words.astype(np.int64), 3)
    run_kinds, _ = _repeats(runs, run_of, n)
    run_count = np.maximum(np.bincount(run_of, minlength=n), 1)
    # Lines are words between line feeds.
    lb, le, lh = B.words(body, offsets, _IN_LINE)
    lines = B.counts_by_text(lb, offsets)
    line_of = np.repeat(np.arange(n), lines)
    rows = np.maximum(lines, 1)
    line_kinds, _ = _repeats(lh, line_of, n)
    short = np.bincount(line_of, le - lb < 30, n) / rows
    letters = _shares((body[(body | 0x20) >= 0x61] & 0x1F).astype(np.int64), owner[(body | 0x20) >= 0x61], n, 32).astype(float)
    p = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    return np.column_stack([
        classes / many[:, None], np.log1p(sizes), np.log1p(words), mean, spread, distinct / some, top / some,
        share(capital), share(marked), share(holds), np.log1p(words / rows), short, 1 - line_kinds / rows * (lines > 0),
        1 - run_kinds / run_count * (words > 0), entropy,
    ]) * (sizes > 0)[:, None]


_PART = 4 << 20


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and one column for each statistic of the whole text; a null text is empty."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = B.flat(b.column(1))
            low = 0
            while low < len(b):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _PART, "right")) - 1)
                found = statistics(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), *map(pa.array, found.T.copy())], names=["doc_id", *FEATURES])
                low = high

    schema = f"doc_id {id_type}, " + ", ".join(f"{f} double" for f in FEATURES)
    return documents.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Model:
    """Standardisation, random directions, ridge weights and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None  # a probability for each bin of the raw score
    seed: int = 17

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        n = len(FEATURES)
        self.directions = r.normal(size=(n, RANDOM_FEATURES)) / np.sqrt(n)
        self.phases = r.uniform(0, 2 * np.pi, RANDOM_FEATURES)

    def transformed(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.sqrt(2 / RANDOM_FEATURES) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.transformed(stats) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        if self.steps is None:
            return raw
        return np.interp(raw, (np.arange(BINS + 1)) / BINS, self.steps)


def _stats(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]) if len(batch) else np.zeros((0, len(FEATURES)))


def _normal_equations(model: Model):
    """Sums of z z' and z y of a partition, as rows of position and value."""
    size = RANDOM_FEATURES + 1
    upper = np.triu_indices(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            z, y = model.transformed(_stats(b, 1)), b.column(0).to_numpy(zero_copy_only=False).astype(float)
            gram += z.T @ z
            moment += z.T @ y
        values = np.append(gram[upper], moment)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    return run


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least squares among non-decreasing sequences, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents outside the held-out fold; those of fold 3 calibrate.

    Without labels in fold 3, or in it alone, the ridge scores are not calibrated.

    Sums leave the tasks, never rows: the driver solves for RANDOM_FEATURES + 1
    weights and pools BINS + 1 calibration bins.
    """
    learning = stats.filter(fold() != 2)
    spread = learning.select(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]).first()
    mean = np.array([spread[f"m{i}"] or 0.0 for i in range(len(FEATURES))])
    scale = np.array([spread[f"s{i}"] or 1.0 for i in range(len(FEATURES))])
    model = Model(mean, np.maximum(scale, 1e-6))
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
    learnt = learning.join(known, F.col("doc_id") == F.col("_id")).withColumn("_fold", fold())
    sizes = {r["_fold"]: r["count"] for r in learnt.groupBy("_fold").count().collect()}
    if not sizes:
        return model
    # Where all labels are in the calibration fold they train, and nothing calibrates.
    held_size = sizes.get(CALIBRATION_FOLD, 0)
    apart = sum(sizes.values()) > held_size
    training = learnt.filter(F.col("_fold") != CALIBRATION_FOLD) if apart else learnt
    sums = training.select("_y", *FEATURES).mapInArrow(_normal_equations(model), "at long, value double")
    values = np.zeros(0)
    rows = sums.groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")
    values = rows.column("value").to_numpy()
    size = RANDOM_FEATURES + 1
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = values[:-size]
    gram = gram + np.triu(gram, 1).T
    penalty = np.diag(np.append(np.full(size - 1, RIDGE * max(gram[-1, -1], 1)), 1e-9))
    model.weights = np.linalg.solve(gram + penalty, values[-size:])

    if not (apart and held_size):
        return model

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.rint(model.raw(_stats(b, 1)) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column(0)], names=["bin", "y"])

    held = learnt.filter(F.col("_fold") == CALIBRATION_FOLD)
    bins = held.select("_y", *FEATURES).mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    pooled = isotonic(np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    model.steps = np.interp(np.arange(BINS + 1), [r["bin"] for r in bins], pooled)
    return model


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more) for every document.

    A null text is empty and scored by the same model. Without any label the
    score is 0.5. Equal texts get equal scores; repeated rows give one row each
    and weigh as often in the fit; a row without an id counts as held out; an
    empty table gives no rows; extra columns are ignored.
    """
    stats = written(document_statistics(documents), "statistics")
    model = fit(stats, labels)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for b in batches:
            score = own.score(_stats(b, 2)) if own.weights is not None else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = stats.select("doc_id", (fold() == 2).alias("held_out"), *FEATURES).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
