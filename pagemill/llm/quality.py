"""Quality rules: hashed n-gram logistic regression, calibrated, behind base rules."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, scramble, shingle_hashes, table

#: Bound of the labelled sample that the model is fitted on.
TRAIN_ROWS = 3_000
#: Hash buckets of each n-gram family: words, and runs of 3 and of 5 bytes.
BUCKETS = 1 << 15
CHAR_SIZES = (3, 5)
STEPS = 80
#: Kept from this calibrated probability of good quality on: to lose a clean document costs more than to keep a poor one.
KEEP_FROM = 0.25
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # per cent of words

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


class Batch:
    """The words and bytes of a batch of texts, as arrays over all of them."""

    def __init__(self, texts: list[str | None]):
        self.raw = [(t or "").encode() for t in texts]
        split = [b.split() for b in self.raw]
        self.n_words = np.array([len(w) for w in split], np.int64)
        known: dict[bytes, int] = {}
        number = known.setdefault
        self.words = np.fromiter((number(w, len(known)) for words in split for w in words), np.int64, int(self.n_words.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.word_bucket = np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % BUCKETS
        self.word_chars = np.array([len(t or "") - (len(b) - len(b.translate(None, _SPACE))) for t, b in zip(texts, self.raw, strict=True)])

    def symbols(self) -> list[int]:
        return [len(b) - len(b.translate(None, _SYMBOLS)) for b in self.raw]

    def duplicate_lines(self) -> list[int]:
        lines = ([x for x in b.split(b"\n") if x.strip()] for b in self.raw)
        return [len(own) - len(set(own)) for own in lines]

    def repeated_words(self) -> np.ndarray:
        """By text: words in 8-word windows that the text has twice or more."""
        count = len(self.raw)
        if len(self.words) < WINDOW + 1:
            return np.zeros(count, np.int64)
        last = len(self.words) - WINDOW + 1
        inside = np.flatnonzero(self.doc[:last] == self.doc[WINDOW - 1 :])
        key = shingle_hashes(scramble(self.words.astype(np.uint64)), WINDOW)[inside]
        key = scramble(key + self.doc[inside].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key, at = key[order], inside[order]
        same = key[1:] == key[:-1]
        # Equal hashes are looked at word by word; in the odd case that they mislead, windows are compared themselves.
        a, b = at[1:][same], at[:-1][same]
        wrong = self.doc[a] != self.doc[b]
        for k in range(WINDOW):
            wrong |= self.words[a + k] != self.words[b + k]
        if wrong.any():
            windows = np.lib.stride_tricks.sliding_window_view(self.words, WINDOW)[inside]
            _, back, n = np.unique(np.column_stack([self.doc[inside], windows]), axis=0, return_inverse=True, return_counts=True)
            hit = inside[n[back.ravel()] > 1]
        else:
            hit = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        return np.bincount(self.doc[np.cumsum(edge[:-1]) > 0], minlength=count)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each run of ``size`` bytes, and by text how many there are."""
        lengths = np.array([len(b) for b in self.raw])
        data = np.frombuffer(b"".join(self.raw), np.uint8)
        if len(data) < size:
            return np.zeros(0, np.int64), np.zeros(len(self.raw), np.int64)
        last = len(data) - size + 1
        h = np.zeros(last, np.uint32)
        for k in range(size):
            h = h * np.uint32(0x01000193) + data[k : k + last]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        bucket = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        inside = np.ones(last, bool)
        ends = np.cumsum(lengths)
        for k in range(1, size):  # runs across the end of a text
            at = ends - k
            at = at[(at >= 0) & (at < last) & (lengths > 0)]
            inside[at] = False
        if (lengths[lengths > 0] < size).any():
            owner = np.repeat(np.arange(len(lengths)), lengths)
            inside &= owner[:last] == owner[size - 1 :]
        return bucket[inside], np.maximum(lengths - size + 1, 0)

    def families(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words, then each run size: buckets in order of the texts, and by text how many."""
        yield self.word_bucket[self.words], self.n_words
        for size in CHAR_SIZES:
            yield self.grams(size)

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """By text: the sum over families of the mean weight."""
        z = np.zeros(len(self.raw))
        for k, (bucket, n) in enumerate(self.families()):
            sums = np.concatenate([[0.0], np.cumsum(weights[k * BUCKETS : (k + 1) * BUCKETS][bucket], dtype=np.float64)])
            ends = np.cumsum(n)
            z += (sums[ends] - sums[ends - n]) / np.maximum(n, 1)
        return z


def _features(batch: pa.RecordBatch) -> dict:
    """Sparse rows: the mean count of every bucket of every family."""
    own = Batch(batch.column(1).to_pylist())
    parts: list[list] = [[] for _ in own.raw]
    for k, (bucket, n) in enumerate(own.families()):
        ends = np.cumsum(n)
        for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
            found, count = np.unique(bucket[a:b], return_counts=True)
            parts[i].append((found + k * BUCKETS, count / max(1, b - a)))
    return {
        "quality": batch.column(0),
        "at": [np.concatenate([p[0] for p in x]).astype(np.int32) for x in parts],
        "value": [np.concatenate([p[1] for p in x]).astype(np.float32) for x in parts],
    }


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated probability.

    Newton steps on the log loss against smoothed targets, (n + 1) / (n + 2) of n good ones and
    1 / (m + 2) of m bad ones, so that classes that don't overlap get finite values, too; a step is halved
    until the loss falls.
    """
    good = y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    centre, scale = z.mean(), max(z.std(), 1e-9)
    x = np.column_stack([(z - centre) / scale, np.ones_like(z)])
    loss = lambda ab: np.logaddexp(0, x @ ab).sum() - t @ (x @ ab)
    ab = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ ab)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(ab[0] / scale), float(ab[1] - ab[0] * centre / scale)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights by Adam on four fifths of the sample (classes weighed alike), calibration on the rest."""
    rows = rows.sort_values("order").reset_index(drop=True)
    y = rows["quality"].to_numpy(float)
    n = np.array([len(a) for a in rows["at"]])
    at, value = np.concatenate(rows["at"].to_list()).astype(np.int64), np.concatenate(rows["value"].to_list())
    row = np.repeat(np.arange(len(rows)), n)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[~held])) < 2:
        held[:] = False
    size = (1 + len(CHAR_SIZES)) * BUCKETS
    share = y[~held].mean()
    pull = np.where(held, 0, np.where(y == 1, 0.5 / share, 0.5 / (1 - share))) / (~held).sum()
    w, bias, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    z = np.zeros(len(rows))
    for k in range(1, STEPS + 1):
        slope = (_sigmoid(z) - y) * pull
        g = np.append(np.bincount(at, value * slope[row], size) + 1e-7 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, bias = w - 2.0 * step[:-1], bias - 0.05 * step[-1]
        z = np.bincount(row, value * w[at], len(rows)) + bias
    own = held if held.any() and len(set(y[held])) == 2 else ~held
    a, b = _platt(z[own], y[own])
    return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "bias": [bias], "slope": [a], "shift": [b]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """A model from at most ``rows`` labelled rows (those of the smallest hashes); None unless both
    classes occur. A document labelled more than once has its lowest label.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    features = map_batches(texts.select("quality", "text", F.xxhash64("doc_id", "text").alias("order")), _with_order, "quality int, at array<int>, value array<float>, order bigint")
    once = features.orderBy("order").limit(rows)  # repeated documents don't widen the bound
    found = once.groupBy(F.lit(1).alias("all")).applyInPandas(_fit_if_both, "weights binary, bias double, slope double, shift double").collect()
    if not found:
        return None
    r = found[0]
    return {"weights": np.frombuffer(r.weights, "<f4"), "bias": r.bias, "slope": r.slope, "shift": r.shift}


def _with_order(batch: pa.RecordBatch) -> dict:
    return _features(batch) | {"order": batch.column(2)}


def _fit_if_both(rows: pd.DataFrame) -> pd.DataFrame:
    return _fit(rows) if rows["quality"].nunique() == 2 else pd.DataFrame(columns=["weights", "bias", "slope", "shift"])


OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, probability double"
)


def judge(docs: DataFrame, model: dict | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the calibrated ``probability``.

    Words are runs of anything but ASCII white space; null texts have none and fail the base rules,
    as empty ones do. Without a model (labels of one class or none) the probability is 1 and the
    base rules decide. Whole texts are scored. Columns of ``docs`` of these names are replaced.
    """
    names = [x.split()[0] for x in OUT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    place = kept.index("text")

    def score(batch: pa.RecordBatch) -> dict:
        own = Batch(batch.column(place).to_pylist())
        p = np.ones(len(own.raw))
        if model:
            p = _sigmoid(model["slope"] * (own.linear(model["weights"]) + model["bias"]) + model["shift"])
        repeated = own.repeated_words()
        failed = (own.n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * own.n_words)
        return {c: batch.column(i) for i, c in enumerate(kept)} | {
            "n_words": own.n_words,
            "word_chars": own.word_chars,
            "n_symbols": own.symbols(),
            "n_dup_lines": own.duplicate_lines(),
            "n_repeat_words": repeated,
            "base_failed": failed,
            "kept": ~failed & (p >= keep_from),
            "probability": p,
        }

    return map_batches(docs.select(*kept), score, f"{schema}, {OUT}")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
