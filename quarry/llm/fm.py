"""Quality classifier: a factorisation machine over hashed words, structure and size of whole texts.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions in time linear in the features. Words share WORD_BUCKETS hashed features (log-scaled
counts of unit length); structure statistics (shares of capitals, digits, symbols, bars, exclamation
marks, spaces, non-ASCII bytes; distinct and most frequent words; line and word lengths) and size
metadata are one feature per bin each. Neither labels nor lang, source or doc_id enter a score.

The machine is fitted on the driver on the SAMPLE labelled rows (at most) of smallest hash among those
not held out, of which only features are collected; scoring covers every row without a shuffle.

Null text counts as empty and is scored by its structure. Rows with a null label are not used; repeated
labels of an id count once, the smallest. With no labels, or labels of one kind, the score is their
smoothed share. Repeated rows are scored alike; other columns are ignored (score) or kept (keep).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_rows, schema_of

WORD_BUCKETS = 1 << 14
FACTORS = 8
#: Most labelled rows that a machine is fitted on.
SAMPLE = 10_000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 256, 0.02, 1e-4, 7
THRESHOLD = 0.3
#: One row in FOLDS is held out: crc32 of the id as text, modulo FOLDS, is 0.
FOLDS = 5

#: Bins of each structure statistic.
SHARE = np.array([0.002, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])
SIZE = np.array([1, 2, 4, 8, 12, 16, 24, 32, 50, 100, 200, 500, 2000, 10000])
LENGTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40])
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>@^~=+_\\/{}[]", "bar": b"|", "exclaim": b"!?", "stop": b".,;:", "high": range(128, 256), "space": b" \t\r\x0b\x0c", "line": b"\n",
}
_LUT = np.zeros((len(_CLASSES), 256), dtype=np.int64)
for _k, _members in enumerate(_CLASSES.values()):
    _LUT[_k, list(_members)] = 1
STATISTICS = [*((n, SHARE) for n in _CLASSES), ("distinct", SHARE), ("commonest", SHARE), ("words", SIZE), ("lines", SIZE), ("bytes", SIZE * 8), ("word_length", LENGTH), ("line_words", SIZE)]
_OFFSETS = WORD_BUCKETS + np.cumsum([0] + [len(b) + 1 for _, b in STATISTICS])
FEATURES = int(_OFFSETS[-1])


@dataclass
class Sparse:
    """Rows of features: starts (rows + 1), indices and values."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self, which: np.ndarray) -> Sparse:
        parts = [slice(self.starts[r], self.starts[r + 1]) for r in which]
        sizes = [p.stop - p.start for p in parts]
        return Sparse(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([self.indices[p] for p in parts]), np.concatenate([self.values[p] for p in parts]))


def _block(data: np.ndarray, ends: np.ndarray) -> Sparse:
    """Features of texts that lie end to end."""
    n = len(ends)
    words, until = shingles.word_hashes(data, ends)
    counts = np.diff(until, prepend=0)
    row = np.repeat(np.arange(n), counts)
    keys, times = np.unique(row * WORD_BUCKETS + (words >> np.uint64(20)).astype(np.int64) % WORD_BUCKETS, return_counts=True)
    row, index, value = keys // WORD_BUCKETS, keys % WORD_BUCKETS, np.log1p(times)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row]
    per_row = np.bincount(row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, times)

    size = np.diff(ends, prepend=0)
    begin = ends - size
    kinds = np.zeros((len(_LUT), n))
    full = np.flatnonzero(size)
    if len(full):
        for k, lut in enumerate(_LUT):
            kinds[k, full] = np.add.reduceat(lut[data], begin[full])
    lines = kinds[-1] + 1
    safe = np.maximum(counts, 1)
    letters = size - kinds[-1] - kinds[-2]
    stats = [*(x / np.maximum(size, 1) for x in kinds), per_row / safe, most / safe, counts, lines, size, letters / safe, counts / lines]
    extra = np.stack([_OFFSETS[k] + np.searchsorted(bins, x, side="right") for k, ((_, bins), x) in enumerate(zip(STATISTICS, stats, strict=True))], axis=1)
    width = extra.shape[1]
    starts = np.concatenate([[0], np.cumsum(per_row + width)])
    indices, values = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32)
    at = np.arange(len(row)) + row * width
    indices[at], values[at] = index, value
    tail = (starts[1:, None] - width + np.arange(width)).ravel()
    indices[tail], values[tail] = extra.ravel(), 0.5
    return Sparse(starts, indices, values)


def features(column: pa.Array):
    """Sparse rows of the texts of an Arrow column, a block at a time."""
    for data, ends in shingles.text_blocks(column):
        yield _block(data, ends)


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def raw(self, x: Sparse) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        begin = x.starts[:-1]
        linear = np.add.reduceat(self.w[x.indices] * x.values, begin)
        vx = self.v[x.indices] * x.values[:, None]
        total = np.add.reduceat(vx, begin)
        squares = np.add.reduceat((vx * vx).sum(axis=1), begin)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))


def fit(x: Sparse, y: np.ndarray) -> Machine:
    """Adam on the logistic loss; the same rows in the same order give the same machine."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    rng = np.random.default_rng(SEED)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32))
    if not 0 < y.sum() < len(y):
        return m
    m.v = rng.normal(0, 0.03, (FEATURES, FACTORS)).astype(np.float32)
    weights = [np.zeros(1, np.float32) + np.float32(m.bias), m.w, m.v]
    first, second, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            which = order[at : at + BATCH]
            b = x.rows(which)
            m.bias = float(weights[0][0])
            error = (m.score(b) - y[which]) / len(which)
            e = np.repeat(error, np.diff(b.starts)) * b.values
            vx = m.v[b.indices] * b.values[:, None]
            total = np.repeat(np.add.reduceat(vx, b.starts[:-1]), np.diff(b.starts), axis=0)
            gv = e[:, None] * (total - vx)
            grads = [np.array([error.sum()]), np.bincount(b.indices, e, FEATURES) + DECAY * m.w, np.stack([np.bincount(b.indices, gv[:, f], FEATURES) for f in range(FACTORS)], axis=1) + DECAY * m.v]
            step += 1
            for p, g, a, s in zip(weights, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                p -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    m.bias = float(weights[0][0])
    return m


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` labelled rows that are not held out, those of smallest hash."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg((F.min(label) > 0).cast("int").alias("_y"))
    chosen = known.withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(sample)
    rows = df.select(key, text).join(F.broadcast(chosen), key)
    # of the rows of one key that with the smallest hash, so no more rows than the sample come back
    rows = rows.groupBy("_h", "_y").agg(F.min(F.struct(F.xxhash64(text).alias("_t"), F.col(text).alias("_text")))["_text"].alias(text))

    def run(batches):
        for batch in batches:
            made = [(x.indices[a:b].tolist(), x.values[a:b].tolist()) for x in features(batch.column(text)) for a, b in zip(x.starts[:-1], x.starts[1:], strict=True)]
            yield arrow_rows(batch, ["_h", "_y"], {"i": ([i for i, _ in made], pa.list_(pa.int32())), "x": ([v for _, v in made], pa.list_(pa.float32()))})

    found = rows.select("_h", "_y", text).mapInArrow(run, "_h bigint, _y int, i array<int>, x array<float>").toArrow()
    order = np.lexsort((found.column("_y").to_numpy(), np.array([len(i) for i in found.column("i").to_pylist()], dtype=np.int64), found.column("_h").to_numpy())) if len(found) else []
    lists = [(found.column("i")[int(r)].values.to_numpy(), found.column("x")[int(r)].values.to_numpy()) for r in order]
    if not lists:
        return fit(Sparse(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)), np.zeros(0))
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in lists])])
    return fit(Sparse(starts, np.concatenate([i for i, _ in lists]), np.concatenate([v for _, v in lists])), found.column("_y").to_numpy()[order].astype(float))


def score(df: DataFrame, machine: Machine, keys: list[str], text: str = "text") -> DataFrame:
    """The columns `keys` of df, score (double) and predicted (int)."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            parts = [shared.value.score(x) for x in features(batch.column(text))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield arrow_rows(batch, keys, {"score": (s, pa.float64()), "predicted": ((s >= THRESHOLD).astype(np.int32), pa.int32())})

    # the text comes last under a name of its own, whatever the keys are called
    return df.select(*[F.col(k) for k in keys if k != text], F.col(text)).mapInArrow(run, schema_of(df, keys, "score double, predicted int"))


def classify(df: DataFrame, documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for every row of df."""
    scored = score(df, train(documents, labels, key, text), [key], text)
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", "predicted")


def keep(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of df that are predicted good, with the columns of df."""
    held = df.select(F.col(text).alias("_text"), F.struct("*").alias("_row"))
    return score(held, machine, ["_row"], "_text").filter(F.col("predicted") == 1).select("_row.*")
