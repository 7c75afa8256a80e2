"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of a text are standardised and mapped to cosine features that approximate a Gaussian
kernel. Partitions sum their share of the normal equations, so a fit is one pass however many rows
are labelled; the driver solves one small system. Raw scores are then calibrated to probabilities by
a monotone fit over a fixed grid of score bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_buffer
from .sums import part_batch, tree_sum

FEATURES = 160
BINS = 400
RIDGE = 1e-3
SEED = 20
THRESHOLD = 0.3

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_GROUPS = [list(range(97, 123)), list(range(65, 91)), list(range(48, 58)), [32], [10], [9, 11, 12, 13], list(range(128, 256)), [c for c in range(32) if not 9 <= c <= 13] + [127], _PUNCT]
_CLASS = np.zeros((256, len(_GROUPS) + len(_PUNCT)))
for _k, _g in enumerate(_GROUPS):
    _CLASS[_g, _k] = 1
_CLASS[_PUNCT, np.arange(len(_GROUPS), _CLASS.shape[1])] = 1
N_STATS = _CLASS.shape[1] + 11


def statistics(text: bytes) -> np.ndarray:
    """Statistics of one text; an empty one has zeros throughout."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist @ _CLASS / n
    words = text.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split(b"\n")
    p = hist[hist > 0] / n
    out[: len(share)] = np.sqrt(share)
    out[len(share) :] = [
        np.log1p(n),
        np.log1p(len(words)),
        size.mean(),
        size.std(),
        np.log1p(size.max()),
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        -(p * np.log2(p)).sum(),
    ]
    return out


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] = ()) -> DataFrame:
    """``doc_id, stats`` (and columns to carry) for each row; null text reads as empty."""
    docs = df.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]) + ", stats array<float>"

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(b.num_columns - 1))
            raw = body.tobytes()
            at = offs.tolist()
            x = np.array([statistics(raw[i:j]) for i, j in zip(at, at[1:])], np.float32).reshape(b.num_rows, N_STATS)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], names=[*b.schema.names[:-1], "stats"])

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    edges: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, FEATURES))
        return np.hstack([z, x / np.sqrt(N_STATS), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.level), 0, 1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


def _fold(rows: DataFrame, size: int, share) -> np.ndarray:
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += share(_stats_of(b), b.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
        yield part_batch(total)

    return tree_sum(rows.select("stats", "label").mapInArrow(run, "part binary"), size)


def monotone(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit by pooling adjacent violators; weightless bins follow their neighbours."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(weight > 0):
        blocks.append([weight[k], value[k], 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, n = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [u[0] + w, (u[0] * u[1] + w * v) / (u[0] + w), u[2] + n]
    fit = np.repeat([b[1] for b in blocks], [b[2] for b in blocks])
    return np.interp(np.arange(len(weight)), np.flatnonzero(weight > 0), fit)


def train(rows: DataFrame) -> Model | None:
    """``rows(stats, label)`` with labels 0 and 1 -> model; None without rows."""
    moments = _fold(rows, 2 * N_STATS + 1, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    n = moments[-1]
    if n == 0:
        return None
    mean = moments[:N_STATS] / n
    scale = np.sqrt(np.maximum(moments[N_STATS:-1] / n - mean**2, 0))
    scale[scale < 1e-6] = 1.0
    model = Model(mean, scale, np.zeros(0), np.zeros(2), np.zeros(2))
    d = FEATURES + N_STATS + 1

    def equations(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y])

    sums = _fold(rows, d * d + d, equations)
    ridge = RIDGE * n * np.eye(d) / FEATURES
    model.weight = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge, sums[d * d :])
    edges = np.linspace(-0.5, 1.5, BINS)

    def bins(x, y):
        k = np.clip(np.round((model.raw(x) - edges[0]) / (edges[1] - edges[0])), 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, minlength=BINS)])

    hist = _fold(rows, 2 * BINS, bins)
    weight, ones = hist[:BINS], hist[BINS:]
    model.edges, model.level = edges, monotone(weight, ones / np.maximum(weight, 1))
    return model


def score(df: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``df``.

    Labels other than 0 and 1, null ids and labels of held-out ids are not learnt from; an id that is
    labelled or present more than once counts each time. Without any label all scores are 0.5.
    """
    scratch = Scratch(df.sparkSession, "quality")
    rows = scratch.table(document_statistics(df, id_col, text_col, [held_out.alias("held_out")]))
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label in (0, 1)")
    model = train(scratch.table(rows.where("not held_out").join(known, "doc_id").select("stats", "label")))

    def run(batches):
        for b in batches:
            s = model.score(_stats_of(b)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
