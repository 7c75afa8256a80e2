"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the beginnings of a text's words (so inflected forms share features) with the number of
occurrences they reach. A bounded, hash-chosen sample of labelled rows picks the features that go with
toxic labels and fits one weight for each, shared by all thresholds: P(grade > k) = sigmoid(w.x + b_k) with
b_0 > b_1 > b_2. The labels say toxic or not; a toxic row's grade 1 to 3 is the third of the toxic
rows into which its number of picked features falls. Expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, small, spans, text_buffer, tidy

#: Bytes of a word's beginning that make a feature; the longer one is the whole of a shorter word.
PREFIXES = (4, 6)
#: A feature for so many occurrences in a text, or more.
LEVELS = (1, 3, 8)
#: Labelled rows to learn from at most; a classifier's bounded sample.
SAMPLE = 20_000
#: Features to weigh at most, the least z-score of their log-odds and the toxic rows they need.
PICKED = 8192
Z = 3.0
LEAST = 3
GRADES = 4
#: A text counts as toxic from this probability of grade 1 or more; below one half, since a toxic text
#: that stays costs more than a clean one that goes.
TOXIC_FROM = 0.3

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 21


def _words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of both prefixes of every word; a code is the prefix's bytes, blanks after a word's end."""
    b = WORDS[body]
    first = b != 32
    first[1:] &= b[:-1] == 32
    edge = offs[:-1][offs[:-1] < offs[1:]]
    first[edge] = b[edge] != 32
    at = np.flatnonzero(first)
    row = np.searchsorted(offs, at, "right") - 1
    room, code, alive, out = offs[row + 1], np.zeros(len(at), np.int64), np.ones(len(at), bool), []
    for k in range(max(PREFIXES)):
        byte = np.where(at + k < room, b[np.minimum(at + k, len(b) - 1)], 32)
        alive &= byte != 32
        code = code << 8 | np.where(alive, byte, 32)
        if k + 1 in PREFIXES:
            out.append(code * 2 + (k + 1 == max(PREFIXES)))
    return np.tile(row, len(out)), np.concatenate(out)


def _levels(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature): a code and the number of occurrences it reaches."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(code) != 0)])) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(row)))
    row, code = row[new], code[new]
    rows = [row[n >= least] for least in LEVELS]
    feats = [code[n >= least] * len(LEVELS) + k for k, least in enumerate(LEVELS)]
    return np.concatenate(rows), np.concatenate(feats)


def _sieve(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * _MULT) >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)


class Picked:
    """A sorted set of features behind a one-probe sieve of their codes."""

    def __init__(self, feats: np.ndarray):
        self.feats = np.sort(feats.astype(np.int64))
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[_sieve(self.feats // len(LEVELS))] = True

    def features(self, body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature), in order."""
        out = [np.zeros(0, np.int64)]
        size = max(1, len(self.feats))
        for i, j in spans(offs, 1 << 20):
            row, code = _words(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hit = self.sieve[_sieve(code)]
            row, feat = _levels(row[hit], code[hit])
            f = np.minimum(np.searchsorted(self.feats, feat), size - 1)
            ok = self.feats[f] == feat if len(self.feats) else np.zeros(len(feat), bool)
            out.append(np.sort((row[ok] + i) * size + f[ok]))
        key = np.concatenate(out)
        return key // size, key % size


@dataclass
class Model:
    picked: Picked
    weight: np.ndarray
    bias: np.ndarray  # descending, one for each threshold

    def above(self, body: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(grade > k) of every text, [texts, thresholds]."""
        row, feat = self.picked.features(body, offs)
        z = np.bincount(row, self.weight[feat], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z[:, None] + self.bias, -50, 50)))


def fit_ordinal(row: np.ndarray, feat: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 600, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and descending thresholds by accelerated gradient ascent on the cumulative-link
    likelihood. Steps follow the curvature, so many features of one copied text share one weight."""
    n, k = len(grade), GRADES - 1
    v = np.ones(n_features)
    for _ in range(20):  # largest curvature of the features, by power iteration
        u = np.bincount(feat, np.bincount(row, v[feat], minlength=n)[row], minlength=n_features) / n
        norm = np.linalg.norm(u)
        v = u / max(norm, 1e-12)
    rate = 1 / (0.5 * norm + 0.5 + l2)
    x = np.concatenate([np.zeros(n_features), -1.0 - np.arange(k)])
    last = x.copy()
    for t in range(steps):
        y = x + t / (t + 3) * (x - last)
        w, b = y[:n_features], y[n_features:]
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feat], minlength=n)[:, None] + b, -50, 50)))
        up = np.hstack([np.ones((n, 1)), s])[np.arange(n), grade]
        down = np.hstack([s, np.zeros((n, 1))])[np.arange(n), grade]
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        gb = np.bincount(grade, d_up, minlength=GRADES)[1:] - np.bincount(grade, d_down, minlength=GRADES)[:k]
        gw = np.bincount(feat, (d_up - d_down)[row], minlength=n_features) / n - l2 * w
        last, x = x, y + rate * np.concatenate([gw, gb / n])
        x[n_features:] = np.minimum.accumulate(x[n_features:] + 1e-3 * np.arange(k)) - 1e-3 * np.arange(k)
    return x[:n_features], x[n_features:]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled ids (smallest hashes). Labels other than 0 and 1 and null ids
    are left out. Without a toxic row nothing is picked and every text gets grade 0."""
    known = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    known = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.join(F.broadcast(known), "_id").select("label", "text").repartition(8).persist()

    def count(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            label = b.column(0).to_numpy(zero_copy_only=False)
            keys, ones = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j in spans(offs, 1 << 20):
                row, feat = _levels(*_words(body[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                keys.append(feat)
                ones.append(label[row + i])
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            toxic = np.bincount(back, np.concatenate(ones), minlength=len(key)).astype(np.int64)
            every = np.bincount(back, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(toxic), pa.array(every - toxic)], names=["code", "toxic", "clean"])

    sizes = rows.agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = float(sizes["n1"] or 0), float(sizes["n"] - (sizes["n1"] or 0))
    half = lambda c: F.col(c) + 0.5
    odds = F.log(half("toxic") / (n1 + 0.5 - F.col("toxic"))) - F.log(half("clean") / (n0 + 0.5 - F.col("clean")))
    counts = rows.mapInArrow(tidy(count), "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    scored = counts.where(F.col("toxic") >= LEAST).select("code", (odds / F.sqrt(1 / half("toxic") + 1 / half("clean"))).alias("z")).where(F.col("z") >= Z)
    picked = Picked(np.array([r["code"] for r in scored.orderBy(F.desc("z"), "code").limit(PICKED).collect()], np.int64))
    if not len(picked.feats):
        rows.unpersist()
        return Model(picked, np.zeros(1), np.full(GRADES - 1, -50.0))

    def extract(batches):
        for b in batches:
            row, feat = picked.features(*text_buffer(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), pa.array(feat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["label", "feats"])

    got = rows.mapInArrow(tidy(extract), "label int, feats array<long>").toArrow()
    rows.unpersist()
    label = got["label"].to_numpy()
    size = got["feats"].combine_chunks().value_lengths().to_numpy()
    feat = got["feats"].combine_chunks().flatten().to_numpy()
    cuts = np.quantile(size[label == 1], [1 / 3, 2 / 3])
    grade = np.where(label == 1, 1 + (size[:, None] > cuts).sum(axis=1), 0)
    weight, bias = fit_ordinal(np.repeat(np.arange(len(label)), size), feat, grade, len(picked.feats))
    return Model(picked, weight, bias)


def grade(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` for each row of ``df``.

    severity is the expected grade (0 to 3), p_toxic the probability of 1 or more. grade is 0 below
    ``toxic_from``, else the number of thresholds more likely passed than not, at least 1; toxic tells
    whether it is 1 or more. Null and empty texts have no features.
    """
    model = train(df, labels, id_col, text_col, sample=sample)

    def run(batches):
        for b in batches:
            p = model.above(*text_buffer(b.column(1)))
            level = np.where(p[:, 0] >= toxic_from, np.maximum(1, (p >= 0.5).sum(axis=1)), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(level), pa.array(p[:, 0]), pa.array((level > 0).astype(np.int32))], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic int")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``df`` of grade 0, with all their columns (a narrow filter)."""
    model = train(df, labels, id_col, text_col, sample=sample)
    at = df.columns.index(text_col)

    def run(batches):
        for b in small(batches, at):
            yield b.filter(pa.array(model.above(*text_buffer(b.column(at)))[:, 0] < toxic_from))

    return df.mapInArrow(tidy(run), df.schema)
