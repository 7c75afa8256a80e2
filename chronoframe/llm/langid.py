"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes (A-Z folded to a-z, digits to 0, rare bytes to one
symbol). A symbol is coded in the longest context that has been seen; where that context has not seen
the symbol, an escape is coded and the next shorter context is asked, without the symbols that the
longer one already excluded (method C). The trees are frozen after training, so the code length of a
symbol depends only on itself and the ``ORDER`` symbols before it: every tree unrolls into one table,
and a text's exact code length is a sum of look-ups. The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, spans, text_buffer

ORDER = 3
#: Symbols: 0 pads before a text, 1 stands for all rare bytes, the rest are the most frequent bytes.
SYMBOLS = 48
#: Training texts for each language; a classifier's bounded sample, chosen by a hash of the id.
SAMPLE = 1000
#: Code lengths are kept in 1/1024 bit.
SCALE = 1024

_FOLD = LOWER.copy()
_FOLD[48:58] = 48


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    grams: list[np.ndarray]  # of each language: distinct (ORDER+1)-grams
    counts: list[np.ndarray]
    rare: float  # bits that tell one rare byte from another

    def table(self) -> np.ndarray:
        """Code lengths by gram and language; built once in a worker process."""
        key = (tuple(self.langs), *[(len(g), int(g.sum()), int(c.sum())) for g, c in zip(self.grams, self.counts)])
        if key not in _tables:
            _tables.clear()
            _tables[key] = np.stack([_costs(g, c, self.rare) for g, c in zip(self.grams, self.counts)], axis=1)
        return _tables[key]


_tables: dict[tuple, np.ndarray] = {}


def _costs(grams: np.ndarray, counts: np.ndarray, rare: float) -> np.ndarray:
    """Bits x SCALE of every (ORDER+1)-gram's last symbol after the symbols before it."""
    full = np.zeros(SYMBOLS ** (ORDER + 1), np.float32)
    full[grams] = counts
    prob = np.full(SYMBOLS, 1 / (SYMBOLS - 1), np.float32)  # order -1: any symbol but the pad
    prob[0] = 0
    for order in range(ORDER + 1):
        # marginal counts of the (order+1)-grams that end each window
        n = full.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0) if order < ORDER else full.reshape(-1, SYMBOLS)
        lower = np.tile(prob.reshape(-1, SYMBOLS), (SYMBOLS, 1)) if order else np.tile(prob, (1, 1))
        seen = n > 0
        total, kinds = n.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        left = np.where(seen, 0, lower).sum(axis=1, keepdims=True)
        escape = np.where(left > 0, kinds, 0)
        prob = np.where(seen, n / np.maximum(total + escape, 1), np.where(total > 0, escape / np.maximum(total + escape, 1), 1) * lower / np.maximum(left, 1e-30)).astype(np.float32)
    prob = prob.reshape(-1)
    bits = -np.log2(np.maximum(prob, 2.0**-60))
    bits.reshape(-1, SYMBOLS)[:, 1] += rare
    return np.minimum(np.round(bits * SCALE), 65535).astype(np.uint16)


def _grams(body: np.ndarray, offs: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte; contexts do not reach over the start of a text."""
    sym = symbol[body].astype(np.int32)
    out = sym.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(sym)
        before[k:] = sym[:-k] if k else sym
        for j in range(k):
            at = offs[:-1] + j
            at = at[at < offs[1:]]
            before[at] = 0
        out += before * np.int32(SYMBOLS**k)
    return out


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def code_lengths(body: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Bits of every text under every language, [texts, languages]."""
    table = model.table()
    out = np.zeros((len(offs) - 1, len(model.langs)), np.float64)
    for i, j in spans(offs, 1 << 20):
        at = offs[i : j + 1] - offs[i]
        grams = _grams(body[offs[i] : offs[j]], at, model.symbol)
        some = np.flatnonzero(at[1:] > at[:-1])
        if len(some):
            out[i + some] = np.add.reduceat(table.take(grams, axis=0), at[some], axis=0, dtype=np.int64)
    return out / SCALE


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``labelled(id, text, lang)`` -> frozen model, from about ``sample`` texts of each language.

    The share to keep of a language follows from its count, the rows from a hash of id and text.
    Null texts and languages are left out; without any row the model knows no language.
    """
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(256, np.uint8), [], [], 0.0)
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("ppm")), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col("lang"))
    rows = rows.where(unit < share).select("lang", F.col("text").cast("string").alias("text"))

    def bytes_of(batches):
        for b in batches:
            n = np.bincount(_FOLD[text_buffer(b.column(1))[0]], minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], names=["byte", "n"])

    hist = np.zeros(256)
    for r in rows.mapInArrow(bytes_of, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        hist[r["byte"]] = r["n"]
    symbol = np.ones(256, np.uint8)
    top = [b for b in np.argsort(-hist, kind="stable")[: SYMBOLS - 2].tolist() if hist[b] > 0]
    symbol[top] = np.arange(2, 2 + len(top))
    symbol = symbol[_FOLD]
    rare = float(np.log2(max(1, len(set(_FOLD.tolist())) - len(top))))

    def grams_of(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            grams = _grams(body, offs, symbol)
            which = b.column(0).dictionary_encode()
            code = which.indices.to_numpy(zero_copy_only=False)
            both = np.repeat(code.astype(np.int64), np.diff(offs)) * SYMBOLS ** (ORDER + 1) + grams
            key, n = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays([which.dictionary.take(pa.array(key // SYMBOLS ** (ORDER + 1))), pa.array(key % SYMBOLS ** (ORDER + 1)), pa.array(n)], names=["lang", "gram", "n"])

    found = rows.mapInArrow(grams_of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    parts = [found[found["lang"] == k] for k in langs]
    return Model(langs, symbol, [p["gram"].to_numpy(np.int64) for p in parts], [p["n"].to_numpy(np.float32) for p in parts], rare)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``df``, then the named columns of ``carry``, which no
    prediction sees.

    score is the winner's share of 2**-bits (ties go to the first language by name). Texts that are
    null or have no letter are ``und`` with score 0, as is every text of a model without languages.
    """

    def run(batches):
        for b in batches:
            body, offs = text_buffer(b.column(1))
            n = b.num_rows
            ascii_letter = np.zeros(len(body) + 1, np.int64)
            np.cumsum((_FOLD[body] >= 97) & (_FOLD[body] <= 122), out=ascii_letter[1:])
            letter = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
            for k in np.flatnonzero(~letter).tolist():
                letter[k] = offs[k + 1] > offs[k] and _has_letter(body[offs[k] : offs[k + 1]].tobytes())
            lang, score = np.full(n, "und", object), np.zeros(n)
            if model.langs and n:
                bits = code_lengths(body, offs, model)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                lang[letter] = np.array(model.langs, object)[best[letter]]
                score[letter] = share[letter]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), *b.columns[2:]], names=names)

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carry)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *docs.schema.fields[2:]])
    names = schema.names
    return docs.mapInArrow(run, schema)


def identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Train on the rows that ``held_out`` leaves and predict every row:
    ``doc_id, held_out, lang_pred, score``. ``held_out`` is an expression over ``df``; where it is null, the
    row is not learned from."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    model = train(rows.where(~F.col("held_out")), sample)
    out = predict(df, model, id_col, text_col, (held_out.cast("boolean").alias("held_out"),))
    return out.select("doc_id", "held_out", "lang_pred", "score")
