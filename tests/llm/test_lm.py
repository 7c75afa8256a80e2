import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import lm
from chronoframe.llm import common
from chronoframe.llm.lm import END, Shape, features, score, tokens
from chronoframe.llm.queries import op6_lm

SF = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split() + [None]


def base(rows, held):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(vocab).upper() if rng.random() < 0.2 else rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for k in range(80)]
    return rows + [(None, "a b"), (200, None), (201, "  "), (202, "lone\tWORD\x0bé"), (203, "big " * 40000), (5, "a b"), (5, "a b")]


@pytest.mark.parametrize("head", [1 << 17, 12, 0])
def test_base_scores_against_brute_force(spark, head):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, turn int, score double").repartition(5)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    col = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    got = sorted((tuple(r)[:6] for r in score(df, col, head_size=head).collect()), key=str)
    want = base(rows, held)
    assert [g[:5] for g in sorted(got, key=lambda g: (str(g[0]), g[2], g[3]))] == [w[:5] for w in sorted(want, key=lambda g: (str(g[0]), g[2], g[3]))]
    assert sorted(g[5] for g in got) == pytest.approx(sorted(w[5] for w in want), rel=1e-9)


def test_the_model_is_a_distribution_and_beats_the_unigrams(spark):
    got = op6_lm(spark, SF)
    rows = got.where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    own, uni, n = (sum(r[c] for r in rows) for c in ("score", "base_score", "n_tokens"))
    assert own / n > uni / n  # log10 probability a token
    # probabilities of all words, seen and unseen, after one history
    key = np.arange(1, 900, dtype=np.int64) * 7919
    count = np.arange(1, 900)[::-1].astype(np.int64)
    shape = Shape(key, count, 100)
    group, slot = shape.of(key)
    rest = slot == shape.rest
    assert rest.any() and (~rest).sum() == shape.groups * shape.rest
    totals = np.bincount(group[rest], count[rest] + 1, minlength=shape.groups) + 1
    shape.prior(np.stack([np.bincount(group[rest], count[rest], minlength=shape.groups), np.bincount(group[rest], minlength=shape.groups)]))
    assert shape.rest_log == pytest.approx(np.log10(totals))
    flat = np.random.default_rng(0).normal(size=shape.size).astype(np.float32)
    history = np.array([[3], [5], [9]], np.uint64)
    total = 0.0
    for g in range(shape.groups):
        p = 1.0
        for table, (rows, bias, given, y), last in zip(shape.split(flat), shape.factors(history, np.array([g]), np.array([0])), (0, 0, 1)):
            one = lm._softmax(table, rows, bias, given)[:, 0]
            p = p * (one if last else one[y[0]])
        own = (group == g) & ~rest
        total += p[slot[own]].sum() + np.delete(p[:-1], slot[own]).sum()
        total += p[shape.rest] * (((count[(group == g) & rest] + 1) / totals[g]).sum() + 1 / totals[g])
    assert total == pytest.approx(1, abs=1e-5)


def test_the_model_grows_with_the_tokens():
    none = np.zeros(0, np.int64)
    sizes = [(lambda s: (s.groups * s.rest, s.rows))(Shape(none, none, n)) for n in (3_400_000, 80_000_000, 5_000_000_000)]
    assert sizes[0][0] > 1500 and sizes[1][0] > 8000 and sizes[2][0] > 65_000
    assert sizes[0][1] < sizes[1][1] < sizes[2][1]


def test_features_stop_at_the_start_of_a_text():
    raw = [b"a b c", b"", b"a b", b"b"]
    tok, at = tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert np.diff(at).tolist() == [4, 1, 3, 2] and (tok[at[1:] - 1] == END).all()
    f = features(tok, at)
    assert (f[:, at[:-1]] == f[:, :1]).all()
    assert (f[:, at[2] + 1] == f[:, at[0] + 1]).all() and (f[0, at[3] + 1] != f[0, at[2] + 1])
    assert f[1, at[3] + 1] == f[1, 0]


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    t = rng.normal(size=(4, 60))
    f, y = rng.integers(0, 50, (3, 30)).astype(np.int32), rng.integers(0, 4, 30)
    start, given = rng.normal(size=(4, 3)), rng.integers(0, 3, 30)
    g = lm._gradient(lm._softmax(t, f, start, given), f, y, 60)
    loss = lambda: -np.log(lm._softmax(t, f, start, given)[y, np.arange(30)]).sum()
    for b, c in ((f[0, 0], 1), (f[1, 3], 2), (f[2, 7], 0), (55, 1)):
        was = loss()
        t[c, b] += 1e-6
        assert (loss() - was) / 1e-6 == pytest.approx(g[c, b], abs=1e-3)
        t[c, b] -= 1e-6


def test_steps_in_place_against_the_plain_ones():
    import tracemalloc

    rng = np.random.default_rng(4)
    table, seen = rng.normal(size=(21, 40_000)).astype(np.float32), np.ones((21, 40_000), np.float32)
    rows, y = rng.integers(0, 300, (3, 60)).astype(np.int32), rng.integers(0, 21, 60)
    bias, given = rng.normal(size=(21, 3)).astype(np.float32), rng.integers(0, 3, 60)
    own, total = table.copy(), seen.copy()
    for _ in range(3):
        g = lm._gradient(lm._softmax(own, rows, bias, given), rows, y, 40_000)
        total += g * g
        own -= lm.STEP * g / np.sqrt(total)
    tracemalloc.start()
    for _ in range(3):
        lm._step(table, seen, rows, bias, given, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (table == own).all() and (seen == total).all() and most < table.nbytes
    # scores by logits are those of the probabilities
    shape = Shape(np.arange(1, 50, dtype=np.int64), np.arange(1, 50), 100)
    flat = rng.normal(size=shape.size).astype(np.float32)
    tok, at = rng.integers(1, 60, 90), np.array([0, 30, 90])
    group, slot = shape.of(tok)
    want = np.zeros(90)
    for t, (r, b, h, k) in zip(shape.split(flat), shape.factors(features(tok, at), group, slot)):
        want += np.log10(lm._softmax(t, r, b, h)[k, np.arange(90)])
    assert lm.log10(flat, shape, tok, at, group, slot) == pytest.approx(want, abs=1e-5)


def test_groups_of_buckets(spark, monkeypatch):
    rows = corpus()[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((tuple(r) for r in score(df, F.lit(False), head_size=12).collect()), key=str)
    monkeypatch.setattr(lm, "TOKENS_TO_BUCKET", 10)
    monkeypatch.setattr(common, "FAN", 3)
    monkeypatch.setattr(common, "GATHERED", 300)
    got = sorted((tuple(r) for r in score(df, F.lit(False), head_size=12).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score(df.where("false"), F.lit(False)).count() == 0
    (r,) = score(df, F.lit(True)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0
