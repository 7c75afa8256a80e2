import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import langid
from chronoframe.llm.langid import ORDER, SYMBOLS, code_lengths, identify, predict, train
from chronoframe.llm.queries import op4_langid

SF = "/root/testdata/sf0.01"


def prob(s, past, order, trees):
    """The recursive definition with full exclusion."""
    if order < 0:
        return 1 / (SYMBOLS - 1) if s else 0.0
    seen = trees.get(tuple(past[ORDER - order :]), {})
    lower = lambda x: prob(x, past, order - 1, trees)
    if not seen:
        return lower(s)
    left = sum(lower(x) for x in range(SYMBOLS) if x not in seen)
    esc = len(seen) if left > 0 else 0
    total = sum(seen.values()) + esc
    return seen[s] / total if s in seen else esc / total * lower(s) / left


def test_code_lengths_match_the_recursive_definition(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ab cD1é") for _ in range(rng.randint(0, 30))), "xy"[k % 2]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = train(df)
    texts = ["", "ab", "Dab c9é", "zzz", "a"]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = code_lengths(body, offs, model)
    for li, lang in enumerate(model.langs):
        trees = {}
        for _, t, g in rows:
            if g == lang:
                past = [0] * ORDER
                for b in t.encode():
                    s = int(model.symbol[b])
                    for o in range(ORDER + 1):
                        c = trees.setdefault(tuple(past[ORDER - o :]), {})
                        c[s] = c.get(s, 0) + 1
                    past = past[1:] + [s]
        for k, t in enumerate(texts):
            past, bits = [0] * ORDER, 0.0
            for b in t.encode():
                s = int(model.symbol[b])
                bits -= math.log2(prob(s, past, ORDER, trees))
                bits += model.rare if s == 1 else 0
                past = past[1:] + [s]
            assert got[k, li] == pytest.approx(bits, abs=0.002 * len(t) + 1e-6)


def test_every_context_is_a_distribution():
    cost = langid._costs(np.array([5, 7, SYMBOLS * 9 + 4]), np.array([3, 1, 2], np.float32), 3.0)
    p = 2.0 ** (-cost.astype(float) / langid.SCALE).reshape(-1, SYMBOLS)
    p[:, 1] *= 8
    assert abs(p.sum(axis=1) - 1).max() < 0.02


def test_held_out_accuracy_on_documents(spark):
    got = op4_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 34 !", "en"), (None, "the dog", None), (7, "é", "fr"), (7, "é", "fr"), (8, "the " * 50000, "en")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in identify(df, F.lit(False)).collect())
    assert len(got) == len(rows)
    by = {i: (p, s) for i, p, s in got}
    assert by["3"] == by["4"] == by["5"] == ("und", 0.0)
    assert by["7"][0] == "fr" and by["8"][0] == "en" and by["None"][0] == "en" and by["2"][0] == "de"
    none = identify(df.where("false"), F.lit(False))
    assert none.count() == 0
    assert {r["lang_pred"] for r in identify(df, F.lit(True)).collect()} == {"und"}
    assert predict(df.where("doc_id = 1"), train(df.selectExpr("doc_id as id", "text", "lang"))).count() == 1


def test_the_fold_is_told_for_any_id_column(spark):
    rows = [("a", "the cat and the dog", "en", 1), ("b", "der hund und die katze", "de", 0), ("b", "die katze", "de", 1), (None, "the dog", "en", None)]
    df = spark.createDataFrame(rows, "name string, text string, lang string, doc_id int")
    got = identify(df, F.col("doc_id") == 1, id_col="name")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted((str(r["doc_id"]), str(r["held_out"])) for r in got.collect()) == [("None", "None"), ("a", "True"), ("b", "False"), ("b", "True")]
    assert {r["lang_pred"] for r in got.collect()} == {"de"}  # the only row to learn from
