import random

import numpy as np
from pyspark.sql import functions as F

from chronoframe.llm import toxicity
from chronoframe.llm.toxicity import GRADES, drop_toxic, fit_ordinal, grade

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    got = grade(docs, labels.where(~test))
    assert got.count() == docs.count()
    rows = got.join(labels.where(test).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    bad = [r for r in rows if r["truth"] == 1]
    good = [r for r in rows if r["truth"] == 0]
    assert np.mean([r["toxic"] for r in bad]) > 0.85 and np.mean([r["toxic"] for r in good]) < 0.015  # a tenth of the toxic labels show nothing in the text
    assert np.mean([r["severity"] for r in bad]) > 1 > np.mean([r["severity"] for r in good])
    assert all(0 <= r["severity"] <= GRADES - 1 and r["toxic"] == (r["grade"] > 0) for r in rows)


def test_gradient_of_the_ordinal_likelihood():
    rng = np.random.default_rng(2)
    n = 400
    x = rng.random((n, 3)) < 0.4
    score = x @ [1.0, 2.0, 3.0] + rng.logistic(size=n)
    y = (score[:, None] > [1.5, 3.0, 4.5]).sum(axis=1)
    row, feat = np.nonzero(x)
    w, b = fit_ordinal(row, feat, y, 3, steps=1500, l2=0.0)
    assert np.all(np.diff(b) < 0) and np.all(np.diff(w) > 0)

    def loss(w, b):
        s = 1 / (1 + np.exp(-(x @ w)[:, None] - b))
        p = np.hstack([np.ones((n, 1)), s]) - np.hstack([s, np.zeros((n, 1))])
        return -np.log(p[np.arange(n), y]).mean()

    best = loss(w, b)
    for k in range(3):
        for step in (-0.05, 0.05):
            d = np.eye(3)[k] * step
            assert loss(w + d, b) > best - 1e-5 and loss(w, b + d) > best - 1e-5


def test_edges(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["fine", "good", "day", "sun"]) for _ in range(15)) + (" rotten" * (1 + k % 3) if k % 4 == 0 else "")) for k in range(200)]
    labels = [(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None), (7, 3)]
    rows += [(None, "Rotten! day"), (900, None), (901, ""), (902, "sun " * 60000), (903, "r"), (904, "ROTTEN"), (904, "ROTTEN")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, label int, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = grade(df, lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["toxic"] for r in got}
    assert by[900] == by[901] == by[902] == by[903] == 0 and by[904] == by[None] == 1
    assert all(by[k] == (k % 4 == 0) for k in range(200))
    kept = drop_toxic(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r["toxic"] == 0 for r in got)
    assert {r["toxic"] for r in grade(df, lab.where("toxic = 0")).collect()} == {0}
    assert {r["toxic"] for r in grade(df, lab.where("false")).collect()} == {0}
    assert grade(df.where("false"), lab).count() == 0
    assert toxicity._words(np.zeros(0, np.uint8), np.array([0, 0]))[0].size == 0


def test_features_against_a_plain_count():
    rng = random.Random(6)
    texts = ["", "x", " ", "trash", "Trash, trash! TRASHY"] + [" ".join(rng.choice(["ab", "abcd", "abcdefgh", "é1", "a-b"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    row, feat = toxicity._levels(*toxicity._words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw])))
    want = set()
    for k, t in enumerate(raw):
        words = t.translate(toxicity.WORDS.tobytes()).split()
        for p, size in enumerate(toxicity.PREFIXES):
            seen = [w[:size].ljust(size) for w in words]
            for x in set(seen):
                for lv, least in enumerate(toxicity.LEVELS):
                    if seen.count(x) >= least:
                        want.add((k, (int.from_bytes(x, "big") * 2 + p) * 3 + lv))
    assert len(row) == len(want) and set(zip(row.tolist(), feat.tolist())) == want
