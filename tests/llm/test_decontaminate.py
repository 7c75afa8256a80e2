import random
from itertools import combinations

import pytest

from chronoframe.llm.decontaminate import MASKS, Index, _ids, decontaminate, find_overlaps, overlaps, words_of


def vocab(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def brute(docs, items, least=0.8):
    """Aligned word equality at every shift, without indexes (no insertions)."""
    out = set()
    for d, t in docs:
        w = words_of((t or "").encode())
        for i, s in items:
            x = words_of((s or "").encode())
            if not x:
                continue
            best = max((sum(0 <= s0 + k < len(w) and w[s0 + k] == x[k] for k in range(len(x))) for s0 in range(-len(x), len(w) + 1)), default=0)
            if best >= least * len(x) - 1e-9:
                out.add((d, i))
    return out


def planted(rng, v):
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(15, 50)))) for k in range(25)]
    docs = []
    for d in range(120):
        w = [rng.choice(v) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            x = rng.choice(items)[1].split()
            for p in rng.sample(range(len(x)), int(rng.choice([0, 0.1, 0.15, 0.3]) * len(x))):
                x[p] = "zzsub"
            at = rng.randint(0, len(w))
            w[at:at] = [y.upper() + rng.choice(["", ",", "."]) for y in x]
        docs.append((d, " ".join(w)))
    return docs, items


def test_against_brute_force(spark):
    rng = random.Random(8)
    docs, items = planted(rng, vocab(rng))
    items += [(90, None), (91, ""), (92, "few words"), (93, items[0][1]), (94, "lone"), (95, " ... ")]
    docs += [(None, None), (500, ""), (501, items[3][1]), (501, items[3][1]), (502, "pad " * 30000 + items[4][1]), (503, "a FEW, words here"), (504, "few other words"), (505, "a lone word")]
    want = brute(docs, items)
    assert any(i == 93 for _, i in want) and {(503, 92), (505, 94)} <= want
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(tuple, find_overlaps(df, bench, most_items=most).collect())) for most in (30_000, 7)]
    assert rows[0] == rows[1]
    got = find_overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len([r for r in got if (r["doc_id"], r["item_id"]) == (501, 3)]) == 2
    kept = sorted(str(r["doc_id"]) for r in decontaminate(df, bench).collect())
    assert kept == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want})
    joined = decontaminate(df, bench, most_items=7)
    assert joined.columns == df.columns and sorted(str(r["doc_id"]) for r in joined.collect()) == kept
    with pytest.raises(ValueError):
        decontaminate(df, bench, overlap=0.5)


def test_every_placement_of_allowed_substitutions_is_found():
    for n in range(1, 21):
        x = [f"w{k}" for k in range(n)]
        index = Index.of([("item", " ".join(x))])
        most = n - -(-4 * n // 5)
        for gone in combinations(range(n), most):
            y = ["other" if k in gone else w for k, w in enumerate(x)]
            ids = _ids([w.encode() for w in y])
            assert 0 in index.alignments(ids)[2], (n, gone)
            if n < 12:
                assert overlaps(" ".join(["pre", *y, "post"]).encode(), index)[0][2] == n - most
        assert not overlaps(" ".join(x[: n - most - 1] + ["other"] * (most + 1)).encode(), index)


def test_every_fifth_word_substituted_and_words_put_in():
    rng = random.Random(9)
    v = vocab(rng)
    x = [rng.choice(v) for _ in range(40)]
    index = Index.of([("item", " ".join(x))])
    y = [w if k % 5 else "other" for k, w in enumerate(x)]
    assert overlaps(" ".join(["pre"] * 9 + y).encode(), index)[0][1:] == (0.8, 32, 40, 9)
    assert overlaps(" ".join(x[:20] + ["put", "in"] + x[20:]).encode(), index)[0][1] == 1.0
    assert not overlaps(" ".join(x[:30]).encode(), index)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert find_overlaps(docs, bench).count() == 0 and find_overlaps(some, bench).count() == 0
    assert decontaminate(some, bench).count() == 1
    assert len(MASKS) == len(set(MASKS))


def test_one_repeated_word_stays_small():
    index = Index.of([(1, "w " * 50), (2, "w " * 20 + "x y z v u t s")])
    assert [m[0] for m in overlaps(b"w " * 60_000, index)] == [1]
