import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoframe.llm.pieces import MODEL, Vocabulary, decode, decode_table, digest, encode, encode_table, vocabulary

S = "▁"


def toy():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], S, S + S, "a", "b", "ab", "ba", "aba", S + "a", S + "ab", "é", "bé"]
    rng = random.Random(1)
    return Vocabulary(pieces, [-rng.random() * 5 for _ in pieces], list(range(1, 257)), {0})


def paths(text, v):
    """Every segmentation of the whole normalised text."""
    t = " " + text if text else ""
    out = []

    def go(i, ids, score):
        if i == len(t):
            out.append((score, ids))
            return
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in v.ids:
                k = v.ids[t[i:j]]
                go(j, (*ids, k), score + v.scores[k])
        if t[i] not in v.ids:
            raw = t[i].encode()
            go(i + 1, (*ids, *[v.bytes_at[b] for b in raw]), score + v.byte_score * len(raw))

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_n_best_against_all_segmentations():
    rng, v = random.Random(2), toy()
    for _ in range(150):
        text = "".join(rng.choice("aabb é\nx") for _ in range(rng.randint(0, 9)))
        want = paths(text, v)
        for n in (1, 4, 7):
            got = encode(text, v, n)
            assert len(got) == min(n, len(want))
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:n]], abs=1e-7)
            assert len({tuple(p) for _, p in got}) == len(got)
            every = {p: s for s, p in want}
            assert all(every[tuple(p)] == pytest.approx(s, abs=1e-7) and decode(p, v) == text for s, p in got)


def test_the_public_vocabulary():
    v = vocabulary(MODEL)
    for text in ["", " ", "  two  blanks ", "Hello  wörld\nfoo 😀 a\tb\x00", "the " * 50 + "\n\n", S]:
        got = encode(text, v)
        assert all(decode(p, v) == text for _, p in got)
        assert got[0][0] == pytest.approx(math.fsum(v.scores[k] if k not in v.bytes_at else v.byte_score for k in got[0][1]), abs=1e-6)
    assert [v.pieces[k] for k in encode("the", v, 1)[0][1]] == [S + "the"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    v = vocabulary(MODEL)
    assert all(decode(p, v) == text for _, p in encode(text, v))


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(["<unk>", *["?"] * 256, "a" + S], [0.0] * 258, list(range(1, 257)), {0})


def test_tables(spark):
    rows = [(None, "x y"), (1, None), (2, ""), (3, "wörd " * 30000), (4, "same"), (4, "same"), (5, "\n \n")]
    df = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "doc_id long, text string, score double, gap int")
    got = digest(df).collect()
    assert len(got) == len(rows) and all(r["exact"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_pieces"] == by[2]["n_pieces"] == 0 and by[1]["n_found"] == 1 and by[1]["gap"] is None
    back = {str((r["doc_id"], r["n_pieces"])): r["decoded"] for r in decode_table(digest(df)).collect()}
    assert all(back[str((r["doc_id"], r["n_pieces"]))] == (t or "") for r, (_, t) in zip(got, rows))
    assert all(len(r["ids"]) == r["n_pieces"] and r["scores"][0] == r["score"] and len(r["scores"]) == r["n_found"] for r in got)
    assert by[3]["n_pieces"] >= 30000 and by[4]["gap"] > 0
    full = encode_table(df.drop("gap")).selectExpr("doc_id", "text", "segmentations[0].ids as ids")
    back = decode_table(full).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert digest(df.where("false")).count() == 0


def test_batches_are_cut_small(monkeypatch):
    import pyarrow as pa

    from chronoframe.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["x" * 30, None, "y" * 500, "z"])], names=["key", "text"])
    monkeypatch.setattr(common, "AT_ONCE", 40)
    cut = list(common.small([batch], -1))
    assert [b.num_rows for b in cut] == [2, 1, 1] and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_kept_searches(monkeypatch):
    from chronoframe.llm import pieces

    kept = pieces._Chunks(len)
    kept.limit = 3
    assert [kept[c] for c in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1]
    assert set(kept) == {"dddd", "a"} and set(kept.older) == {"a", "bb", "ccc"}
    kept.forget()
    assert not kept and not kept.older and kept["x" * 99] == 99 and not kept
    monkeypatch.setattr(pieces, "SEARCHED", 2)
    v = toy()
    for text in ("aba", "abab", "baba"):
        assert v.others(text, 4) == v.others(text, 4) == v.n_best(text, 4)
    assert len(v.searched) == 1
    monkeypatch.setattr(pieces, "SEARCHED", 100)
    calls = []
    monkeypatch.setattr(v, "n_best", lambda *x, f=v.n_best: calls.append(x) or f(*x))
    first = encode("abab aba", v)
    tried = len(calls)
    assert tried and encode("abab aba", v) == first and len(calls) == tried  # equal chunks are searched once


def test_the_two_best_scores_of_chunks():
    rng, v = random.Random(5), toy()
    for _ in range(200):
        chunk = "".join(rng.choice("aabb é") for _ in range(rng.randint(1, 9)))
        score, ids, gap = v.viterbi(chunk)
        found = v.n_best(chunk, 2)
        assert found[0][0] == pytest.approx(score, abs=1e-7)
        assert gap == (math.inf if len(found) == 1 else pytest.approx(score - found[1][0], abs=1e-7))
