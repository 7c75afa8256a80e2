import hashlib
import random
import time
from pathlib import Path

import numpy as np

from chronoframe.llm import repeats
from chronoframe.llm.common import Scratch
from chronoframe.llm.repeats import SPAN, anchors, dedup, maximal_repeats, merged


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - SPAN + 1):
            s = b[p : p + SPAN]
            if i is not None:
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - SPAN + 1):
            if i is not None and least[b[p : p + SPAN]] < i:
                cut[p : p + SPAN] = b"\x01" * SPAN
        runs = bytes(cut).split(b"\x00")
        out.append((i, len(b), sum(cut), sum(1 for r in runs if r), hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "and", "a", "in", "to"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(5, 30)) for _ in range(6)] + ["a" * 130, "ab" * 45, "x" * 49, "y" * 50, "z" * 51]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 25)) for _ in range(rng.randint(0, 6))]
        t = rng.choice(["", " ", "\n"]).join(parts)
        if rows and rng.random() < 0.25:
            t = rng.choice(rows)[1] or ""
            if t and rng.random() < 0.7:
                p = rng.randrange(len(t))
                t = t[:p] + rng.choice(["", "Q", "\x00", "QQQ"]) + t[p + rng.randint(0, 3) :]
        rows.append((k, t))
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, th int, runs string").repartition(3)
    got = sorted((tuple(r) for r in dedup(df).collect()), key=str)
    assert got == brute(rows)


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_small_buckets_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 50)
    monkeypatch.setattr(repeats, "FEW", 0)
    monkeypatch.setattr(repeats, "SORTED", 5)
    monkeypatch.setattr(repeats, "AT_ONCE", 100)
    check(spark, corpus(9, 60))


def test_crowded_anchors(spark, monkeypatch):
    rng = random.Random(12)
    line = "a common line that is fifty bytes long or somewhat more."
    tail = lambda: "".join(rng.choice("xy ") for _ in range(rng.randint(0, 40)))
    rows = [(k, tail() + line[rng.randint(0, 2) :] + tail()) for k in range(150)] + corpus(3, 40)[:0]
    for crowd in (0, 3, 100):
        monkeypatch.setattr(repeats, "CROWD", crowd)
        check(spark, rows)
    monkeypatch.setattr(repeats, "CROWD", 0)
    check(spark, corpus(13, 80))


def test_hot_keys_and_groups_of_buckets(spark, monkeypatch):
    from chronoframe.llm import common

    rng = random.Random(14)
    line = "a licence line that stands amid quite different words, as they do."
    tail = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60)))
    rows = [(k, tail() + line + tail()) for k in range(120)] + [(k + 200, t) for k, t in corpus(15, 60)]
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    monkeypatch.setattr(repeats, "HOT", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text as sample")
    assert len(repeats.hot_keys(df))
    check(spark, rows)
    monkeypatch.setattr(repeats, "BUCKET", 20)
    monkeypatch.setattr(common, "FAN", 3)
    monkeypatch.setattr(common, "GATHERED", 2000)
    check(spark, rows)


def test_contexts_of_one_core_are_told_apart():
    rng = np.random.default_rng(3)
    core = np.frombuffer(b"the same sixty bytes stand in the midst of every text of them", np.uint8)
    n = 300_000
    side = rng.integers(97, 123, (n, 2, 30), np.uint8)
    body = np.concatenate([side[:, 0], np.broadcast_to(core, (n, len(core))), side[:, 1]], axis=1)
    width = body.shape[1]
    words: dict[int, set] = {}
    for i in range(0, n, 4000):
        a = anchors(body[i : i + 4000].reshape(-1), np.arange(len(body[i : i + 4000]) + 1) * width)
        for k, c, f in zip(a["key"].tolist(), a["context"].tolist(), a["far"].tolist()):
            words.setdefault(k, set()).add((c, f))
    most = max(len(x) for x in words.values())
    assert most == len(np.unique(side.reshape(n, -1), axis=0))


def test_edges(spark):
    long = "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do " * 2000
    rows = [(None, "n" * 60), (5, "n" * 60), (1, None), (2, ""), (3, "short"), (7, long), (8, long[:-1]), (9, "q" * 200), (9, "q" * 200), (9, "r" * 70), (10, "r" * 70), (0, "tail " + "q" * 49), (12, "\x00" * 80), (13, "\x00" * 80)]
    check(spark, rows)
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_has_its_anchor():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \x00") for _ in range(n)).encode() for n in (0, 10, 49, 50, 51, 84, 300)] + [b"a" * 120]
    offs = np.cumsum([0] + [len(t) for t in texts])
    a = anchors(np.frombuffer(b"".join(texts), np.uint8), offs)
    for k, t in enumerate(texts):
        at = a["pos"][a["row"] == k]
        for p in range(len(t) - SPAN + 1):
            assert ((at >= p) & (at + repeats.GRAM <= p + SPAN)).any()
        assert len(t) >= SPAN or not len(at)


def test_maximal_repeats_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(2, 6)
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 20))) for _ in range(n)]
        frag = np.zeros((n, repeats.WIDTH), np.uint8)
        for k, t in enumerate(texts):
            frag[k, : len(t)] = list(t.encode())
        got = {(frag[f[0], s[0] : s[0] + m].tobytes().decode(), tuple(sorted(zip(f.tolist(), s.tolist())))) for m, f, s in maximal_repeats(frag, np.array([len(t) for t in texts]), np.zeros(n, np.uint64), least=3)}
        want = set()
        for w in {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 3, len(t) + 1)}:
            occ = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(w, i)]
            if len(occ) > 1:
                left = [texts[k][i - 1] if i else (k, i) for k, i in occ]
                right = [texts[k][i + len(w)] if i + len(w) < len(texts[k]) else (k, i) for k, i in occ]
                if len(set(left)) > 1 and len(set(right)) > 1:
                    want.add((w, tuple(sorted(occ))))
        assert got == want


def test_merged_runs():
    a = lambda *x: np.array(x, np.int64)
    got = merged(a(1, 1, 1, 2, 1), a(0, 0, 0, 0, 9), a(5, 0, 20, 3, 1), a(9, 5, 22, 4, 2))
    assert [x.tolist() for x in got] == [[1, 1, 1, 2], [0, 0, 9, 0], [0, 20, 1, 3], [9, 22, 2, 4]]


def test_anchors_of_large_tables_are_held_once(spark, monkeypatch):
    text_bytes = 10_200_000_000  # of a table of 6 GB
    assert repeats.fan(-(-text_bytes // (repeats.BUCKET * 18))) == 1
    ids = np.array([0, -1, 7, 1 << 40, -(1 << 62)], np.int64)
    assert repeats._whole(*repeats._cut(ids)).tolist() == ids.tolist()
    rows = [(1, "p" * 60), (2, "q" * 60), (2, "p" * 60), (-(1 << 40), "q" * 55), (1 << 40, "p" * 70), (None, "p" * 80), (4, "r" * 60), (4, "r" * 60)]
    for few in (0, 1_000_000):
        monkeypatch.setattr(repeats, "FEW", few)
        check(spark, rows)
    texts = repeats.removed_runs(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {r["doc_id"] for r in texts if r["th"]} == {2}


def test_crowded_anchors_are_dealt_by_their_near_halves(spark):
    rng = random.Random(16)
    line = "one gram in all of the texts"
    side = lambda: "".join(rng.choice("xy") for _ in range(60))
    rows = [(k, side() + line + side()) for k in range(300)]
    texts = [t.encode() for _, t in rows]
    offs = np.cumsum([0] + [len(t) for t in texts])
    a = anchors(np.frombuffer(b"".join(texts), np.uint8), offs)
    blob = repeats.pack(repeats._six(a["key"]), a["context"], a["far"], *repeats._cut(a["row"].astype(np.int64)), np.zeros(len(a["row"]), np.int64), a["pos"].astype(np.uint16), np.zeros(len(a["row"]), np.uint16), a["left"].astype(np.uint8), a["right"].astype(np.uint8))
    one = repeats.pa.table({"kind": repeats.pa.array([repeats.ANCHORS], repeats.pa.int32()), "part": repeats.pa.array([0], repeats.pa.int32()), "blob": [blob]})
    for crowd, ways in ((0, {1, 2, 3}), (100, {0, 4, 8, 12})):
        out = repeats._settle(1, crowd)(one)
        asks = [b.as_py() for k, b in zip(out.column("kind"), out.column("blob")) if k.as_py() == repeats.ASKS]
        assert set(repeats.unpack(asks, repeats._ASK)[4].tolist()) <= ways
    check(spark, rows)


def test_shuffle_files_go_with_each_table(spark, monkeypatch):
    """No table leaves its shuffle files, whether or not the driver collects its garbage."""
    monkeypatch.setattr(repeats, "free_shuffles", lambda spark: None)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left, table = [], Scratch.table

    def files():
        every = disk.getAllFiles()
        return {every.apply(k).getName() for k in range(every.size())}

    def watched(self, df):
        before = files()
        out = table(self, df)
        for _ in range(50):
            if not (more := {x for x in files() - before if x.startswith("shuffle_")}):
                break
            time.sleep(0.1)
        left.append(more)
        return out

    monkeypatch.setattr(Scratch, "table", watched)
    same = "".join(chr(97 + i * i % 23) for i in range(90))
    rows = [(i, f"{i} begins " + same + f" ends {i}") for i in range(40)]
    docs, _, runs = repeats.removed_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert runs.count() == 39 and len(left) >= 4 and not any(left)


def test_heaps_are_collected_between_steps(spark, monkeypatch):
    """Executors (here the driver's JVM) collect what a step left before the workers of the next begin."""
    monkeypatch.setattr(repeats, "free_shuffles", lambda spark: None)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "Mark" in b.getName())
    before = whole()
    repeats.removed_runs(spark.createDataFrame([(1, "a" * 60), (2, "a" * 60)], "doc_id long, text string"))
    assert whole() - before >= 3


def test_files_follow_the_data_not_the_partitions(spark, monkeypatch, tmp_path):
    """Each local file costs forks of the JVM, so 40 partitions of little data become a few files, and none is a marker."""
    rows = [(i, f"{i} begins " + "same words " * 9 + f" ends {i}") for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    files, markers = [], []

    def table(self, df, table=Scratch.table):
        out = table(self, df)
        where = Path(self._paths[id(out)].removeprefix("file://"))
        files.append(len(list(where.glob("part-*"))))
        markers.extend(where.glob("*_SUCCESS*"))
        return out

    monkeypatch.setattr(Scratch, "table", table)
    try:
        out = dedup(spark.read.parquet(str(tmp_path / "in")).repartition(40))
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(files) >= 5 and max(files) <= 2 * spark.sparkContext.defaultParallelism and not markers


def test_the_result_is_a_written_table(spark, monkeypatch):
    """Whoever writes the result does so on heaps that were collected after the last join."""
    seen = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: seen.append("table") or table(self, df))
    monkeypatch.setattr(repeats, "give_back", lambda spark: seen.append("collected"))
    rows = [(i, f"{i} begins " + "same words " * 9 + f" ends {i}") for i in range(40)]
    out = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert seen[-2:] == ["table", "collected"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)
