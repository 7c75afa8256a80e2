import random

import corpus_pipeline
from chronoframe.llm.common import Scratch
from chronoframe.llm.near import components

SF = "/root/testdata/sf0.001"


def sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    """(key, smallest key of its component) by comparing all pairs."""
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(own[a] & own[b])
            if own[a] == own[b] or 5 * both >= 4 * (len(own[a]) + len(own[b]) - both) > 0:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(12))  # in many texts that are not alike
    base = [" ".join(word() for _ in range(n)) for n in (5, 8, 9, 60, 60, 150, 400)]
    rows = [(None, "x y z"), (5, None), (3, " "), (9, "x Y z"), (9, "x y\tz"), (7, base[1])]
    for k in range(180):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - k, " ".join(w)))
    return rows + [(2000 + k, " ".join(word() for _ in range(rng.randint(1, 9))) + " " + line) for k in range(60)]


def test_components_against_all_pairs(spark):
    rows = corpus()
    want = groups(rows)
    assert len({c for _, c in want}) < len(rows) - 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for wide in (1000, 32, 2):
        assert sorted((tuple(r) for r in components(df, wide=wide).collect()), key=str) == want


def test_the_stage_drops_edited_copies(spark):
    rng = random.Random(5)
    rows = []
    for k in range(20):
        w = [str(rng.random()) for _ in range(200)]
        rows.append((k, " ".join(w)))
        w[20 + k] = w[120] = "edited"
        rows.append((100 + k, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20))
    assert spark.createDataFrame([], docs.schema).count() == corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), SF).count() == 0


def test_the_stage_tells_rows_apart_by_id_and_text(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(2, text("a")), (2, text("b")), (1, text("b")), (2, text("c")), (2, text("c")), (None, text("d")), (None, text("d")), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in got) == [("1", "b"), ("2", "a"), ("2", "c"), ("None", "d"), ("None", "e")]


def test_the_byte_position_index_links_first_and_the_join_the_rest(spark, monkeypatch):
    from chronoframe.llm import near

    rng = random.Random(6)
    rows = []
    for k in range(12):
        w = [str(rng.random()) for _ in range(1500)]
        rows.append((k, " ".join(w)))
        rows.append((100 + k, " ".join([*w, "end"])))  # nearly the same fingerprint
        w[100::120] = ["edited"] * len(w[100::120])
        rows.append((200 + k, " ".join(w)))  # similar enough, another fingerprint
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = groups(rows)
    assert sum(i == c for i, c in exact) == 12
    assert sorted((tuple(r) for r in components(df).collect()), key=str) == exact
    monkeypatch.setattr(near, "_open", lambda pairs, labels: pairs.where("false"))
    alone = dict(tuple(r) for r in components(df).collect())
    linked = [k for k in range(12) if alone[100 + k] == k]
    assert len(linked) >= 9 and all(alone[200 + k] in (k, 100 + k, 200 + k) for k in range(12))


def test_tasks_work_on_small_runs_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    from chronoframe.llm import near

    monkeypatch.setattr(near, "AT_ONCE", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 30] * 48 + [None, "y" * 500])], names=["key", "text"])
    cut = list(near._small([batch], 1))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert max(b.num_rows for b in cut) <= 4 and cut[-1].column(1)[-1].as_py() == "y" * 500


def test_few_files_for_many_partitions(spark, monkeypatch):
    """Tables follow the data: small ones are not cut into a file for each shuffle partition."""
    rows = [(i, f"w{i % 40} " + " ".join(f"a{i % 40}b{k}" for k in range(12))) for i in range(400)]
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: written.append(table(self, df)) or written[-1])
    monkeypatch.setattr(Scratch, "drop", lambda self, df: None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r["key"]: r["component"] for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: i % 40 for i in range(400)}
        assert max(len(x.inputFiles()) for x in written) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
