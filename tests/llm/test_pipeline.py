import corpus_pipeline
from chronoframe.llm import decontaminate, near, pieces, secrets, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near import groups

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns
    bad = {r["doc_id"] for r in toxicity.grade(docs, labels).where("toxic = 1").collect()}
    rows = clean.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()} - bad

    unique = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    assert unique.columns == columns
    kept = {i for i, c in groups([(r["doc_id"], r["text"]) for r in rows]) if i == c}
    rows = unique.collect()
    assert {r["doc_id"] for r in rows} == kept and len(rows) == len(kept)

    pure = corpus_pipeline.drop_contaminated(spark, unique, SF)
    assert pure.columns == columns
    leaked = {d for d, _ in contaminated([(r["doc_id"], r["text"]) for r in rows if any(i[1][:40] in r["text"] for i in items)], items)}
    assert leaked and {r["doc_id"] for r in pure.collect()} == kept - leaked

    cut = corpus_pipeline.redact_secrets(spark, pure, SF)
    assert cut.columns == columns and cut.count() == pure.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert secrets.scan(cut).where("n_live > 0").count() == 0 < secrets.scan(pure).where("n_live > 0").count()

    out = corpus_pipeline.encode_pieces(spark, cut, SF)
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode_table(out).collect()}
    assert back == {r["doc_id"]: r["text"] for r in cut.collect()}
    assert out.count() == cut.count() and out.where("not exact").count() == 0
    want = sorted(map(str, out.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == want


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d", None, "s", 7), (1, "a b c d", None, "s", 7), (2, "a b c d", "en", None, 7), (None, "a b c d", "en", "s", 7), (4, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "None"]
    other = [(9, "p q r s", None, "s", 7), (9, "t u v w", None, "s", 7), (3, "t u v w", None, "s", 7), (8, "p q r s", None, "s", 7), (9, "only here", None, "s", 9)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(other, docs.schema), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(3, "t u v w"), (8, "p q r s"), (9, "only here")]
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == 5
    assert corpus_pipeline.redact_secrets(spark, docs, SF).count() == 5
    assert corpus_pipeline.encode_pieces(spark, docs, SF).count() == 5
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
    assert near.LEAST == (4, 5) and near.SHINGLE == 5 and decontaminate.OVERLAP == 0.8


def test_stages_begin_on_collected_heaps(spark):
    """What an earlier stage left in the executors' JVM (here the driver's) is collected before the next one's
    tasks."""
    jvm = spark.sparkContext._jvm
    beans = jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "Mark" in b.getName())
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, docs, SF)
        assert whole() > before, name
