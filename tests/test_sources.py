import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoframe.sources import fixture, pit
from chronoframe.sources.catalog import fields_table, resolve_fields
from chronoframe.sources.store import Manifest, Store, append_once, sha256_of, trial_counts
from chronoframe.streaming import daily_counts, start

D = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def field(spark, rows):
    return spark.createDataFrame(rows, "date date, asset_id string, knowledge_date date, value double")


def test_a_late_row_is_seen_from_its_knowledge_date_on(spark):
    f = field(spark, [(D[0], "A", D[30], 1.0)])
    assert pit.snapshot(f, as_of=D[29]).count() == 0 and rows_of(pit.snapshot(f, as_of=D[30])) == [(D[0], "A", 1.0)]
    assert pit.snapshot(f, lag_days=10).count() == 0 and pit.snapshot(f, lag_days=30).count() == 1
    assert pit.snapshot(f, D[1]).count() == 0 and pit.snapshot(f, end=D[0]).count() == 1


def test_restatements_do_not_fan_out(spark):
    f = field(spark, [(D[0], "A", D[0], 1.0), (D[0], "A", D[9], 2.0), (D[1], "A", D[1], 3.0)])
    assert rows_of(pit.snapshot(f)) == [(D[0], "A", 2.0), (D[1], "A", 3.0)]
    assert rows_of(pit.snapshot(f, as_of=D[5])) == [(D[0], "A", 1.0), (D[1], "A", 3.0)]
    seen = [D[0], D[1], D[9]]
    dates = spark.createDataFrame([(d,) for d in seen], "date date")
    want = []
    for d in seen:
        known = [(e, k, v) for e, _, k, v in f.collect() if k <= d]
        want.append((d, "A", max(known)[2]))
    assert rows_of(pit.decision_time(f, dates)) == sorted(want)


def test_monotone_in_as_of(spark):
    f = field(spark, [(D[k], "A", D[k + k % 7], float(k)) for k in range(50)])
    sizes = [pit.snapshot(f, as_of=d).count() for d in D[::7]]
    assert sizes == sorted(sizes)


def test_files_panel_and_pushdown(spark, tmp_path):
    fx = fixture.build(spark, assets=8, start="2020-01-01", end="2020-04-30", delisted=1)
    for n in ("close", "ret_1d", "cds_spread_5y", "sector"):
        pit.write_field(fx.fields[n], str(tmp_path), n)
    load = lambda fields, universe="all", **k: pit.load_panel(spark, str(tmp_path), fields, universe, "2020-01-10", "2020-03-31", fx.catalogue, fx.universes, **k)
    p = load(["close", "sector"])
    assert p.columns == ["date", "asset_id", "close", "sector"] and p.groupBy("date", "asset_id").count().where("count > 1").count() == 0
    assert p.count() == fx.fields["close"].where("date between '2020-01-10' and '2020-03-31'").count()
    names = load(["close"], "cds_names").select("asset_id").distinct().count()
    assert 0 < names < 8
    assert load(["cds_spread_5y"], as_of="2020-02-03").where("cds_spread_5y is not null").agg(F.max("date")).first()[0] == dt.date(2020, 1, 31)
    with pytest.raises(KeyError):
        load(["ghost"])
    with pytest.raises(KeyError):
        load(["close"], "ghost")
    with pytest.raises(Exception, match="exists"):
        pit.write_field(fx.fields["close"], str(tmp_path), "close")
    plan = pit.snapshot(pit.read_field(spark, str(tmp_path), "close"), as_of="2020-02-03")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(knowledge_date), LessThanOrEqual(knowledge_date" in plan
    cover = pit.coverage(p, ["close"], least=8)
    assert cover.where("below").count() > 0 and cover.count() == p.select("date").distinct().count()


def test_nan_reads_as_missing_and_resolution(spark, tmp_path):
    field(spark, [(D[0], "A", D[0], float("nan"))]).write.parquet(f"{tmp_path}/x.parquet")
    assert pit.read_field(spark, str(tmp_path), "x").first()["value"] is None
    fx = fixture.build(spark, assets=4, start="2020-01-01", end="2020-01-31")
    need = spark.createDataFrame([("close",), ("ghost",)], "field string")
    got = {r["field"]: (r["resolved"], r["source"]) for r in resolve_fields(need, fields_table(spark, fx.catalogue)).collect()}
    assert got == {"close": (True, "synthetic"), "ghost": (False, None)}
    assert fixture.calendar_days(spark, "2010-01-04", "2020-12-31").count() == 2869


def test_store(spark, tmp_path):
    store = Store(tmp_path / "s", spark, lock_seconds=0.1)
    st = store.begin("c", "r1", "a")
    st.write_table("t.parquet", spark.range(3))
    st.write_text("n.txt", "hello")
    m = st.complete(trials=4)
    assert {o.path for o in m.outputs} == {"t.parquet", "n.txt"} and store.manifest("c", "r1", "a") == m
    with pytest.raises(FileExistsError):
        store.begin("c", "r1", "a")
    with pytest.raises(FileExistsError):
        st.write_text("n.txt", "again")
    nxt = store.begin("c", "r1", "b")
    assert nxt.read_input("a", "n.txt").read_text() == "hello" and nxt.inputs[0].sha256 == sha256_of(store.root / "c/r1/a/n.txt")
    with pytest.raises(KeyError):
        store.read("c", "r1", "a", "ghost")
    (store.root / "c/r1/a/n.txt").write_text("changed")
    with pytest.raises(ValueError, match="n.txt"):
        store.read("c", "r1", "a", "n.txt")
    nxt.halt("thin")
    store.register(m, 99)  # already there
    assert store.trial_count("c") == 4 and store.trial_count("ghost") == 0 and store.run_ids("c") == ["r1"]
    reg = store.registry()
    assert reg.count() == 2 and trial_counts(reg).first()["trial_count"] == 4
    assert append_once(reg, reg.withColumn("run_id", F.lit("r2")).unionByName(reg), ["claim_id", "run_id", "stage"]).count() == 4
    (store.root / "registry.lock").touch()
    with pytest.raises(TimeoutError):
        store.register(Manifest("z", "c", "r9", "t", "complete"))
    with pytest.raises(ValueError):
        Manifest.from_dict({**json.loads(json.dumps(m.to_dict())), "extra": 1})


def test_stream_equals_batch_for_finished_days(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.select("ts", "user_id").write.parquet(f"{tmp_path}/in")
    q = start(spark.readStream.schema(src.select("ts", "user_id").schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    batch = daily_counts(src)
    last = out.agg(F.max("date")).first()[0]
    assert last is not None and rows_of(out) == rows_of(batch.where(F.col("date") <= F.lit(last)))
