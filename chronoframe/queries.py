"""Registered queries over the driver's tables, each with the SQL that defines it.

Signals run through the compiler, weights and backtests through the plans; the SQL is written
independently, from the definitions. Computed values are rounded last, and ``+ 0.0`` turns -0.0 to 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans import backtest, metrics
from .plans.backtest import Scenario
from .plans.compiler import compile_signal
from .plans.gates import GateContext, correlations, factor_regression, gate_values
from .plans.portfolio import construct_weights
from .plans.spec import Assumption, Costs, ParamSpec, Portfolio, Signal, SignalNode, Spec, Threshold, Universe, UniverseFilters
from .sources import pit
from .sources.catalog import DRIVER_COSTS, resolve_fields
from .sources.panels import daily_user, market, table, weekly_supplier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PANEL = """
WITH line AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS BIGINT) AS asset_id,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty FROM lineitem
), week AS (
  SELECT date, asset_id, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(qty) AS BIGINT) AS qty FROM line GROUP BY date, asset_id
), base AS (
  SELECT w.date, w.asset_id, CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) AS close, CAST(qty AS DOUBLE) AS volume,
         n_name AS country, r_name AS region, 'S' || CAST(w.asset_id % 8 AS VARCHAR) AS sector
  FROM week w JOIN supplier ON s_suppkey = w.asset_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
), panel AS (
  SELECT *, close / lag(close, 1) OVER a - 1 AS ret_1d, CASE WHEN count(volume) OVER a20 = 20 THEN avg(volume) OVER a20 END AS adv_20,
         close * 1000.0 * (1 + asset_id % 7) AS mktcap, CAST(date + CAST(10 * (asset_id % 4) AS INTEGER) AS DATE) AS knowledge_date
  FROM base
  WINDOW a AS (PARTITION BY asset_id ORDER BY date), a20 AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
)"""


def _out(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- specs ------------------------------------------------------------------------------------------


def node(id: str, op: str, *inputs: str, **params) -> SignalNode:
    return SignalNode(id=id, op=op, inputs=list(inputs), params=params)


def spec_of(nodes: list[SignalNode], params: dict[str, float] | None = None, sign: int = 1, portfolio: Portfolio | None = None, costs: Costs | None = None, filters: UniverseFilters | None = None) -> Spec:
    return Spec(
        signal=Signal(nodes=nodes, output=nodes[-1].id, sign=sign),
        universe=Universe(base="all", filters=filters or UniverseFilters()),
        portfolio=portfolio or book(),
        costs=costs or FIXED,
        assumptions=[Assumption(id="A1", choice="weekly supplier panel", source_says="none", alternatives=[])],
        params={k: ParamSpec(value=float(v)) for k, v in (params or {}).items()},
    )


def book(**change) -> Portfolio:
    base = {"construction": "long_short_quantile", "quantile": 0.1, "weighting": "equal", "gross_leverage": 1.0, "net_exposure": 0.0, "max_position": 1.0, "rebalance": "weekly", "holding_period": 1, "execution_lag": 1}
    return Portfolio(**{**base, **change})


FIXED = Costs(spread_model="fixed_bps", spread_bps=10.0, impact_model="none", impact_coeff=0.0, borrow_bps_annual=50.0)
BY_ADV = Costs(spread_model="adv_based", impact_model="sqrt", impact_coeff=0.1, borrow_bps_annual=50.0)


#: Prices are in the ten thousands, where sums in another order differ from the tenth digit on.
PRICE_DIGITS = 3


def _signal(name: str, spec: Spec, sql: str, ctes: str = "", digits: int | None = 6) -> None:
    """A query of a spec's signal on the weekly panel; without digits the values are compared bit by bit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_signal(spec, weekly_supplier(spark, sf_dir))
        v = F.col("signal") if digits is None else _out(F.col("signal"), digits)
        return out.select("date", "asset_id", (v + F.lit(0.0)).alias("v"))

    sql = f"({sql})" if digits is None else f"round({sql}, {digits})"
    query(name, f"{PANEL}{ctes} SELECT date, asset_id, {sql} + 0.0 AS v FROM {'x' if ctes else 'panel'}")(run)


def _w(n: int, of: str = "asset_id") -> str:
    return f"(PARTITION BY {of} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_A, _D = "(PARTITION BY asset_id ORDER BY date)", "(PARTITION BY date)"


def _guard(value: str, n: int, count: str) -> str:
    return f"CASE WHEN count({count}) OVER {_w(n)} = {n} THEN {value} END"


def _ts(op: str, sql: str, n: float, *inputs: str, key: str = "n", ctes: str = "") -> None:
    digits = None if op in ("lag", "diff", "pct_change", "rolling_max", "rolling_min") else 6 if inputs else PRICE_DIGITS
    _signal(f"ts_{op}", spec_of([node("s", op, *(inputs or ("close",)), **{key: "p"})], {"p": n}), sql, ctes, digits)


_ts("lag", f"lag(close, 4) OVER {_A}", 4)
_ts("diff", f"close - lag(close, 4) OVER {_A}", 4)
_ts("pct_change", f"close / lag(close, 4) OVER {_A} - 1", 4)
_signal("ts_log", spec_of([node("s", "log", "close")]), "ln(close)")
_ts("rolling_mean", _guard(f"avg(close) OVER {_w(8)}", 8, "close"), 8)
_ts("rolling_std", _guard(f"stddev_samp(close) OVER {_w(8)}", 8, "close"), 8)
_ts("rolling_sum", _guard(f"sum(close) OVER {_w(8)}", 8, "close"), 8)
_ts("rolling_max", _guard(f"max(close) OVER {_w(8)}", 8, "close"), 8)
_ts("rolling_min", _guard(f"min(close) OVER {_w(8)}", 8, "close"), 8)
_ts("rolling_zscore", _guard(f"(ret_1d - avg(ret_1d) OVER {_w(8)}) / nullif(stddev_samp(ret_1d) OVER {_w(8)}, 0)", 8, "ret_1d"), 8, "ret_1d")
_ts("rolling_rank", "CASE WHEN len(l) = 8 THEN (len(list_filter(l, lambda e: e < ret_1d)) + (len(list_filter(l, lambda e: e = ret_1d)) + 1) / 2.0) / 8 END", 8, "ret_1d", ctes=f", x AS (SELECT *, list(ret_1d) FILTER (ret_1d IS NOT NULL) OVER {_w(8)} AS l FROM panel)")
_ts("ewm", "v", 4, "ret_1d", key="halflife", ctes=", r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date) AS i FROM panel), x AS (SELECT a.date, a.asset_id, sum(b.ret_1d * pow(0.5, (a.i - b.i) / 4.0)) / sum(CASE WHEN b.ret_1d IS NOT NULL THEN pow(0.5, (a.i - b.i) / 4.0) END) AS v FROM r a JOIN r b ON a.asset_id = b.asset_id AND b.i <= a.i GROUP BY a.date, a.asset_id)")
_ts("rolling_beta", _guard(f"covar_samp(ret_1d, volume) OVER {_w(12)} / nullif(var_samp(CASE WHEN ret_1d IS NOT NULL THEN volume END) OVER {_w(12)}, 0)", 12, "ret_1d"), 12, "ret_1d", "volume")
_ts("rolling_corr", _guard(f"covar_samp(ret_1d, volume) OVER {_w(12)} / nullif(stddev_samp(ret_1d) OVER {_w(12)} * stddev_samp(CASE WHEN ret_1d IS NOT NULL THEN volume END) OVER {_w(12)}, 0)", 12, "ret_1d"), 12, "ret_1d", "volume")
_ts("rolling_vol", _guard(f"stddev_samp(ret_1d) OVER {_w(8)} * sqrt(252)", 8, "ret_1d"), 8, "ret_1d")

_Z = "(ret_1d - avg(ret_1d) OVER (PARTITION BY date)) / nullif(stddev_samp(ret_1d) OVER (PARTITION BY date), 0)"
_signal("cs_rank", spec_of([node("s", "cs_rank", "ret_1d")]), "CASE WHEN ret_1d IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret_1d NULLS LAST) + (count(*) OVER (PARTITION BY date, ret_1d) - 1) / 2.0) / count(ret_1d) OVER (PARTITION BY date) - 0.5 END")
_signal("cs_zscore", spec_of([node("s", "cs_zscore", "ret_1d")]), _Z)
_signal("cs_demean", spec_of([node("s", "cs_demean", "close")]), f"close - avg(close) OVER {_D}", digits=PRICE_DIGITS)
_signal("cs_winsorize", spec_of([node("s", "cs_winsorize", "close", k="k")], {"k": 1.5}), f"least(greatest(close, avg(close) OVER {_D} - 1.5 * stddev_samp(close) OVER {_D}), avg(close) OVER {_D} + 1.5 * stddev_samp(close) OVER {_D})", digits=PRICE_DIGITS)
_signal("cs_neutralize", spec_of([node("s", "cs_neutralize", "close", group="region")]), "close - avg(close) OVER (PARTITION BY date, region)", digits=PRICE_DIGITS)
_signal("cs_scale", spec_of([node("s", "cs_scale", "ret_1d")]), f"CASE WHEN sum(abs(ret_1d)) OVER {_D} = 0 THEN ret_1d * 0 ELSE ret_1d / sum(abs(ret_1d)) OVER {_D} END")

for _op, _sql, _in in (
    ("add", "close + volume", ("close", "volume")),
    ("sub", "close - volume", ("close", "volume")),
    ("mul", "close * volume", ("close", "volume")),
    ("div", "volume / close", ("volume", "close")),
    ("neg", "-close", ("close",)),
    ("abs", "abs(ret_1d)", ("ret_1d",)),
    ("sign", "sign(ret_1d)", ("ret_1d",)),
    ("where", "CASE WHEN coalesce(ret_1d, 0) <> 0 THEN close ELSE volume END", ("ret_1d", "close", "volume")),
):
    _signal(f"ar_{_op}", spec_of([node("s", _op, *_in)]), _sql, digits=None)
_signal("ar_clip", spec_of([node("s", "clip", "ret_1d", lo="lo", hi="hi")], {"lo": -0.05, "hi": 0.05}), "CASE WHEN ret_1d IS NOT NULL THEN least(greatest(ret_1d, -0.05), 0.05) END", digits=None)
_signal("combine", spec_of([node("s", "combine", "close", "volume", weights=["a", "b"])], {"a": 0.6, "b": 0.4}), "close * 0.6 + volume * 0.4", digits=None)

REVERSAL = spec_of([node("n1", "cs_zscore", "ret_1d")], sign=-1)
MOMENTUM = spec_of([node("n1", "pct_change", "close", n="n"), node("n2", "cs_zscore", "n1"), node("n3", "cs_winsorize", "n2", k="k")], {"n": 5, "k": 3}, sign=-1)
VOLUME_MOMENTUM = spec_of([node("n1", "pct_change", "close", n="n"), node("n2", "cs_zscore", "n1"), node("n3", "cs_zscore", "adv_20"), node("n4", "combine", "n2", "n3", weights=["w", "w"])], {"n": 20, "w": 0.5})
_signal("sig_reversal", REVERSAL, f"-1 * {_Z}")
_signal("sig_momentum", MOMENTUM, f"-1 * CASE WHEN z IS NOT NULL THEN least(greatest(z, avg(z) OVER {_D} - 3 * stddev_samp(z) OVER {_D}), avg(z) OVER {_D} + 3 * stddev_samp(z) OVER {_D}) END", f", p AS (SELECT *, close / lag(close, 5) OVER {_A} - 1 AS c FROM panel), x AS (SELECT *, (c - avg(c) OVER {_D}) / nullif(stddev_samp(c) OVER {_D}, 0) AS z FROM p)")
_signal("sig_volume_momentum", VOLUME_MOMENTUM, f"0.5 * (c - avg(c) OVER {_D}) / nullif(stddev_samp(c) OVER {_D}, 0) + 0.5 * (adv_20 - avg(adv_20) OVER {_D}) / nullif(stddev_samp(adv_20) OVER {_D}, 0)", f", x AS (SELECT *, close / lag(close, 20) OVER {_A} - 1 AS c FROM panel)")


# --- point in time ----------------------------------------------------------------------------------


def _field(panel: DataFrame, name: str) -> DataFrame:
    return panel.select("date", "asset_id", "knowledge_date", F.col(name).alias("value")).where("value is not null")


@query("pit_as_of", f"{PANEL} SELECT date, asset_id, close AS value FROM panel WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND knowledge_date <= DATE '1995-06-30'")
def _(spark, sf_dir):
    return pit.snapshot(_field(weekly_supplier(spark, sf_dir), "close"), "1994-01-01", "1995-12-31", "1995-06-30")


@query("pit_enforce_lag", f"{PANEL} SELECT date, asset_id, close AS value FROM panel WHERE knowledge_date <= date + 10")
def _(spark, sf_dir):
    return pit.snapshot(_field(weekly_supplier(spark, sf_dir), "close"), lag_days=10)


@query("pit_latest_revision", f"{PANEL}, r AS (SELECT date, asset_id, knowledge_date, close AS value FROM panel UNION ALL SELECT date, asset_id, knowledge_date + 30, close * 2 FROM panel WHERE asset_id % 3 = 0), k AS (SELECT * FROM r WHERE knowledge_date <= DATE '1996-03-31') SELECT date, asset_id, arg_max(value, knowledge_date) AS value FROM k GROUP BY date, asset_id")
def _(spark, sf_dir):
    first = _field(weekly_supplier(spark, sf_dir), "close")
    again = first.where("asset_id % 3 = 0").select("date", "asset_id", F.date_add("knowledge_date", 30).alias("knowledge_date"), (F.col("value") * 2).alias("value"))
    return pit.snapshot(first.unionByName(again), as_of="1996-03-31")


@query("pit_panel", f"{PANEL} SELECT p.date, p.asset_id, p.close, CASE WHEN p.knowledge_date <= DATE '1997-01-01' THEN p.adv_20 END AS adv_20 FROM panel p")
def _(spark, sf_dir):
    p = weekly_supplier(spark, sf_dir)
    return pit.assemble({"close": pit.snapshot(_field(p, "close")), "adv_20": pit.snapshot(_field(p, "adv_20"), as_of="1997-01-01")}, p)


@query("pit_universe", f"{PANEL} SELECT date, asset_id, close FROM panel WHERE adv_20 IS NOT NULL")
def _(spark, sf_dir):
    p = weekly_supplier(spark, sf_dir)
    return pit.assemble({"close": pit.snapshot(_field(p, "close"))}, pit.snapshot(_field(p, "adv_20")))


@query("pit_decision_time", f"{PANEL}, d AS (SELECT DISTINCT date FROM panel) SELECT d.date, p.asset_id, arg_max(p.close, p.date) AS value FROM d JOIN panel p ON p.knowledge_date <= d.date GROUP BY d.date, p.asset_id")
def _(spark, sf_dir):
    p = weekly_supplier(spark, sf_dir)
    return pit.decision_time(_field(p, "close"), p.select("date").distinct())


@query("coverage", f"{PANEL} SELECT date, count(*) FILTER (adv_20 IS NOT NULL AND ret_1d IS NOT NULL) AS n_names, count(*) FILTER (adv_20 IS NOT NULL AND ret_1d IS NOT NULL) < 30 AS below FROM panel GROUP BY date")
def _(spark, sf_dir):
    return pit.coverage(weekly_supplier(spark, sf_dir), ["adv_20", "ret_1d"])


@query("resolve_fields", "WITH r(field) AS (VALUES ('N_NATIONKEY'), ('CHINA'), ('BRAZIL'), ('ATLANTIS')) SELECT r.field, n_regionkey AS source, n_name IS NOT NULL AS resolved FROM r LEFT JOIN nation ON n_name = r.field")
def _(spark, sf_dir):
    need = spark.createDataFrame([("N_NATIONKEY",), ("CHINA",), ("BRAZIL",), ("ATLANTIS",)], "field string")
    return resolve_fields(need, table(spark, sf_dir, "nation").select(F.col("n_name").alias("field"), F.col("n_regionkey").alias("source")))


@query("daily_user", "SELECT CAST(ts AS DATE) AS date, CAST(user_id AS BIGINT) AS asset_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents, count(*) AS n_events FROM events GROUP BY CAST(ts AS DATE), user_id")
def _(spark, sf_dir):
    return daily_user(spark, sf_dir)


@query("weekly_supplier", f"{PANEL} SELECT date, asset_id, close, volume, country, region, sector, ret_1d, adv_20, mktcap, knowledge_date FROM panel")
def _(spark, sf_dir):
    return weekly_supplier(spark, sf_dir)


# --- portfolios -------------------------------------------------------------------------------------


def _weights_sql(legs: str, size: str, cap: float = 1.0, long: float = 0.5, short: float = 0.5, raw: str | None = None) -> str:
    """CTEs from sig(date, asset_id, signal, ...) to w(date, asset_id, weight, ...): the scaled and capped
    legs, by trying every number of capped names and keeping the first that fits."""
    return f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, asset_id) AS r, count(*) OVER (PARTITION BY date) AS n FROM sig)
, legs AS (SELECT *, {legs} AS side FROM ranked)
, sized AS (SELECT *, {raw or f'side * ({size})'} AS raw FROM legs {'' if raw else 'WHERE side IS NOT NULL'})
, leg AS (SELECT *, sign(raw) AS sg, abs(raw) AS m, CASE WHEN raw > 0 THEN {long} WHEN raw < 0 THEN {short} ELSE 0 END AS t FROM sized)
, o AS (SELECT *, row_number() OVER (PARTITION BY date, sg ORDER BY m DESC, asset_id) AS i, count(*) OVER (PARTITION BY date, sg) AS c, sum(m) OVER (PARTITION BY date, sg) AS s FROM leg)
, tried AS (SELECT a.date, a.sg, a.i - 1 AS j, a.t - (a.i - 1) * {cap} AS l, a.s - coalesce(sum(b.m), 0) AS rest, a.m, a.c FROM o a LEFT JOIN o b ON a.date = b.date AND a.sg = b.sg AND b.i < a.i GROUP BY a.date, a.sg, a.i, a.t, a.s, a.m, a.c)
, fit AS (SELECT date, sg, min(j) AS j FROM tried WHERE CASE WHEN rest <= 0 THEN l / (c - j) ELSE m * l / rest END <= {cap} + 1e-9 GROUP BY date, sg)
, fx AS (SELECT f.date, f.sg, f.j, tr.l, tr.rest FROM fit f JOIN tried tr USING (date, sg, j))
, w AS (SELECT o.*, CASE WHEN o.sg = 0 OR o.t <= 0 THEN 0.0 WHEN fx.j IS NULL OR o.i <= fx.j THEN {cap} * o.sg WHEN fx.rest <= 0 THEN o.sg * fx.l / (o.c - fx.j) ELSE o.sg * o.m * fx.l / fx.rest END AS weight FROM o LEFT JOIN fx USING (date, sg))"""


_K = "greatest(1, CAST(round_even(0.1 * n, 0) AS INTEGER))"
_LS = f"CASE WHEN r <= {_K} THEN 1.0 WHEN r > n - {_K} THEN -1.0 END"
_RANK = "rank() OVER (PARTITION BY date, side ORDER BY signal * side) + (count(*) OVER (PARTITION BY date, side, signal) - 1) / 2.0"
_SIG = ", sig AS (SELECT date, asset_id, ret_1d AS signal, sector, country, volume AS vol, close / 1000.0 AS beta FROM panel WHERE ret_1d IS NOT NULL)"


def _book(name: str, portfolio: Portfolio, sql: str, final: str = "weight", least: int = 1) -> None:
    """A book over all dates with at least so many names."""

    def run(spark, sf_dir):
        p = weekly_supplier(spark, sf_dir).select("date", "asset_id", F.col("ret_1d").alias("signal"), "sector", "country", F.col("volume").alias("vol"), (F.col("close") / 1000.0).alias("beta"))
        if least > 1:
            p = p.withColumn("_c", F.count("signal").over(Window.partitionBy("date"))).where(F.col("_c") >= least).drop("_c")
        return construct_weights(p, portfolio).select("date", "asset_id", _out(F.col("weight"), 9).alias("weight"))

    sig = _SIG.removesuffix(")") + f" QUALIFY count(*) OVER (PARTITION BY date) >= {least})"
    query(name, f"{PANEL}{sig}{sql} SELECT date, asset_id, round({final}, 9) + 0.0 AS weight FROM w")(run)


_book("pf_ls_quantile", book(), _weights_sql(_LS, "1.0"))
_book("pf_long_only", book(construction="long_only_quantile", net_exposure=1.0), _weights_sql(f"CASE WHEN r <= {_K} THEN 1.0 END", "1.0", long=1.0, short=0.0))
_book("pf_top_bottom", book(construction="top_n_bottom_n", n=2), _weights_sql("CASE WHEN r <= 2 THEN 1.0 WHEN r > n - 2 THEN -1.0 END", "1.0"))
_book("pf_threshold", book(construction="threshold", threshold=Threshold(lo=-0.1, hi=0.1)), _weights_sql("CASE WHEN signal > 0.1 THEN 1.0 WHEN signal < -0.1 THEN -1.0 END", "1.0"))
_book("pf_rank_weighted", book(construction="rank_weighted"), _weights_sql("1.0", "1.0", raw="(rank() OVER (PARTITION BY date ORDER BY signal) + (count(*) OVER (PARTITION BY date, signal) - 1) / 2.0) / n - 0.5"))
_book("pf_weight_rank", book(weighting="rank"), _weights_sql(_LS, _RANK))
_book("pf_weight_signal", book(weighting="signal"), _weights_sql(_LS, "abs(signal)"))
_book("pf_vol_scaled", book(weighting="vol_scaled"), _weights_sql(_LS, "1.0 / vol"))
_book("pf_capped", book(weighting="signal", quantile=0.4, max_position=0.3), _weights_sql(_LS.replace("0.1", "0.4"), "abs(signal)", cap=0.3), least=6)
_book("pf_levered", book(gross_leverage=2.0, net_exposure=0.5, max_position=1.25), _weights_sql(_LS, "1.0", cap=1.25, long=1.25, short=0.75))
_book("pf_neutral_sector", book(neutralize=["sector"]), _weights_sql(_LS, "1.0"), "weight - avg(weight) OVER (PARTITION BY date, sector)")
_book("pf_neutral_country", book(neutralize=["country"], quantile=0.2), _weights_sql(_LS.replace("0.1", "0.2"), "1.0"), "weight - avg(weight) OVER (PARTITION BY date, country)")
_book("pf_neutral_beta", book(neutralize=["beta"]), _weights_sql(_LS, "1.0"), "weight - beta * sum(weight * beta) OVER (PARTITION BY date) / sum(beta * beta) OVER (PARTITION BY date)")


# --- backtests --------------------------------------------------------------------------------------

_CAL = ", cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel))"
_REBAL = {"weekly": ", rebal AS (SELECT * FROM cal)", "monthly": ", rebal AS (SELECT min(date) AS date, min(idx) AS idx FROM cal GROUP BY date_trunc('month', date))"}


def _backtest_sql(rebalance: str, holding: int, signal: str = "ret_1d", where: str = "", lag: int = 1) -> str:
    return f"""{PANEL}{_CAL}{_REBAL[rebalance]}
, sig AS (SELECT p.date, asset_id, {signal} AS signal FROM panel p JOIN rebal USING (date) WHERE {signal} IS NOT NULL {where})
{_weights_sql(_LS, '1.0')}
, days AS (SELECT date, idx, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT w.date, rebal.idx FROM w JOIN rebal USING (date)))
, held AS (
  SELECT d.seq AS trade, d.idx + {lag} AS idx, w.asset_id, sum(w.weight) / least(d.seq, {holding}) AS weight
  FROM days d JOIN days c ON c.seq BETWEEN d.seq - {holding - 1} AND d.seq JOIN w ON w.date = c.date
  WHERE d.idx + {lag} <= (SELECT max(idx) FROM cal) GROUP BY d.seq, d.idx, w.asset_id
), moves AS (
  SELECT trade, asset_id, sum(weight) AS dw FROM (SELECT trade, asset_id, weight FROM held UNION ALL SELECT trade + 1, asset_id, -weight FROM held) GROUP BY trade, asset_id HAVING abs(sum(weight)) > 1e-12
), traded AS (
  SELECT t.idx, m.asset_id, m.dw FROM moves m JOIN (SELECT DISTINCT trade, idx FROM held) t USING (trade)
)"""


_RETURNS = """
, priced AS (SELECT idx, asset_id, dw, 5.0 AS bps FROM traded)
, force AS (SELECT c.date, c.idx, max(h.trade) AS trade FROM cal c LEFT JOIN (SELECT DISTINCT trade, idx FROM held) h ON h.idx <= c.idx GROUP BY c.date, c.idx)
, daily AS (
  SELECT f.date, coalesce((SELECT sum(h.weight * p.ret_1d) FROM held h JOIN panel p ON p.asset_id = h.asset_id AND p.date = f.date WHERE h.trade = f.trade), 0) AS gross,
         coalesce((SELECT sum(abs(dw) * bps / 1e4) FROM priced t WHERE t.idx = f.idx), 0) + coalesce((SELECT sum(-weight) FROM held h WHERE h.trade = f.trade AND weight < 0), 0) * (50.0 / 1e4 / 252) AS cost
  FROM force f
)"""

def _plain(**change) -> Spec:
    """The panel's return itself as the signal."""
    return spec_of([node("n1", "clip", "ret_1d", lo="lo", hi="hi")], {"lo": -1e9, "hi": 1e9}, portfolio=book(**change))


def _run(spark, sf_dir, spec: Spec, **options) -> backtest.Result:
    return backtest.run_backtests(spec, weekly_supplier(spark, sf_dir).persist(), costs=DRIVER_COSTS, **options)


_DAYS = "WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events))"


@query("bt_rebalance_weekly", _DAYS + " SELECT min(date) AS date, min(idx) AS idx FROM cal GROUP BY date_trunc('week', date)")
def _(spark, sf_dir):
    cal = backtest.calendar(daily_user(spark, sf_dir))
    return backtest.rebalance_dates(cal, "weekly").select("date", F.col("idx").cast("long").alias("idx"))


@query("bt_rebalance_daily", _DAYS + " SELECT date, idx FROM cal")
def _(spark, sf_dir):
    cal = backtest.calendar(daily_user(spark, sf_dir))
    return backtest.rebalance_dates(cal, "daily").select("date", F.col("idx").cast("long").alias("idx"))


@query("bt_rebalance_monthly", f"{PANEL}{_CAL}{_REBAL['monthly']}, t AS (SELECT r.date, c.date AS trade_date FROM rebal r JOIN cal c ON c.idx = r.idx + 2) SELECT * FROM t")
def _(spark, sf_dir):
    cal = backtest.calendar(weekly_supplier(spark, sf_dir))
    return backtest.advance(cal, backtest.rebalance_dates(cal, "monthly").select("date"), 2)


@query("bt_positions", _backtest_sql("weekly", 1) + " SELECT cal.date, asset_id, round(weight, 9) + 0.0 AS weight FROM held JOIN cal USING (idx)")
def _(spark, sf_dir):
    return _run(spark, sf_dir, _plain()).positions.select("date", "asset_id", _out(F.col("weight"), 9).alias("weight"))


@query("bt_overlap", _backtest_sql("monthly", 3) + " SELECT cal.date, asset_id, round(weight, 9) + 0.0 AS weight FROM held JOIN cal USING (idx)")
def _(spark, sf_dir):
    return _run(spark, sf_dir, _plain(rebalance="monthly", holding_period=3)).positions.select("date", "asset_id", _out(F.col("weight"), 9).alias("weight"))


@query("bt_trades", _backtest_sql("monthly", 2) + " SELECT cal.date, asset_id, round(dw, 9) + 0.0 AS delta_weight, 5.0::DOUBLE AS cost_bps FROM traded JOIN cal USING (idx)")
def _(spark, sf_dir):
    return _run(spark, sf_dir, _plain(rebalance="monthly", holding_period=2)).trades.select("date", "asset_id", _out(F.col("delta_weight"), 9).alias("delta_weight"), "cost_bps")


_BUCKETS = "CASE WHEN region = 'AMERICA' THEN CASE WHEN adv <= 1e6 THEN 12.5 WHEN adv <= 1e7 THEN 6.0 ELSE 2.5 END ELSE CASE WHEN adv <= 1e6 THEN 17.5 WHEN adv <= 1e7 THEN 9.0 ELSE 4.0 END END"


@query(
    "bt_costs_adv",
    _backtest_sql("monthly", 1, where="AND adv_20 IS NOT NULL")
    + f""", known AS (SELECT t.idx, t.asset_id, t.dw, arg_max(p.adv_20, p.date) FILTER (p.adv_20 IS NOT NULL) * arg_max(p.close, p.date) AS adv, arg_max(p.region, p.date) AS region
      FROM traded t JOIN cal c USING (idx) JOIN panel p ON p.asset_id = t.asset_id AND p.date <= c.date GROUP BY t.idx, t.asset_id, t.dw)
    SELECT cal.date, asset_id, round(dw, 9) + 0.0 AS delta_weight, round({_BUCKETS} + 0.1 * sqrt(abs(dw) * 5e6 / adv) * 1e4, 6) + 0.0 AS cost_bps FROM known JOIN cal USING (idx)""",
)
def _(spark, sf_dir):
    spec = spec_of(_plain().signal.nodes, {"lo": -1e9, "hi": 1e9}, portfolio=book(rebalance="monthly"), costs=BY_ADV)
    return _run(spark, sf_dir, spec).trades.select("date", "asset_id", _out(F.col("delta_weight"), 9).alias("delta_weight"), _out(F.col("cost_bps")).alias("cost_bps"))


@query("bt_returns", _backtest_sql("monthly", 3) + _RETURNS + " SELECT date, round(gross, 9) + 0.0 AS gross, round(gross - cost, 9) + 0.0 AS net, round(cost, 9) + 0.0 AS cost FROM daily")
def _(spark, sf_dir):
    r = _run(spark, sf_dir, _plain(rebalance="monthly", holding_period=3)).returns
    return r.select("date", *[_out(F.col(c), 9).alias(c) for c in ("gross", "net", "cost")])


@query("bt_filters", _backtest_sql("weekly", 1, where="AND mktcap >= 2e6 AND close >= 1000 AND sector NOT IN ('S1', 'S5')") + " SELECT cal.date, asset_id, round(weight, 9) + 0.0 AS weight FROM held JOIN cal USING (idx)")
def _(spark, sf_dir):
    spec = spec_of(_plain().signal.nodes, {"lo": -1e9, "hi": 1e9}, portfolio=book(), filters=UniverseFilters(min_mktcap=2e6, min_price=1000.0, exclude_sectors=["S1", "S5"]))
    return _run(spark, sf_dir, spec).positions.select("date", "asset_id", _out(F.col("weight"), 9).alias("weight"))


_SUMMARY = """
, g AS (SELECT date, gross - cost AS net, product(1 + gross - cost) OVER (ORDER BY date) AS growth FROM daily)
, pk AS (SELECT *, max(growth) OVER (ORDER BY date) AS peak FROM g)"""


@query(
    "bt_metrics",
    _backtest_sql("monthly", 1)
    + _RETURNS
    + _SUMMARY
    + " SELECT count(*) AS n, round(arg_max(growth, date) - 1, 6) + 0.0 AS total_return, CASE WHEN arg_max(growth, date) > 0 THEN round(pow(arg_max(growth, date), 252.0 / count(*)) - 1, 6) + 0.0 ELSE 0.0 END AS annualized_return, round(stddev_samp(net) * sqrt(252), 6) + 0.0 AS annualized_vol, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 AS sharpe, round(min(growth / peak - 1), 6) + 0.0 AS max_drawdown FROM pk",
)
def _(spark, sf_dir):
    s = metrics.summary(_run(spark, sf_dir, _plain(rebalance="monthly")).returns)
    return s.select("n", *[_out(F.col(c)).alias(c) for c in ("total_return", "annualized_return", "annualized_vol", "sharpe", "max_drawdown")])


@query("m_turnover", _backtest_sql("monthly", 2) + ", l AS (SELECT max(trade) AS n FROM held) SELECT round(sum(abs(dw)) / any_value(l.n - 1), 6) + 0.0 AS turnover FROM moves, l WHERE trade BETWEEN 2 AND l.n")
def _(spark, sf_dir):
    t = metrics.turnover(_run(spark, sf_dir, _plain(rebalance="monthly", holding_period=2)).positions)
    return t.select(_out(F.col("turnover")).alias("turnover"))


# --- statistics -------------------------------------------------------------------------------------

_BY_REGION = f"{PANEL}, s AS (SELECT region AS claim, date, avg(ret_1d) AS net FROM panel WHERE ret_1d IS NOT NULL GROUP BY region, date)"


def _series(spark, sf_dir) -> DataFrame:
    return weekly_supplier(spark, sf_dir).where("ret_1d is not null").groupBy(F.col("region").alias("claim"), "date").agg(F.avg("ret_1d").alias("net"))


@query("m_drawdown", _BY_REGION + ", g AS (SELECT *, product(1 + net) OVER (PARTITION BY claim ORDER BY date) AS growth FROM s), p AS (SELECT *, max(growth) OVER (PARTITION BY claim ORDER BY date) AS peak FROM g) SELECT claim, round(min(growth / peak - 1), 6) + 0.0 AS max_drawdown, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 AS sharpe FROM p GROUP BY claim")
def _(spark, sf_dir):
    return metrics.summary(_series(spark, sf_dir), ("claim",)).select("claim", *[_out(F.col(c)).alias(c) for c in ("max_drawdown", "sharpe")])


@query("m_moments", _BY_REGION + " SELECT claim, count(net) AS n, round(avg(net), 9) + 0.0 AS mean, round(stddev_samp(net), 9) + 0.0 AS std, round(skewness(net), 6) + 0.0 AS skew, round(kurtosis(net), 6) + 0.0 AS kurt FROM s GROUP BY claim")
def _(spark, sf_dir):
    m = metrics.moments(_series(spark, sf_dir), ("claim",))
    return m.select("claim", "n", _out(F.col("mean"), 9).alias("mean"), _out(F.col("std"), 9).alias("std"), _out(F.col("skew")).alias("skew"), _out(F.col("kurt")).alias("kurt"))


@query("g_newey_west", _BY_REGION + ", e AS (SELECT *, net - avg(net) OVER (PARTITION BY claim) AS e, avg(net) OVER (PARTITION BY claim) AS m, row_number() OVER (PARTITION BY claim ORDER BY date) AS i FROM s), v AS (SELECT a.claim, sum(a.e * b.e * CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 5.0) END) AS v FROM e a JOIN e b ON a.claim = b.claim AND a.i - b.i BETWEEN 0 AND 4 GROUP BY a.claim), n AS (SELECT claim, count(*) AS n, any_value(m) AS m FROM e GROUP BY claim) SELECT claim, round(m * n / sqrt(v), 6) + 0.0 AS t FROM v JOIN n USING (claim)")
def _(spark, sf_dir):
    return metrics.newey_west(_series(spark, sf_dir), 4, ("claim",)).select("claim", _out(F.col("t")).alias("t"))


@query("g_subperiods", _BY_REGION + ", c AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY claim ORDER BY date) AS INTEGER) AS part FROM s) SELECT claim, part, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 AS sharpe FROM c GROUP BY claim, part")
def _(spark, sf_dir):
    return metrics.subperiods(_series(spark, sf_dir), 3, ("claim",)).select("claim", "part", _out(F.col("sharpe")).alias("sharpe"))


@query("g_correlation", _BY_REGION + " SELECT b.claim AS claim_id, round(covar_samp(a.net, b.net) / sqrt(var_samp(a.net) * var_samp(b.net)), 6) + 0.0 AS corr FROM s a JOIN s b USING (date) WHERE a.claim = 'ASIA' AND b.claim <> 'ASIA' GROUP BY b.claim")
def _(spark, sf_dir):
    s = _series(spark, sf_dir)
    out = correlations(s.where("claim = 'ASIA'"), s.where("claim <> 'ASIA'").withColumnRenamed("claim", "claim_id"))
    return out.select("claim_id", _out(F.col("corr")).alias("corr"))


@query("g_factor_beta", _BY_REGION + ", f AS (SELECT date, avg(ret_1d) AS market FROM panel WHERE ret_1d IS NOT NULL GROUP BY date) SELECT claim, round(regr_slope(net, market), 6) + 0.0 AS beta, round(regr_intercept(net, market), 9) + 0.0 AS alpha FROM s JOIN f USING (date) GROUP BY claim")
def _(spark, sf_dir):
    both = _series(spark, sf_dir).join(market(weekly_supplier(spark, sf_dir)), "date")
    return both.groupBy("claim").agg(_out(F.regr_slope("net", "market")).alias("beta"), _out(F.regr_intercept("net", "market"), 9).alias("alpha"))


_FACTORS = ", f AS (SELECT date, avg(ret_1d) AS market, avg(ret_1d) FILTER (sector IN ('S0', 'S1', 'S2')) - avg(ret_1d) FILTER (sector IN ('S5', 'S6', 'S7')) AS spread FROM panel WHERE ret_1d IS NOT NULL GROUP BY date)"


@query(
    "g_factor_regression",
    _BY_REGION
    + _FACTORS
    + """, o AS (SELECT net AS y, market AS a, spread AS b FROM s JOIN f USING (date) WHERE claim = 'ASIA' AND spread IS NOT NULL)
    , c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, covar_samp(a, y) AS ay, covar_samp(b, y) AS yb, avg(y) AS y, avg(a) AS a, avg(b) AS b, count(*) AS n, var_samp(y) AS yy FROM o)
    , k AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS m, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS s FROM c)
    , e AS (SELECT *, y - m * a - s * b AS alpha, (yy - m * ay - s * yb) * (n - 1) / (n - 3) AS v FROM k)
    SELECT round(alpha, 9) + 0.0 AS alpha, round(alpha / sqrt(v * (1.0 / n + (a * a * bb - 2 * a * b * ab + b * b * aa) / ((n - 1) * (aa * bb - ab * ab)))), 6) + 0.0 AS alpha_t, round(m, 6) + 0.0 AS market, round(s, 6) + 0.0 AS spread FROM e""",
)
def _(spark, sf_dir):
    p = weekly_supplier(spark, sf_dir).where("ret_1d is not null")
    side = lambda *names: F.avg(F.when(F.col("sector").isin(*names), F.col("ret_1d")))
    factors = p.groupBy("date").agg(F.avg("ret_1d").alias("market"), (side("S0", "S1", "S2") - side("S5", "S6", "S7")).alias("spread"))
    fit = factor_regression(_series(spark, sf_dir).where("claim = 'ASIA'"), factors, ["market", "spread"])
    return spark.createDataFrame([fit], "alpha double, alpha_t double, market double, spread double").select(_out(F.col("alpha"), 9).alias("alpha"), *[_out(F.col(c)).alias(c) for c in ("alpha_t", "market", "spread")])


_NET = "avg(net) / stddev_samp(net) * sqrt(252)"


@query(
    "gate_values",
    _BY_REGION
    + f""", h AS (SELECT * FROM s WHERE claim = 'ASIA'), x AS (SELECT {_NET} AS asia FROM h), a AS (SELECT {_NET} AS africa FROM s WHERE claim = 'AFRICA')
    , e AS (SELECT net, net - avg(net) OVER () AS e, avg(net) OVER () AS m, row_number() OVER (ORDER BY date) AS i FROM h)
    , v AS (SELECT sum(p.e * q.e * CASE WHEN p.i = q.i THEN 1 ELSE 2 * (1 - (p.i - q.i) / 5.0) END) AS v FROM e p JOIN e q ON p.i - q.i BETWEEN 0 AND 4)
    , g AS (SELECT *, product(1 + net) OVER (ORDER BY date) AS growth FROM h), d AS (SELECT *, max(growth) OVER (ORDER BY date) AS peak FROM g)
    , b AS (SELECT ntile(3) OVER (ORDER BY date) AS part, net FROM h), parts AS (SELECT {_NET} AS sharpe FROM b GROUP BY part)
    , o AS (SELECT q.claim, covar_samp(p.net, q.net) / sqrt(var_samp(p.net) * var_samp(q.net)) AS corr FROM h p JOIN s q USING (date) WHERE q.claim <> 'ASIA' GROUP BY q.claim)
    , z AS (
      SELECT 'G1_turnover_cost' AS name, 1.0 AS value UNION ALL SELECT 'G2_replication', CASE WHEN africa < 0 THEN -1 ELSE 1 END * abs(africa) / 2.0 FROM a
      UNION ALL SELECT 'G3_significance', (SELECT any_value(m) * count(*) FROM e) / sqrt(v) FROM v
      UNION ALL SELECT 'G5_out_of_sample', CASE WHEN africa < 0 THEN africa ELSE greatest(0.0, africa / asia) END FROM a, x
      UNION ALL SELECT 'G6_subperiods', CAST(count(*) FILTER (sharpe > 0) AS DOUBLE) FROM parts
      UNION ALL SELECT 'G7_drawdown', abs(min(growth / peak - 1)) / (stddev_samp(net) * sqrt(252)) FROM d
      UNION ALL SELECT 'G8_capacity', africa / asia FROM a, x
      UNION ALL SELECT 'G11_assumptions', avg(CASE WHEN q > 0.5 * asia THEN 1.0 ELSE 0.0 END) FROM x, (VALUES (0.1), (1.0), (100.0)) t(q)
      UNION ALL SELECT 'G12_parameters', avg(CASE WHEN q > 0.5 * asia THEN 1.0 ELSE 0.0 END) FROM x, (VALUES (-1.0), (100.0)) t(q)
      UNION ALL SELECT 'G13_orthogonality', max(abs(corr)) FROM o)
    SELECT name, round(value, 6) + 0.0 AS value FROM z""",
)
def _(spark, sf_dir):
    """The gates that SQL can work out, asked for in order over the series of one region (the deflated Sharpe needs
    a normal distribution; the factor gates have their own query)."""
    own = lambda name: _series(spark, sf_dir).where(F.col("claim") == name).withColumn("gross", F.col("net"))
    other = _series(spark, sf_dir).where("claim <> 'ASIA'").withColumnRenamed("claim", "claim_id")
    context = GateContext(own("AFRICA"), own("AFRICA"), own("AFRICA"), market(weekly_supplier(spark, sf_dir)), ["market"], 3, 2.0, 4, [0.1, 1.0, 100.0], [-1.0, 100.0], other, strict_sign=False)
    left_out = ("G4_deflated_sharpe", "G9_factor_residual", "G10_factor_loading")
    rows = [(n, None if v is None else float(v)) for n, v in gate_values(own("ASIA"), context) if n not in left_out]
    return spark.createDataFrame(rows, "name string, value double").select("name", _out(F.col("value")).alias("value"))


def _sweep_sql() -> str:
    one = "SELECT '{n}' AS scenario, round(avg(gross - cost) / stddev_samp(gross - cost) * sqrt(252), 6) + 0.0 AS sharpe FROM ({sql})"
    return " UNION ALL ".join(one.format(n=n, sql=_backtest_sql("monthly", 1, signal=f"c{n}").replace("FROM panel p JOIN rebal", f"FROM (SELECT *, close / lag(close, {n}) OVER {_A} - 1 AS c{n} FROM panel) p JOIN rebal") + _RETURNS + " SELECT * FROM daily") for n in (2, 4, 8))


@query("sweep_sharpes", _sweep_sql())
def _(spark, sf_dir):
    """Net Sharpe of three look-backs, all in one job."""
    spec = spec_of([node("n1", "pct_change", "close", n="n")], {"n": 4}, portfolio=book(rebalance="monthly"))
    runs = [Scenario(str(n), {"n": float(n)}) for n in (2, 4, 8)]
    return metrics.summary(_run(spark, sf_dir, spec, scenarios=runs).returns).select("scenario", _out(F.col("sharpe")).alias("sharpe"))


@query(
    "flagship",
    _backtest_sql("weekly", 1, signal="z").replace("FROM panel p JOIN rebal", f"FROM (SELECT *, -1 * (c - avg(c) OVER {_D}) / nullif(stddev_samp(c) OVER {_D}, 0) AS z FROM (SELECT *, close / lag(close, 4) OVER {_A} - 1 AS c FROM panel)) p JOIN rebal")
    + _RETURNS
    + " SELECT count(*) AS n, round(avg(gross - cost) / stddev_samp(gross - cost) * sqrt(252), 6) + 0.0 AS net_sharpe, round(avg(gross) / stddev_samp(gross) * sqrt(252), 6) + 0.0 AS gross_sharpe, round(sum(cost), 6) + 0.0 AS cost FROM daily",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversal of four-week returns: signal, decile book, weekly trades, costs, statistics."""
    spec = spec_of([node("n1", "pct_change", "close", n="n"), node("n2", "cs_zscore", "n1")], {"n": 4}, sign=-1)
    r = _run(spark, sf_dir, spec).returns
    return r.agg(F.count(F.lit(1)).alias("n"), _out(metrics.sharpe("net")).alias("net_sharpe"), _out(metrics.sharpe("gross")).alias("gross_sharpe"), _out(F.sum("cost")).alias("cost"))
