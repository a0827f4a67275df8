"""The operators as queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import ieee, leap
from tickloom.operators import metrics, numeric, portfolios, predictors, rolling, stocks, structural, traders
from tickloom.plans import align
from tickloom.plans.node import Node
from tickloom.sources import batch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def us(c: str) -> Column:
    """Microseconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def tidy(x: str | Column) -> Column:
    """Rounded for comparison, NaN as null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), F.round(c, 6) + F.lit(0.0))


def out(node: Node, *keys: str) -> DataFrame:
    ts = [us(node.ts).alias("us") if dict(node.df.dtypes)[node.ts].startswith("timestamp") else F.col(node.ts).alias("us")]
    return node.df.select(*(keys or node.entity), *ts, *[tidy(v).alias(v) for v in node.values])


# --- events: one entity for each user, or one scalar node for each type ---


def users(spark, d) -> Node:
    return Node(table(spark, d, "events").select("user_id", us("ts").alias("ts"), F.col("value").alias("v")), "ts", ("user_id",))


def of_type(spark, d, kind: str, name: str = "v", init: float | None = 0.0) -> Node:
    df = table(spark, d, "events").where(F.col("event_type") == kind)
    return Node(df.select("user_id", us("ts").alias("ts"), F.col("value").alias(name)), "ts", ("user_id",), (name,), init)


E = "WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, value AS v FROM events) "
DAY = 86_400_000_000


@query("rolling_mean", E + "SELECT user_id, us, ROUND(v10, 6) AS v FROM (SELECT user_id, us, avg(v) OVER w AS v10, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS 9 PRECEDING)) WHERE n >= 10")
def rolling_mean(spark, d):
    return out(rolling.rolling_mean(users(spark, d), 10))


@query("rolling_sum", E + "SELECT user_id, us, ROUND(s, 6) AS v FROM (SELECT user_id, us, sum(v) OVER w AS s, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS 4 PRECEDING)) WHERE n >= 5")
def rolling_sum(spark, d):
    return out(rolling.rolling_sum(users(spark, d), 5))


@query("rolling_sum_prefix", ORACLES["rolling_sum"])
def rolling_sum_prefix(spark, d):
    return out(rolling.rolling_sum_prefix(users(spark, d), 5))


@query("rolling_mean_range", E + "SELECT user_id, us, ROUND(avg(v) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW), 6) AS v FROM e")
def rolling_mean_range(spark, d):
    return out(rolling.rolling_mean(users(spark, d), timedelta(hours=6)))


@query("rolling_variance", E + "SELECT user_id, us, ROUND(s, 6) AS v FROM (SELECT user_id, us, var_pop(v) OVER w AS s, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS 7 PRECEDING)) WHERE n >= 8")
def rolling_variance(spark, d):
    return out(rolling.rolling_variance(users(spark, d), 8))


@query("ema", E + "SELECT user_id, us, ROUND((0.5 * v + 0.25 * l1 + 0.125 * l2 + 0.0625 * l3) / 0.9375, 6) AS v FROM (SELECT user_id, us, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)) WHERE l3 IS NOT NULL")
def ema(spark, d):
    return out(rolling.ema(users(spark, d), 4, alpha=0.5))


DAILY = E + f", p AS (SELECT event_type, us // {DAY} AS t, avg(v) AS v FROM e GROUP BY ALL) "


def daily(spark, d) -> Node:
    """Daily mean value of each event type."""
    df = table(spark, d, "events").select("event_type", F.floor(us("ts") / DAY).alias("ts"), "value")
    return Node(df.groupBy("event_type", "ts").agg(F.avg("value").alias("v")), "ts", ("event_type",))


@query("rolling_covariance", DAILY + ", q AS (SELECT a.event_type AS i, b.event_type AS j, a.t, covar_pop(a.v, b.v) OVER w AS c, row_number() OVER (PARTITION BY a.event_type, b.event_type ORDER BY a.t) AS n FROM p a JOIN p b USING (t) WINDOW w AS (PARTITION BY a.event_type, b.event_type ORDER BY a.t ROWS 4 PRECEDING)) SELECT i, j, t AS us, ROUND(c, 6) AS cov FROM q WHERE n >= 5")
def rolling_covariance(spark, d):
    return out(rolling.rolling_covariance(daily(spark, d), 5))


@query("forward_fill", E + ", m AS (SELECT user_id, us, CASE WHEN v >= 5 THEN v END AS x FROM e) SELECT user_id, us, ROUND(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING), 6) AS v FROM m")
def forward_fill(spark, d):
    n = users(spark, d)
    return out(numeric.forward_fill(n.derive(F.when(F.col("v") >= 5, F.col("v")).otherwise(ieee.nan()))))


@query("diff", E + "SELECT user_id, us, ROUND(v - lag(v) OVER (PARTITION BY user_id ORDER BY us), 6) AS v FROM e")
def diff(spark, d):
    return out(numeric.diff(users(spark, d)))


@query("pct_change", E + "SELECT user_id, us, ROUND(v / nullif(lag(v) OVER (PARTITION BY user_id ORDER BY us), 0) - 1, 6) AS v FROM e")
def pct_change(spark, d):
    p = numeric.pct_change(users(spark, d))
    return out(p.derive(F.when(ieee.finite("v"), F.col("v")).otherwise(ieee.nan())))


@query("lag", E + "SELECT user_id, us, ROUND(lag(v, 2, 0) OVER (PARTITION BY user_id ORDER BY us), 6) AS v FROM e")
def lag(spark, d):
    return out(structural.lag(users(spark, d), 2))


@query("record_last", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e")
def record_last(spark, d):
    return out(structural.last(structural.record(structural.identity(users(spark, d)))))


@query("series_tail", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC) <= 3")
def series_tail(spark, d):
    n = users(spark, d)
    return out(n.with_df(n.tail(3)))


@query("series_slice", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us) BETWEEN 3 AND 6")
def series_slice(spark, d):
    n = users(spark, d)
    return out(n.with_df(n.slice(2, 6)))


@query("series_asof", E + "SELECT user_id, ROUND(arg_max(v, us), 6) AS v FROM e WHERE us <= 1705276800000000 GROUP BY user_id")
def series_asof(spark, d):
    return users(spark, d).asof(1705276800000000).select("user_id", tidy("v").alias("v"))


@query("series_search", E + "SELECT user_id, count(*) FILTER (us < 1705276800000000) AS position FROM e GROUP BY user_id")
def series_search(spark, d):
    return users(spark, d).search(1705276800000000)


@query("array_latest", E + "SELECT user_id, ROUND(arg_max(v, us), 6) AS v FROM e GROUP BY user_id")
def array_latest(spark, d):
    return users(spark, d).latest().select("user_id", tidy("v").alias("v"))


@query("filter_ticks", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e WHERE v > 10")
def filter_ticks(spark, d):
    n = users(spark, d)
    return out(n.with_df(n.df.where("v > 10")))


@query("filter_panel", DAILY + "SELECT event_type, t AS us, ROUND(v, 6) AS v FROM p WHERE t IN (SELECT t FROM p GROUP BY t HAVING avg(v) > 10)")
def filter_panel(spark, d):
    return out(structural.filter_ticks(daily(spark, d), F.avg("v") > 10))


@query("where", E + "SELECT user_id, us, ROUND(CASE WHEN v > 10 THEN v ELSE -1 END, 6) AS v FROM e")
def where(spark, d):
    return out(structural.where(users(spark, d), F.col("v") > 10, -1.0))


@query("cast", E + "SELECT user_id, us, CASE WHEN v * 1000 >= 32767 THEN 32767 WHEN v * 1000 <= -32768 THEN -32768 ELSE trunc(v * 1000) END::BIGINT AS v FROM e")
def cast(spark, d):
    n = users(spark, d)
    n = structural.cast(n.derive(F.col("v") * 1000), "smallint")
    return n.df.select("user_id", F.col("ts").alias("us"), F.col("v").cast("bigint").alias("v"))


@query("select_entities", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e WHERE user_id IN (1, 3, 5)")
def select_entities(spark, d):
    return out(structural.select_entities(users(spark, d), "user_id", [1, 3, 5]))


@query("map_ticks", DAILY + "SELECT t AS us, ROUND(max(v) - min(v), 6) AS v FROM p GROUP BY t")
def map_ticks(spark, d):
    import pandas as pd

    df = structural.map_ticks(daily(spark, d), lambda pdf: pd.DataFrame({"us": [pdf["ts"].iloc[0]], "v": [round(pdf["v"].max() - pdf["v"].min(), 6)]}), "us long, v double")
    return df


# binary operators on the latest of two sources

TWO = E + """, u AS (SELECT user_id, us, max(CASE WHEN event_type = 'click' THEN v END) AS a, max(CASE WHEN event_type = 'error' THEN v END) AS b FROM e WHERE event_type IN ('click', 'error') GROUP BY ALL),
m AS (SELECT user_id, us, a IS NOT NULL AS ta, b IS NOT NULL AS tb, a AS a0, b AS b0, coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS b FROM u WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)) """


def two(spark, d) -> list[Node]:
    return [of_type(spark, d, "click"), of_type(spark, d, "error")]


def _binary(op: str, sql: str) -> None:
    @query(op, TWO + f"SELECT user_id, us, ROUND({sql}, 6) AS v FROM m")
    def run(spark, d):
        n = structural.binary(*two(spark, d), op)
        return out(n.derive(F.when(ieee.finite("v"), F.col("v")).otherwise(ieee.nan())))


for _op, _sql in {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / nullif(b, 0)", "min": "least(a, b)", "max": "greatest(a, b)"}.items():
    _binary(_op, _sql)


def _unary(op: str, sql: str, shift: float = 0.0) -> None:
    @query(op, f"SELECT event_id, ROUND({sql}, 6) AS v FROM (SELECT event_id, value - {shift} AS x FROM events)")
    def run(spark, d):
        x = F.col("value") - shift
        y = ieee.UNARY[op](x)
        return table(spark, d, "events").select("event_id", tidy(F.when(ieee.finite(y), y).otherwise(ieee.nan())).alias("v"))


for _op, _sql, _shift in [
    ("negate", "-x", 0.0), ("log", "CASE WHEN x > 0 THEN ln(x) END", 5.0), ("log2", "CASE WHEN x > 0 THEN log2(x) END", 5.0), ("log10", "CASE WHEN x > 0 THEN log10(x) END", 5.0),
    ("exp", "CASE WHEN x < 5 THEN exp(x) ELSE exp(x) END", 20.0), ("exp2", "pow(2, x)", 20.0), ("sqrt", "CASE WHEN x >= 0 THEN sqrt(x) END", 5.0), ("ceil", "ceil(x)", 5.0), ("floor", "floor(x)", 5.0),
    ("round", "round(x)", 5.0), ("recip", "1 / nullif(x, 0)", 0.0), ("abs", "abs(x)", 5.0), ("sign", "CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", 5.0),
]:
    if _op not in ("exp", "exp2"):
        _unary(_op, _sql, _shift)


@query("exp", "SELECT event_id, ROUND(exp(-abs(value) / 10), 6) AS e1, ROUND(pow(2, -abs(value) / 10), 6) AS e2 FROM events")
def exp(spark, d):
    x = -F.abs("value") / 10
    return table(spark, d, "events").select("event_id", tidy(ieee.exp(x)).alias("e1"), tidy(ieee.exp2(x)).alias("e2"))


@query("pow_clamp_fillna", "SELECT event_id, ROUND(pow(value, 1.5), 6) AS p, ROUND(greatest(2, least(20, value)), 6) AS c, ROUND(CASE WHEN value > 5 THEN value ELSE -7 END, 6) AS f FROM events")
def pow_clamp_fillna(spark, d):
    n = Node(table(spark, d, "events").select("event_id", us("ts").alias("ts"), F.col("value").alias("v")), "ts", ("event_id",))
    holes = n.derive(F.when(F.col("v") > 5, F.col("v")).otherwise(ieee.nan()))
    parts = [numeric.power(n, 1.5).renamed("p"), numeric.clamp(n, 2, 20).renamed("c"), numeric.fillna(holes, -7).renamed("f")]
    return align.merge_latest(*parts).select("event_id", *[tidy(c).alias(c) for c in "pcf"])


@query("merge_latest", TWO + "SELECT user_id, us, ROUND(a, 6) AS a, ROUND(b, 6) AS b, ta AS ticked_0, tb AS ticked_1 FROM m")
def merge_latest(spark, d):
    n = align.merge_latest(of_type(spark, d, "click", "a"), of_type(spark, d, "error", "b"))
    return n.select("user_id", F.col("ts").alias("us"), tidy("a").alias("a"), tidy("b").alias("b"), "ticked_0", "ticked_1")


@query("asof_join", E + "SELECT c.user_id, c.us, ROUND(c.v, 6) AS a, ROUND(x.v, 6) AS b FROM (SELECT * FROM e WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') x ON c.user_id = x.user_id AND c.us >= x.us")
def asof_join(spark, d):
    n = align.asof_join(of_type(spark, d, "click", "a"), of_type(spark, d, "error", "b"))
    return n.select("user_id", F.col("ts").alias("us"), tidy("a").alias("a"), tidy("b").alias("b"))


@query("asof_strict", ORACLES["asof_join"].replace("c.us >= x.us", "c.us > x.us"))
def asof_strict(spark, d):
    n = align.asof_join(of_type(spark, d, "click", "a"), of_type(spark, d, "error", "b"), strict=True)
    return n.select("user_id", F.col("ts").alias("us"), tidy("a").alias("a"), tidy("b").alias("b"))


CLOCK = E + f", c AS (SELECT unnest(range(1704067200000000, 1706659200000000, {DAY})) AS us), g AS (SELECT user_id, c.us FROM (SELECT DISTINCT user_id FROM e) u, c) "


def day_clock(spark) -> DataFrame:
    return spark.range(1704067200000000, 1706659200000000, DAY).select(F.col("id").alias("ts"))


@query("resample", CLOCK + "SELECT g.user_id, g.us, ROUND(coalesce(e.v, 0), 6) AS v FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.us >= e.us")
def resample(spark, d):
    return out(align.resample(day_clock(spark), users(spark, d)))


@query("clocked", CLOCK + "SELECT g.user_id, g.us, ROUND(coalesce(a.v, 0) + coalesce(b.v, 0), 6) AS v FROM g ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') a ON g.user_id = a.user_id AND g.us >= a.us ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') b ON g.user_id = b.user_id AND g.us >= b.us WHERE g.user_id IN (SELECT user_id FROM e WHERE event_type IN ('click', 'error'))")
def clocked(spark, d):
    return out(structural.clocked(day_clock(spark), two(spark, d), lambda a, b: structural.binary(a, b, "add")))


STACK = TWO + "SELECT user_id, 0 AS i, us, ROUND({a}, 6) AS v FROM m UNION ALL SELECT user_id, 1, us, ROUND({b}, 6) FROM m"


@query("stack", STACK.format(a="a", b="b"))
def stack(spark, d):
    return out(align.stack(two(spark, d)))


@query("stack_sync", STACK.format(a="a0", b="b0"))
def stack_sync(spark, d):
    return out(align.stack_sync(two(spark, d)))


CONCAT = E.rstrip() + ", a AS (SELECT user_id % 3 AS k, us, max(v) AS v FROM e WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT 3 + user_id % 2 AS k, us, max(v) AS v FROM e WHERE event_type = 'error' GROUP BY ALL), x AS (FROM a UNION ALL FROM b), g AS (SELECT k, us FROM (SELECT DISTINCT us FROM x), (SELECT DISTINCT k FROM x)) "


def ends(spark, d) -> list[Node]:
    """Clicks along an axis of 3 entries, errors along one of 2."""
    parts = [(of_type(spark, d, "click").df, 3), (of_type(spark, d, "error").df, 2)]
    return [Node(df.groupBy((F.col("user_id") % n).alias("k"), "ts").agg(F.max("v").alias("v")), "ts", ("k",)) for df, n in parts]


@query("concat", CONCAT + "SELECT g.k, g.us, ROUND(coalesce(x.v, 0), 6) AS v FROM g ASOF LEFT JOIN x ON g.k = x.k AND g.us >= x.us")
def concat(spark, d):
    return out(align.concat(ends(spark, d), "k", [3, 2]))


@query("concat_sync", CONCAT + "SELECT g.k, g.us, ROUND(x.v, 6) AS v FROM g LEFT JOIN x ON g.k = x.k AND g.us = x.us")
def concat_sync(spark, d):
    return out(align.concat_sync(ends(spark, d), "k", [3, 2]))


@query("coalesce_ticks", "SELECT user_id, epoch_us(date_trunc('day', ts)) AS us, ROUND(arg_max(value, event_id), 6) AS v FROM events GROUP BY ALL")
def coalesce_ticks(spark, d):
    df = table(spark, d, "events").select("user_id", us("date_trunc('day', ts)").alias("us"), "event_id", F.col("value").alias("v"))
    return align.coalesce_ticks(df, ["user_id", "us"], "event_id").select("user_id", "us", tidy("v").alias("v"))


@query("semi_join_clock", E + f"SELECT user_id, us, ROUND(v, 6) AS v FROM e WHERE us IN (SELECT us FROM e WHERE event_type = 'click')")
def semi_join_clock(spark, d):
    c = of_type(spark, d, "click")
    return out(align.at_ticks(Node(c.df.select("ts", "v"), "ts"), users(spark, d)))


# --- cross-sections: month x brand ---

PANEL = "WITH p AS (SELECT p_brand AS brand, epoch_us(date_trunc('month', l_shipdate)) AS us, avg(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) "


def panel(spark, d) -> Node:
    li = table(spark, d, "lineitem").select("l_partkey", us("date_trunc('month', l_shipdate)").alias("ts"), "l_extendedprice")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return Node(li.join(part, "l_partkey").groupBy("brand", "ts").agg(F.avg("l_extendedprice").alias("v")), "ts", ("brand",))


@query("percentile", PANEL + "SELECT brand, us, ROUND((row_number() OVER (PARTITION BY us ORDER BY v, brand) - 0.5) / count(*) OVER (PARTITION BY us), 6) AS v FROM p")
def percentile(spark, d):
    return out(numeric.percentile(panel(spark, d)))


def _acklam(p: str) -> str:
    poly = lambda cs, x: "(" * (len(cs) - 1) + str(cs[0]) + "".join(f" * {x} + {c})" for c in cs[1:])
    tail = lambda q: f"({poly(ieee.ACKLAM_C, f'sqrt(-2 * ln({q}))')} / {poly([*ieee.ACKLAM_D, 1.0], f'sqrt(-2 * ln({q}))')})"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} < {ieee.ACKLAM_LOW} THEN {tail(p)} WHEN {p} > 1 - {ieee.ACKLAM_LOW} THEN -{tail(f'(1 - {p})')} ELSE {poly(ieee.ACKLAM_A, r)} * ({p} - 0.5) / {poly([*ieee.ACKLAM_B, 1.0], r)} END"


@query("gaussianize", PANEL + f", q AS (SELECT brand, us, ((row_number() OVER (PARTITION BY us ORDER BY v, brand) - 0.5) / count(*) OVER (PARTITION BY us))::DOUBLE AS p FROM p) SELECT brand, us, ROUND({_acklam('p')}, 6) AS v FROM q")
def gaussianize(spark, d):
    return out(numeric.gaussianize(panel(spark, d)))


@query("winsorize", PANEL + ", l AS (SELECT us, list_sort(list(v)) AS s, floor(count(*) * 0.1)::INT AS k FROM p GROUP BY us) SELECT brand, us, ROUND(greatest(s[k + 1], least(s[len(s) - k], v)), 3) AS v FROM p JOIN l USING (us)")
def winsorize(spark, d):
    return numeric.winsorize(panel(spark, d), 0.1).df.select("brand", F.col("ts").alias("us"), F.round("v", 3).alias("v"))


@query("top_k_weights", PANEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY us ORDER BY v DESC, brand) AS n FROM p) SELECT brand, us, ROUND(CASE WHEN n <= 5 THEN v / sum(CASE WHEN n <= 5 THEN v END) OVER (PARTITION BY us) ELSE 0 END, 6) AS v FROM r")
def top_k_weights(spark, d):
    return out(numeric.top_k_weights(panel(spark, d), 5))


@query("total_market_cap", PANEL + "SELECT us, ROUND(sum(v), 4) AS v FROM p GROUP BY us")
def total_market_cap(spark, d):
    return numeric.total(panel(spark, d)).df.select(F.col("ts").alias("us"), F.round("v", 4).alias("v"))


MU = PANEL + ", u AS (SELECT brand, us, v / lag(v) OVER (PARTITION BY brand ORDER BY us) - 1 AS mu FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY us ORDER BY CASE WHEN mu > 0 THEN mu END DESC NULLS LAST, brand) AS r, round_even(count(CASE WHEN mu > 0 THEN 1 END) OVER (PARTITION BY us) * 0.3::DOUBLE, 0) AS k FROM u) "


def mu(spark, d) -> Node:
    p = panel(spark, d)
    change = numeric.pct_change(p)
    return portfolios.usable_returns(p.derive(F.lit(1.0)), change, logarithmic=False)


@query("proportional", MU + "SELECT brand, us, ROUND(coalesce(greatest(mu, 0) / nullif(sum(greatest(mu, 0)) OVER (PARTITION BY us), 0), 0), 6) AS v FROM (SELECT brand, us, coalesce(mu, 0) AS mu FROM q)")
def proportional(spark, d):
    return out(portfolios.proportional(mu(spark, d)))


@query("rank_equal", MU + "SELECT brand, us, ROUND(CASE WHEN mu > 0 AND r <= k THEN 1 / k ELSE 0 END, 6) AS v FROM q")
def rank_equal(spark, d):
    return out(portfolios.rank_equal(mu(spark, d), 0.3))


@query("rank_linear", MU + "SELECT brand, us, ROUND(CASE WHEN mu > 0 AND r <= k THEN (k - r + 1) / (k * (k + 1) / 2) ELSE 0 END, 6) AS v FROM q")
def rank_linear(spark, d):
    return out(portfolios.rank_linear(mu(spark, d), 0.3))


@query("softmax", MU + "SELECT brand, us, ROUND(coalesce(exp(greatest(mu, 0) / 0.5) / sum(CASE WHEN mu IS NOT NULL THEN exp(greatest(mu, 0) / 0.5) END) OVER (PARTITION BY us), 0), 6) AS v FROM (SELECT brand, us, mu FROM q) WHERE mu IS NOT NULL UNION ALL SELECT brand, us, 0 FROM q WHERE mu IS NULL")
def softmax(spark, d):
    return out(portfolios.softmax(mu(spark, d), 0.5))


@query("turnover", PANEL + ", u AS (SELECT brand, us, v / sum(v) OVER (PARTITION BY us) AS w FROM p), g AS (SELECT b.brand, t.us, u.w FROM (SELECT DISTINCT brand FROM p) b CROSS JOIN (SELECT DISTINCT us FROM p) t LEFT JOIN u ON u.brand = b.brand AND u.us = t.us), c AS (SELECT us, abs(w - lag(w) OVER (PARTITION BY brand ORDER BY us)) AS c, lag(us) OVER (PARTITION BY brand ORDER BY us) AS prev FROM g) SELECT us, ROUND(sum(coalesce(c, 0)), 6) AS v FROM c WHERE prev IS NOT NULL GROUP BY us")
def turnover(spark, d):
    p = panel(spark, d)
    return out(metrics.turnover(p.derive(F.col("v") / F.sum("v").over(p.across()))))


# --- stocks, reports, metrics ---

PRICE = "WITH s AS (SELECT p_brand AS brand, epoch_us(date_trunc('month', l_shipdate)) AS us, avg(l_extendedprice / l_quantity) AS v, max(l_discount) AS m, sum(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) "


@query("forward_adjust", PRICE + ", q AS (SELECT *, lag(v) OVER (PARTITION BY brand ORDER BY us) AS prev FROM s), f AS (SELECT brand, us, v, CASE WHEN prev IS NOT NULL AND n % 3 = 0 THEN (1 + m / (prev - m)) * (1 + m / 10) ELSE 1 END AS f FROM q) SELECT brand, us, ROUND(v * exp(sum(ln(f)) OVER (PARTITION BY brand ORDER BY us ROWS UNBOUNDED PRECEDING)), 4) AS v FROM f")
def forward_adjust(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", us("date_trunc('month', l_shipdate)").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), "l_discount", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    s = li.join(part, "l_partkey").groupBy("brand", "ts").agg(F.avg("x").alias("v"), F.max("l_discount").alias("cash"), F.sum("l_quantity").alias("n"))
    dividends = s.where("n % 3 = 0").select("brand", "ts", (F.col("cash") / 10).alias("share"), "cash")
    node = stocks.forward_adjust(Node(s.select("brand", "ts", "v"), "ts", ("brand",)), Node(dividends, "ts", ("brand",), ("share", "cash"), None))
    return node.df.select("brand", F.col("ts").alias("us"), F.round("v", 4).alias("v"))


REPORTS = """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS report, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 120)::INT END AS notice, o_totalprice AS x FROM orders),
k AS (SELECT *, greatest(report, coalesce(notice, report + 90)) AS t FROM r),
m AS (SELECT *, max(report) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k),
f AS (SELECT o_custkey, t, arg_max(struct_pack(report := report, x := x), report) AS s FROM m WHERE seen IS NULL OR report > seen GROUP BY ALL) """


def reports(spark, d, **kwargs) -> Node:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("report_date"), F.col("o_totalprice").alias("x"))
    o = o.withColumn("notice_date", F.when(F.col("o_orderkey") % 7 != 0, F.date_add("report_date", (F.col("o_orderkey") % 120).cast("int"))))
    return batch.financial_reports(o, ["x"], entity=("o_custkey",), order="o_orderkey", with_report_date=True, **kwargs)


def _days(node: Node) -> DataFrame:
    return node.df.withColumn("day_no", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")))


@query("financial_reports", REPORTS + "SELECT o_custkey, (t::DATE - DATE '1970-01-01')::INT AS day_no, year(s.report)::DOUBLE AS year, dayofyear(s.report)::DOUBLE AS day, ROUND(s.x, 6) AS x FROM f")
def financial_reports(spark, d):
    return _days(reports(spark, d)).select("o_custkey", "day_no", "year", "day", tidy("x").alias("x"))


@query("annualize", REPORTS + ", g AS (SELECT o_custkey, t, year(s.report) AS y, dayofyear(s.report) AS d, s.x AS x, lag(year(s.report)) OVER w AS py, lag(dayofyear(s.report)) OVER w AS pd, lag(s.x) OVER w AS px FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY t)), h AS (SELECT o_custkey, t, CASE WHEN py = y THEN d - pd ELSE d END AS n, CASE WHEN py = y THEN x - px ELSE x END AS dx FROM g) SELECT o_custkey, (t::DATE - DATE '1970-01-01')::INT AS day_no, CASE WHEN n > 0 THEN ROUND(dx * 365 / n * 1.0001::DOUBLE, 2) END AS x FROM h")
def annualize(spark, d):
    a = stocks.annualize(reports(spark, d))
    # the factor keeps rates off the halves that the two engines round apart
    return _days(a).select("o_custkey", "day_no", F.when(~F.isnan("x"), F.round(F.col("x") * 1.0001, 2)).alias("x"))


# the balance, the year-to-date profit and the shares of each brand, known at the ends of quarters and starts of years
FINANCE = PANEL.rstrip() + """, l AS (SELECT p_brand AS brand, l_shipdate::DATE AS day, l_extendedprice AS x, l_discount AS y, l_quantity AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT brand, (date_trunc('quarter', day) + INTERVAL 3 MONTH)::DATE - 1 AS t, sum(x * y) AS profit, sum(x) AS equity FROM l GROUP BY ALL),
c AS (SELECT *, sum(profit) OVER (PARTITION BY brand, year(t) ORDER BY t) AS ytd FROM q),
a AS (SELECT brand, t, equity, ytd, CASE WHEN lag(year(t)) OVER w = year(t) THEN lag(dayofyear(t)) OVER w ELSE 0 END AS pd, CASE WHEN lag(year(t)) OVER w = year(t) THEN lag(ytd) OVER w ELSE 0 END AS px FROM c WINDOW w AS (PARTITION BY brand ORDER BY t)),
i AS (SELECT brand, t, equity, avg((ytd - px) * 365 / (dayofyear(t) - pd)) OVER (PARTITION BY brand ORDER BY t RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS ttm FROM a),
f AS (SELECT brand, epoch_us(t::TIMESTAMP) AS us, equity, ttm FROM i),
s AS (SELECT brand, epoch_us(date_trunc('year', day)::TIMESTAMP) AS us, sum(n) AS shares FROM l GROUP BY ALL),
k AS (SELECT brand, us FROM p UNION SELECT brand, us FROM f UNION SELECT brand, us FROM s),
j AS (SELECT k.brand, k.us, p.v * s.shares AS cap, f.equity, f.ttm FROM k ASOF LEFT JOIN p ON k.brand = p.brand AND k.us >= p.us ASOF LEFT JOIN s ON k.brand = s.brand AND k.us >= s.us ASOF LEFT JOIN f ON k.brand = f.brand AND k.us >= f.us) """


@query("financial_ratios", FINANCE + "SELECT brand, us, ROUND(cap / 1e6::DOUBLE, 3) AS market_cap_m, ROUND(ttm / cap, 6) AS ep, ROUND(equity / cap, 6) AS bp, ROUND(ttm / equity, 6) AS roe FROM j WHERE cap IS NOT NULL AND ttm IS NOT NULL")
def financial_ratios(spark, d):
    """Market value, profit of the last year and equity of each brand at every tick of its prices, shares and reports: E/P, B/P, ROE."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    li = table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"), F.col("l_quantity").alias("n")).join(part, "l_partkey")
    end = F.date_sub(F.add_months(F.trunc("day", "quarter"), 3), 1)
    quarters = li.groupBy("brand", end.alias("report_date")).agg(F.sum(F.col("x") * F.col("y")).alias("profit"), F.sum("x").alias("equity"))
    so_far = Window.partitionBy("brand", F.year("report_date")).orderBy("report_date")
    quarters = quarters.withColumn("profit", F.sum("profit").over(so_far))
    known = {"notice": None, "entity": ("brand",), "use_effective_date": False}
    income = stocks.annualize(batch.financial_reports(quarters, ["profit"], with_report_date=True, **known))
    ttm = rolling.rolling_mean(income, timedelta(days=365)).renamed("ttm")
    equity = batch.financial_reports(quarters, ["equity"], **known)
    shares = Node(li.groupBy("brand", us("date_trunc('year', day)").alias("ts")).agg(F.sum("n").alias("shares")), "ts", ("brand",), ("shares",))
    reported = [n.with_df(n.df.withColumn("ts", us("ts"))) for n in (ttm, equity)]
    df = align.merge_latest(*[n.with_df(n.df, init=None) for n in (panel(spark, d), shares, *reported)])
    cap = F.col("v") * F.col("shares")
    df = df.where("v is not null and shares is not null and ttm is not null")
    ratio = lambda a, b: F.round(ieee.divide(a, b), 6)
    return df.select("brand", F.col("ts").alias("us"), F.round(cap / 1e6, 3).alias("market_cap_m"), ratio(F.col("ttm"), cap).alias("ep"), ratio(F.col("equity"), cap).alias("bp"), ratio(F.col("ttm"), F.col("equity")).alias("roe"))


ORD = "WITH v AS (SELECT epoch_us(o_orderdate) AS us, sum(o_totalprice) AS v FROM orders GROUP BY ALL), r AS (SELECT us, v, v / lag(v) OVER (ORDER BY us) - 1 AS r, first_value(v) OVER (ORDER BY us) AS v0, row_number() OVER (ORDER BY us) AS n FROM v) "
UPTO = "OVER (ORDER BY us ROWS UNBOUNDED PRECEDING)"


def value(spark, d) -> Node:
    """The order volume of each day, as the value of one portfolio."""
    return Node(table(spark, d, "orders").groupBy(us("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v")).withColumn("k", F.lit(0)), "ts", ("k",))


def _metric(name: str, f, sql: str) -> None:
    @query(name, ORD + f"SELECT us, ROUND({sql}, 6) AS v FROM r")
    def run(spark, d):
        return f(value(spark, d)).df.select(F.col("ts").alias("us"), tidy("v").alias("v"))


_metric("compound_return", metrics.compound_return, "CASE WHEN n = 1 THEN 0 ELSE pow(v / v0, 1.0 / (n - 1)) - 1 END")
_metric("average_return", metrics.average_return, f"avg(r) {UPTO}")
_metric("volatility", metrics.volatility, f"stddev_pop(r) {UPTO}")
_metric("sharpe_ratio", metrics.sharpe_ratio, f"CASE WHEN stddev_pop(r) {UPTO} > 1e-12 THEN avg(r) {UPTO} / stddev_pop(r) {UPTO} END")
_metric("drawdown", metrics.drawdown, f"(v - max(v) {UPTO}) / max(v) {UPTO}")


@query("information_coefficient", DAILY + """, k AS (SELECT DISTINCT t AS pts FROM p WHERE t % 5 = 0), l AS (SELECT pts, lead(pts) OVER (ORDER BY pts) AS nxt FROM k),
x AS (SELECT l.nxt, y.t, y.v AS y, q.v AS x FROM p y JOIN l ON y.t > l.pts AND y.t <= l.nxt JOIN p q ON q.t = l.pts AND q.event_type = y.event_type),
c AS (SELECT nxt, t, corr(x, y) AS c FROM x GROUP BY ALL) SELECT nxt AS us, ROUND(avg(c), 6) AS v FROM c GROUP BY nxt""")
def information_coefficient(spark, d):
    p = daily(spark, d)
    return out(metrics.information_coefficient(p.with_df(p.df.where("ts % 5 = 0")), p))


@query("leap_seconds", "SELECT event_id, epoch_us(ts) * 1000 + 37000000000 AS tai, epoch_us(ts) * 1000 AS utc FROM events")
def leap_seconds(spark, d):
    tai = leap.utc_to_tai(us("ts") * 1000)
    return table(spark, d, "events").select("event_id", tai.alias("tai"), leap.tai_to_utc(tai).alias("utc"))


@query("daily_clock", "SELECT epoch_us(unnest(generate_series(TIMESTAMP '2024-01-01 16:00:00', TIMESTAMP '2024-03-30 16:00:00', INTERVAL 1 DAY))) AS us")
def daily_clock(spark, d):
    return batch.daily_clock(spark, "2024-01-01 00:00:00", "2024-03-31 00:00:00", "Asia/Shanghai").select(us("ts").alias("us"))


@query("monthly_clock", "SELECT epoch_us(unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH))) AS us")
def monthly_clock(spark, d):
    return batch.monthly_clock(spark, "2024-01-15 00:00:00", "2024-12-31 00:00:00").select(us("ts").alias("us"))


@query("carry_in", E + "SELECT user_id, us, ROUND(v, 6) AS v FROM e WHERE us > 1704672000000000 AND us <= 1705276800000000 UNION ALL SELECT user_id, 1704672000000000, ROUND(arg_max(v, us), 6) FROM e WHERE us <= 1704672000000000 GROUP BY user_id")
def carry_in(spark, d):
    n = users(spark, d)
    return out(n.with_df(batch.carry_in(n.df, "ts", 1704672000000000, 1705276800000000, ("user_id",))))


@query("ols_expanding", "WITH m AS (SELECT epoch_us(date_trunc('month', l_shipdate)) AS us, l_quantity AS x, l_extendedprice AS y FROM lineitem), g AS (SELECT us, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM m GROUP BY us), c AS (SELECT us, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM g WINDOW w AS (ORDER BY us ROWS UNBOUNDED PRECEDING)) SELECT us, n::BIGINT AS n, ROUND((n * sxy - sx * sy) / (n * sxx - sx * sx), 3) AS slope, ROUND((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 2) AS intercept FROM c")
def ols_expanding(spark, d):
    li = table(spark, d, "lineitem").select(us("date_trunc('month', l_shipdate)").alias("us"), "l_quantity", "l_extendedprice")
    g = predictors.ols_by_gram(li, "us", ["l_quantity"], "l_extendedprice")
    return g.select("us", "n", F.round(F.col("beta")[0], 3).alias("slope"), F.round(F.col("beta")[1], 2).alias("intercept"))


# --- predictors, optimisers and traders: no SQL; NumPy tests instead ---


def _inputs(spark, d) -> tuple[Node, Node, Node]:
    """Universe every fifth day, two features and the daily change, over event types."""
    p = daily(spark, d)
    change = numeric.diff(p)
    features = Node(p.df.select("event_type", "ts", F.col("v").alias("f1"), (F.col("v") * F.col("v")).alias("f2")), "ts", ("event_type",), ("f1", "f2"))
    universe = p.with_df(p.df.where("ts % 5 = 0")).derive(F.lit(1.0))
    return universe, features, change


def _mean(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: out(f(*_inputs(spark, d)))


_mean("linear_regression", lambda u, x, y: predictors.predict_mean(u, x, y))
_mean("mean_sample", lambda u, x, y: predictors.predict_sample_mean(u, x, y, max_periods=20))
_mean("single_feature", lambda u, x, y: predictors.single_feature(u, x, 0))
for _name in predictors.COVARIANCES:
    _mean(f"covariance_{_name}", lambda u, x, y, e=_name: predictors.predict_covariance(u, x, y, e, min_periods=3))


def _models(spark, d):
    u, x, y = _inputs(spark, d)
    cov = predictors.predict_covariance(u, x, y, "shrinkage", min_periods=3)
    cov = cov.with_df(cov.df.withColumn("cov", F.col("cov") / 1000))
    m = predictors.predict_mean(u, x, y)
    return u, m.derive(F.col("v") / 100), cov, y.derive(F.col("v") / 100)


def _portfolio(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: out(f(*_models(spark, d)))


_portfolio("minimum_variance", lambda u, m, c, y: portfolios.minimum_variance(u, c))
_portfolio("minimum_variance_long_short", lambda u, m, c, y: portfolios.minimum_variance(u, c, long_only=False))
for _name, _bound in (("min_variance_given_return", 0.0), ("max_return_given_std_dev", 0.1), ("min_mean_variance", 1.0), ("min_mean_std_dev", 1.0)):
    _portfolio(f"markowitz_{_name}", lambda u, m, c, y, mode=_name, b=_bound: portfolios.markowitz_portfolio(u, m, c, mode, b))
_portfolio("markowitz_std", lambda u, m, c, y: portfolios.markowitz_std(u, m, c))
_portfolio("log_likelihood", lambda u, m, c, y: metrics.log_likelihood(c, y))
_portfolio("minimum_variance_metric", lambda u, m, c, y: metrics.minimum_variance_metric(c, y))


def market(spark, d) -> DataFrame:
    """Monthly mean unit prices by brand, with weights by rank of the last change every third month."""
    p = panel(spark, d)
    prices = p.df.select(F.col("brand").alias("entity"), "ts", (F.col("v") * 0.99).alias("open"), F.col("v").alias("close"), F.lit(1000.0).alias("volume"), F.lit(1.0).alias("adjust"))
    w = portfolios.rank_linear(mu(spark, d), 0.3).df
    month = F.expr("month(timestamp_micros(ts))")
    weights = w.where((month % 3 == 0) & (F.col("v") > 0)).select(F.lit("rank").alias("strategy"), "ts", F.col("brand").alias("entity"), F.col("v").alias("w"))
    return traders.market_rows(prices, weights)


def _trader(name: str, f) -> None:
    QUERIES[name] = lambda spark, d: f(market(spark, d)).select("strategy", F.col("ts").alias("us"), F.round("holdings", 4).alias("holdings"), F.round("cash", 4).alias("cash"))


_trader("benchmark", lambda rows: traders.benchmark(rows, 1e9))
_trader("simple_trader", lambda rows: traders.simple_trader(rows, 1e9, fee_base=5.0, fee_rate=0.001))
_trader("random_trader", lambda rows: traders.random_trader(rows, 1e9, 5, seed=7, fee_rate=0.001))


# --- pipelines ---


@query("bollinger", PRICE + "SELECT brand, us, ROUND(m, 4) AS mean, ROUND(m + 2 * s, 4) AS upper, ROUND(m - 2 * s, 4) AS lower FROM (SELECT brand, us, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, row_number() OVER (PARTITION BY brand ORDER BY us) AS n FROM s WINDOW w AS (PARTITION BY brand ORDER BY us ROWS 11 PRECEDING)) WHERE n >= 12")
def bollinger(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", us("date_trunc('month', l_shipdate)").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    n = Node(li.join(part, "l_partkey").groupBy("brand", "ts").agg(F.avg("x").alias("v")), "ts", ("brand",))
    df = align.merge_latest(rolling.rolling_mean(n, 12).renamed("m"), rolling.rolling_variance(n, 12).renamed("s2"))
    s = ieee.sqrt(F.greatest("s2", F.lit(0.0)))
    return df.select("brand", F.col("ts").alias("us"), F.round("m", 4).alias("mean"), F.round(F.col("m") + 2 * s, 4).alias("upper"), F.round(F.col("m") - 2 * s, 4).alias("lower"))


@query("mean_strategy")
def mean_strategy(spark, d):
    """Rank portfolio, benchmark fill, then Sharpe ratio and drawdown of its value."""
    run = traders.benchmark(market(spark, d), 1e9)
    n = Node(run.select("strategy", "ts", (F.col("holdings") + F.col("cash")).alias("v")), "ts", ("strategy",))
    df = align.merge_latest(metrics.sharpe_ratio(n).renamed("sharpe"), metrics.drawdown(n).renamed("drawdown"))
    return df.select("strategy", F.col("ts").alias("us"), tidy("sharpe").alias("sharpe"), tidy("drawdown").alias("drawdown"))


def _worth(spark, d, positions: Node) -> Node:
    """The value of each strategy filled without costs, event types being the stocks."""
    prices = daily(spark, d).df.select(F.col("event_type").alias("entity"), "ts", (F.col("v") * 0.99).alias("open"), F.col("v").alias("close"), F.lit(1000.0).alias("volume"), F.lit(1.0).alias("adjust"))
    weights = positions.df.select("strategy", "ts", F.col("event_type").alias("entity"), F.col("v").alias("w"))
    run = traders.benchmark(traders.market_rows(prices, weights), 1e6)
    return Node(run.select("strategy", "ts", (F.col("holdings") + F.col("cash")).alias("v")), "ts", ("strategy",))


#: Risk aversions of the frontier.
AVERSIONS = [0.0, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0]


def _frontier(spark, d) -> tuple[Node, Node, Node]:
    u, m, c, _ = _models(spark, d)
    return portfolios.optimised_all(u, c, m, {f"{a:04.1f}": lambda m, s, a=a: portfolios.markowitz(m, s, "min_mean_std_dev", a) for a in AVERSIONS}), m, c


@query("mean_variance_frontier")
def mean_variance_frontier(spark, d):
    """Expected return and deviation of the portfolio of each risk aversion at each rebalancing."""
    return out(portfolios.frontier_points(*_frontier(spark, d)))


@query("mean_variance_strategy")
def mean_variance_strategy(spark, d):
    """Value, Sharpe ratio, drawdown and compound return of each risk aversion."""
    value = _worth(spark, d, _frontier(spark, d)[0])
    value = value.with_df(value.df.persist())  # a row for each strategy and tick, read four times
    parts = [value, metrics.sharpe_ratio(value), metrics.drawdown(value), metrics.compound_return(value)]
    names = ["value", "sharpe", "drawdown", "compound"]
    df = align.merge_latest(*[n.renamed(name) for n, name in zip(parts, names, strict=True)])
    return df.select("strategy", F.col("ts").alias("us"), *[tidy(name).alias(name) for name in names])


@query("stream_rolling_mean", ORACLES["rolling_mean"])
def stream_rolling_mean(spark, d):
    """The same as rolling_mean, by the stateful stream over what is there."""
    from tickloom.streaming import live

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern may find one file or a folder of them
    src = src.select("user_id", F.timestamp_micros(us("ts")).alias("ts"), F.col("value").alias("v"))
    name = f"stream_rolling_mean_{abs(hash(d))}"
    done = live.run_available(live.rolling_mean(src, "user_id", 10), name)
    return done.select("user_id", F.unix_micros("ts").alias("us"), tidy("v").alias("v"))


