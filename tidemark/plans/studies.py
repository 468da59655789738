"""More market queries: networks and bets, coverage, flexible grids, volume clocks, and the streaming forms run to their end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.shared import shared_folder
from ..operators import bars as B, evaluation, fits, grid, micro, portfolio, signals as S, stats, swings
from ..sources import klines
from ..streaming import jobs
from .queries import DAILY, GAPS, NORMED, RET, SWINGS, TCB_RECURSIVE, X_IMPACT, cdf_sql, daily, forecasts, pivots, returns, swings_sql
from .registry import query, r, rounded
from .views import BARS, TRADES, bars, table, trades

# ---- sources


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::TIMESTAMP AS day FROM orders UNION ALL SELECT -1, NULL")
def days_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as YYYYMMDD and read back; text that is none gives null."""
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("t"))
    return text.unionByName(spark.range(1).select(F.lit(-1).cast(text.schema["o_orderkey"].dataType).alias("o_orderkey"), F.lit("2024x").alias("t"))).select("o_orderkey", klines.utc_day(F.col("t")).cast("timestamp_ntz").alias("day"))


@query("SELECT c_custkey, 'monthly' AS period, 'S' || c_custkey AS symbol, '1h' AS interval, '2024-0' || (c_custkey % 9 + 1) AS stamp FROM customer")
def archive_parts(spark: SparkSession, d: str) -> DataFrame:
    """URLs of archive files taken apart."""
    stamp = F.concat(F.lit("2024-0"), (F.col("c_custkey") % 9 + 1).cast("string"))
    name = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    url = F.concat(F.lit("https://host/data/monthly/"), name, F.lit("/1h/"), name, F.lit("-1h-"), stamp, F.lit(".zip"))
    return table(spark, d, "customer").select("c_custkey", *[c.alias(k) for k, c in klines.file_parts(url).items()])


@query(f"WITH {TRADES} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, count(*) AS n, sum(volume)::DOUBLE AS volume, round(avg(price), 6) + 0.0 AS mean, round(max(price) - min(price), 6) + 0.0 AS span FROM trades GROUP BY 1, 2")
def bars_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Bars with aggregates of the caller's own."""
    own = {"n": F.count("*"), "volume": F.sum("volume").cast("double"), "mean": F.avg("price"), "span": F.max("price") - F.min("price")}
    return rounded(B.resample(trades(spark, d), "4h", aggregates=own))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN 'NaN'::DOUBLE ELSE p_retailprice::DOUBLE END AS v, p_retailprice::DOUBLE + p_partkey % 3 AS w FROM part)
SELECT p_partkey, coalesce(isfinite(v), false) AS finite, coalesce(isfinite(v) AND abs(v - w) <= 1e-3 * greatest(abs(v), abs(w)), false) OR coalesce(v = w, false) AS near FROM x""")
def finite_and_close(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.lit(None).cast("double")).when(k == 1, float("inf")).when(k == 2, float("nan")).otherwise(F.col("p_retailprice").cast("double"))
    w = F.col("p_retailprice").cast("double") + F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", special.is_finite(v).alias("finite"), special.is_close(v, w, 1e-3).alias("near"))


# ---- clocks and flow


@query(f"""WITH {TRADES}, i AS (SELECT symbol, ts, sum(volume)::BIGINT AS v FROM trades WHERE volume > 0 GROUP BY 1, 2), c AS (SELECT symbol, ts, sum(v) OVER w AS c1, sum(v) OVER w - v AS c0 FROM i WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT symbol, ts, unnest(range(greatest(ceil(c0 / 2000.0), 1)::BIGINT, ceil(c1 / 2000.0)::BIGINT)) - 1 AS k FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY k) AS m FROM x), t AS (SELECT *, dense_rank() OVER (ORDER BY ts, m) AS tau FROM e),
n AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts, seq) AS c1 FROM trades WHERE volume > 0), p AS (SELECT *, c1 - volume AS c0, unnest(range((c1 - volume)::BIGINT // 2000, (c1 - 1)::BIGINT // 2000 + 1)) AS k FROM n),
o AS (SELECT symbol, k, sum(price * (least(c1, (k + 1) * 2000) - greatest(c0, k * 2000))) / 2000 AS price FROM p GROUP BY 1, 2) SELECT tau::BIGINT AS tau, symbol, k, round(price, 6) + 0.0 AS price, ts FROM t JOIN o USING (symbol, k)""")
def bars_synchronised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.synchronised_volume_bars(trades(spark, d), 2000))


@query(f"""WITH {TRADES}, p AS (SELECT symbol, date_trunc('day', ts) AS day, participant, sum(volume * price) FILTER (side = 'buy') AS b, sum(volume) FILTER (side = 'sell') AS s FROM trades GROUP BY 1, 2, 3), c AS (SELECT *, s::DOUBLE / nullif(sum(s) OVER (PARTITION BY symbol, day), 0) AS share FROM p),
f AS (SELECT x.day, y.participant AS seller, x.participant AS buyer, sum(x.b * y.share) AS flow FROM c x JOIN c y ON x.symbol = y.symbol AND x.day = y.day WHERE x.b IS NOT NULL AND y.s IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT *, flow / sum(flow) OVER (PARTITION BY day) AS share FROM f),
k AS (SELECT d.day, m.seller, m.buyer, coalesce(g.share, 0) AS share FROM (SELECT DISTINCT day FROM f) d CROSS JOIN (SELECT DISTINCT seller, buyer FROM f) m LEFT JOIN g USING (day, seller, buyer)) SELECT seller, buyer, round(median(share), 6) + 0.0 AS share FROM k GROUP BY 1, 2""")
def flow_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(micro.median_flow(trades(spark, d).withColumn("day", F.date_trunc("day", "ts")), ["symbol"]))


MINUTES = f"""WITH {TRADES}, m AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_max(price, (ts, seq)) AS mid, min(price) AS bid, max(price) AS ask, coalesce(sum(volume) FILTER (side = 'buy'), 0)::DOUBLE AS bought, coalesce(sum(volume) FILTER (side = 'sell'), 0)::DOUBLE AS sold FROM trades GROUP BY 1, 2)"""


@query(MINUTES + " SELECT symbol, ts, round(abs(ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY ts))), 6) + 0.0 AS abs_ret, bought + sold AS volume, round(ask - bid, 6) + 0.0 AS spread, round(bought / nullif(bought + sold, 0), 6) + 0.0 AS imbalance FROM m")
def order_quantities(spark: SparkSession, d: str) -> DataFrame:
    size = lambda side: F.sum(F.when(F.col("side") == side, F.col("volume")).otherwise(0)).cast("double")
    own = {"mid": F.max_by("price", F.struct("ts", "seq")), "bid": F.min("price"), "ask": F.max("price"), "bought": F.coalesce(size("buy"), F.lit(0.0)), "sold": F.coalesce(size("sell"), F.lit(0.0))}
    return rounded(micro.basic_quantities(B.resample(trades(spark, d), "15m", aggregates=own)).select("symbol", "ts", "abs_ret", "volume", "spread", "imbalance"))


PROFILE = f"""WITH {BARS}, l AS (SELECT 1.5 * avg(volume) AS level, avg(volume) AS mean FROM bars), e AS (SELECT symbol, bar_idx FROM bars, l WHERE volume > level), p AS (SELECT b.bar_idx - e.bar_idx AS o, avg(b.volume / mean) AS mean FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx BETWEEN e.bar_idx - 5 AND e.bar_idx + 10, l GROUP BY 1)"""


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean volume, over the mean of all bars, around bars of 1.5 times that mean."""
    b = bars(spark, d)
    b = b.crossJoin(F.broadcast(b.agg(F.avg("volume").alias("level")))).withColumn("volume", F.col("volume") / F.col("level"))
    e = b.where("volume > 1.5").select("symbol", F.col("bar_idx").alias("event_id"), F.col("bar_idx").alias("minute"))
    return micro.event_average(e, b.select("symbol", F.col("bar_idx").alias("minute"), "volume"), "volume", 5, 10)


@query(PROFILE + ' SELECT arg_max(o, (round(mean, 9), -o)) AS t_max, round(max(mean), 6) + 0.0 AS peak FROM p')
def event_peak(spark: SparkSession, d: str) -> DataFrame:
    return rounded(micro.peak(profile(spark, d)))


@query(PROFILE + " SELECT round(-regr_slope(ln(mean - 1), ln(o)), 5) + 0.0 AS alpha, round(exp(regr_intercept(ln(mean - 1), ln(o))), 5) + 0.0 AS prefactor FROM p WHERE o >= 1 AND mean > 1")
def event_relaxation(spark: SparkSession, d: str) -> DataFrame:
    made = micro.relaxation(profile(spark, d))
    return made.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in made.columns])


@query(f"""WITH {TRADES}, e AS (SELECT symbol, side, epoch_us(ts) / 6e7 AS t, seq FROM trades), h AS (SELECT a.symbol, a.side AS channel, a.t, a.seq, coalesce(sum(exp(-0.05 * (a.t - b.t))) FILTER (b.side = 'buy'), 0) AS b, coalesce(sum(exp(-0.05 * (a.t - b.t))) FILTER (b.side = 'sell'), 0) AS s FROM e a LEFT JOIN e b ON a.symbol = b.symbol AND (b.t, b.seq) < (a.t, a.seq) GROUP BY ALL)
SELECT symbol, channel, seq, round(0.1 + 0.05 * (0.5 * b + 0.2 * s), 6) + 0.0 AS lambda_buy, round(0.2 + 0.05 * 0.4 * s, 6) + 0.0 AS lambda_sell FROM h""")
def hawkes_channels(spark: SparkSession, d: str) -> DataFrame:
    """Intensities of both sides: sales feed both, buys only themselves."""
    t = trades(spark, d).select("symbol", F.col("side").alias("channel"), (F.unix_micros("ts") / 6e7).alias("t"), "seq")
    nu = {("buy", "buy"): 0.5, ("buy", "sell"): 0.2, ("sell", "sell"): 0.4}
    return rounded(micro.hawkes_cross(t, {"buy": 0.1, "sell": 0.2}, nu, 0.05).drop("t"))


SCHEMES = {"uniform": "1", "imbalance": "abs(ret)", "volume": "ln(1 + volume)", "nominal": "ln(1 + close * volume)", "relative": "ln(1 + volume / 1000)", "weighted": "ln(1 + volume) * (1 + abs(ret))"}
BETS = DAILY + f""", g AS (SELECT *, ntile(5) OVER (PARTITION BY day ORDER BY abs(ret), symbol) AS grade FROM z WHERE ret <> 0 AND fwd IS NOT NULL),
p AS (SELECT scheme, q, day, sum(bet * sign(ret) * fwd) / nullif(sum(bet), 0) AS pnl, count(*) AS n FROM (SELECT *, unnest(range(1, grade + 1)) AS q FROM g) k, LATERAL (VALUES {", ".join(f"('{n}', ({x})::DOUBLE)" for n, x in SCHEMES.items())}) b(scheme, bet) GROUP BY 1, 2, 3)"""


def bet_days(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d).where("ret is not null and fwd is not null")
    volume, gain, log = F.col("volume"), F.abs("ret"), special.ln
    # SCHEMES in columns: a nominal of a negative price has no logarithm, which is NaN
    sizes = {"uniform": F.lit(1.0), "imbalance": gain, "volume": log(1 + volume), "nominal": log(1 + F.col("close") * volume), "relative": log(1 + volume / 1000), "weighted": log(1 + volume) * (1 + gain)}
    return micro.bet_portfolios(x, "ret", "fwd", "day", {name: sizes[name] for name in SCHEMES})


@query(BETS + " SELECT scheme, q::INT AS q, day, round(pnl, 9) + 0.0 AS pnl, n FROM p")
def bet_schemes(spark: SparkSession, d: str) -> DataFrame:
    return bet_days(spark, d).withColumns({"pnl": F.round("pnl", 9) + F.lit(0.0), "day": F.col("day").cast("timestamp_ntz")})


@query(BETS + """, m AS (SELECT *, pnl - avg(pnl) OVER (PARTITION BY scheme, q) AS e FROM p), s AS (SELECT scheme, q, count(*) AS days, avg(pnl) / stddev_samp(pnl) AS sr, avg(pnl) AS mean, avg((pnl > 0)::INT) AS pi, avg(e ** 3) / avg(e * e) ** 1.5 AS sk, avg(e ** 4) / avg(e * e) ** 2 AS ku FROM m GROUP BY 1, 2)
SELECT scheme, q::INT AS q, days, round(sr * sqrt(252), 5) + 0.0 AS sharpe, round(mean * 1e4, 5) + 0.0 AS ppd_bp, round(greatest(pi, 1 - pi), 5) + 0.0 AS hit_rate, round(sr / sqrt((1 - sk * sr + (ku - 1) * sr * sr / 4) / (days - 1)), 5) + 0.0 AS stat FROM s""")
def bet_significance(spark: SparkSession, d: str) -> DataFrame:
    made = micro.bet_report(bet_days(spark, d))
    return made.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("sharpe", "ppd_bp", "hit_rate", "stat")})


def impact(spark: SparkSession, d: str, level: float) -> DataFrame:
    x = daily(spark, d)
    return micro.cross_impact(x.where("ret is not null").select("day", "symbol", F.col("ret").alias("signal")), x.where("fwd is not null").select("day", "symbol", F.col("fwd").alias("ret")), "day", level)


@query(DAILY + X_IMPACT + """, e AS (SELECT i, j, coalesce(abs(z) >= 0.5, false) AS edge FROM c), s AS (SELECT count(*) FILTER (edge) AS edges, count(*) FILTER (edge AND i = j) AS loops, (SELECT count(*) FROM (SELECT i FROM e UNION SELECT j FROM e)) AS nodes, (SELECT count(*) FROM e x JOIN e y ON x.i = y.j AND x.j = y.i AND x.i < x.j AND x.edge AND y.edge) AS both_ways FROM e)
SELECT edges, loops, nodes, both_ways, round(edges / (nodes * nodes), 6) + 0.0 AS density, round(edges / nodes, 6) + 0.0 AS loops_expected, round(nodes * (nodes - 1) / 2 * (edges / (nodes * nodes)) ** 2, 6) + 0.0 AS both_expected FROM s""")
def impact_topology(spark: SparkSession, d: str) -> DataFrame:
    return rounded(micro.topology(impact(spark, d, 0.5)))


DEGREES = DAILY + X_IMPACT + """, e AS (SELECT i, j, coalesce(abs(z) >= 0.5, false) AS edge FROM c), g AS (SELECT v, n_in, n_out, count(*) OVER () AS n FROM (SELECT j AS v, count(*) FILTER (edge) AS n_in FROM e GROUP BY 1) JOIN (SELECT i AS v, count(*) FILTER (edge) AS n_out FROM e GROUP BY 1) USING (v)),
t AS (SELECT abs(a.n_in - b.n_in) / a.n / nullif(sqrt((a.n_in + b.n_in) / (2 * a.n) * (1 - (a.n_in + b.n_in) / (2 * a.n)) / (2 * a.n)), 0) AS ti, abs(a.n_out - b.n_out) / a.n / nullif(sqrt((a.n_out + b.n_out) / (2 * a.n) * (1 - (a.n_out + b.n_out) / (2 * a.n)) / (2 * a.n)), 0) AS tout FROM g a JOIN g b ON a.v < b.v)"""


@query(DEGREES + " SELECT round(avg((coalesce(ti, 0) > 1)::INT), 6) + 0.0 AS differ_in, round(avg((coalesce(tout, 0) > 1)::INT), 6) + 0.0 AS differ_out FROM t")
def impact_degree_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(micro.degree_tests(impact(spark, d, 0.5), 1.0))


@query(f"WITH {TRADES} SELECT DISTINCT ts FROM trades")
def trading_times(spark: SparkSession, d: str) -> DataFrame:
    """All times at which any symbol trades."""
    return trades(spark, d).select(F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()


# ---- statistics


@query(GAPS + ", s AS (SELECT tau / avg(tau) OVER (PARTITION BY symbol, q) AS x FROM o) SELECT floor(x / 0.5)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1")
def recurrence_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of scaled gaps, all thresholds pooled."""
    gaps = stats.recurrence_intervals(bars(spark, d), "volume", [500.0, 700.0])
    return stats.pooled_intervals(gaps).groupBy(F.floor(F.col("scaled") / 0.5).alias("bin")).agg(F.count("*").alias("n"))


@query(GAPS + """, k AS (SELECT lead(tau) OVER (PARTITION BY symbol, q ORDER BY bar_idx) / avg(tau) OVER (PARTITION BY symbol, q) AS nxt, ntile(4) OVER (PARTITION BY symbol, q ORDER BY tau, bar_idx) AS part FROM o), c AS (SELECT part::INT AS part, floor(nxt / 0.5)::BIGINT AS bin, count(*) AS n FROM k WHERE nxt IS NOT NULL GROUP BY 1, 2)
SELECT part, bin, n, round(n / sum(n) OVER (PARTITION BY part) / 0.5, 6) + 0.0 AS density FROM c""")
def recurrence_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fits.conditional_density(stats.recurrence_intervals(bars(spark, d), "volume", [500.0, 700.0])))


@query(RET + ", g AS (SELECT symbol, q::DOUBLE AS q, abs(ret) AS a, lead(abs(ret)) OVER (PARTITION BY symbol, q ORDER BY bar_idx) AS b FROM y, (VALUES (500), (700)) t(q) WHERE volume > q) SELECT symbol, q, l::DOUBLE AS level, count(*) AS n, round(avg((a > l AND b > l)::INT), 6) + 0.0 AS p FROM g, (VALUES (0.0), (0.001), (0.003)) v(l) WHERE b IS NOT NULL GROUP BY 1, 2, 3")
def recurrence_joint(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.joint_recurrence(returns(spark, d), "volume", "ret", [500.0, 700.0], [0.0, 0.001, 0.003]))


@query(RET + """, t AS (SELECT c AS x_min, abs(ret) AS x FROM y, (VALUES (0.002::DOUBLE), (0.003), (0.004), (0.006)) g(c) WHERE abs(ret) >= c), f AS (SELECT x_min, count(*) AS n, 1 + count(*) / sum(ln(x / x_min)) AS delta FROM t GROUP BY 1 HAVING count(*) >= 10),
k AS (SELECT t.x_min, n, delta, count(*) OVER (PARTITION BY t.x_min ORDER BY x) / n AS b, (count(*) OVER (PARTITION BY t.x_min ORDER BY x) - count(*) OVER (PARTITION BY t.x_min, x)) / n AS a, 1 - (x / t.x_min) ** (1 - delta) AS m FROM t JOIN f USING (x_min)),
s AS (SELECT x_min, n, delta, max(greatest(abs(b - m), abs(a - m))) AS ks FROM k GROUP BY 1, 2, 3) SELECT x_min, n, round(delta, 6) + 0.0 AS delta, round(ks, 6) + 0.0 AS ks FROM s ORDER BY ks, x_min LIMIT 1""")
def power_law_best(spark: SparkSession, d: str) -> DataFrame:
    """The fit of the cutoff that lies nearest to its law."""
    tails = stats.power_law(returns(spark, d).withColumn("x", F.abs("ret")), "x", [0.002, 0.003, 0.004, 0.006])
    return rounded(stats.best_cutoff(tails))


@query(NORMED + """, l AS (SELECT symbol, l AS lag, g, lag(v, l::INT) OVER (PARTITION BY symbol, l ORDER BY bar_idx) AS v FROM n, range(0, 4) t(l)), t AS (SELECT symbol, lag, floor((v + 3) / 0.2) AS bin, max(g) AS top FROM l WHERE v >= -3 AND v < 3 GROUP BY 1, 2, 3),
e2 AS (SELECT symbol, lag, corr(-3 + (bin + 0.5) * 0.2, top) AS lmv, count(*) AS bins FROM t GROUP BY 1, 2), c AS (SELECT symbol, lag, corr(g, v) AS c FROM l GROUP BY 1, 2) SELECT symbol, lag::INT AS lag, round(lmv, 6) + 0.0 AS lmv, bins, round(c, 6) + 0.0 AS corr FROM e2 JOIN c USING (symbol, lag)""")
def largest_volatility_lagged(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.lagged_lmv(stats.normalise_volume(bars(spark, d)), "v", "g", 3))


@query(NORMED + """, s AS (SELECT c, floor(g / 0.25)::BIGINT AS bin, count(*) AS n FROM n, (VALUES (-1.25::DOUBLE), (-0.75), (-0.25), (0.25), (0.75), (1.25)) t(c) WHERE v >= c - 0.25 AND v < c + 0.25 GROUP BY 1, 2), d AS (SELECT *, n / sum(n) OVER (PARTITION BY c) / 0.25 AS density FROM s)
SELECT c AS centre, bin, n, round(density, 6) + 0.0 AS density, round((bin + 0.5) * 0.25 / (c + 4.5), 6) + 0.0 AS x, round((c + 4.5) * density, 6) + 0.0 AS y, round(((bin + 0.5) * 0.25) ** -(0.4 * c - 2.5) * exp(-(-1.23 * c + 3) * (bin + 0.5) * 0.25), 6) + 0.0 AS law FROM d""")
def volatility_given_volume(spark: SparkSession, d: str) -> DataFrame:
    """Scaled densities of volatility in slices of volume, beside the published law (not normalised)."""
    made = stats.density_collapse(stats.normalise_volume(bars(spark, d)), "v", "g", [-1.25, -0.75, -0.25, 0.25, 0.75, 1.25])
    return rounded(made.withColumn("law", stats.cutoff_density(F.col("centre"), (F.col("bin") + 0.5) * 0.25)))


@query(RET + """, d AS (SELECT *, bar_idx >= 100 AS live FROM y), p AS (SELECT symbol, live, avg(ret) / stddev_samp(ret) * sqrt(252) * 0.1 AS r FROM d GROUP BY 1, 2), w AS (SELECT symbol, max(r) FILTER (NOT live) AS pf, max(r) FILTER (live) AS lv FROM p GROUP BY 1)
SELECT symbol, round(pf, 6) + 0.0 AS proforma, round(lv, 6) + 0.0 AS live, round(lv - pf, 6) + 0.0 AS decay, round(0.137 * 100 * pf - 5 * 1.5, 5) + 0.0 AS expected FROM w""")
def strategy_decay(spark: SparkSession, d: str) -> DataFrame:
    """Volatility-adjusted return before and after bar 100, and what the haircut rule expects at a z-score of 1.5."""
    made = evaluation.decay(returns(spark, d), "ret", F.col("bar_idx") >= 100)
    return rounded(made.withColumn("expected", F.round(evaluation.haircut(100 * F.col("proforma"), F.lit(1.5)), 5)))


@query(RET + """, h AS (SELECT symbol, ts, (ret < avg(ret) OVER k - 1.2816 * stddev_pop(ret) OVER k)::INT AS h FROM y WINDOW k AS (PARTITION BY symbol)), l AS (SELECT symbol, h, lag(h) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM h),
n AS (SELECT symbol, count(*) AS n, sum(h)::BIGINT AS hits, count(*) FILTER (b = 0 AND h = 0)::DOUBLE AS a, count(*) FILTER (b = 0 AND h = 1)::DOUBLE AS b, count(*) FILTER (b = 1 AND h = 0)::DOUBLE AS c, count(*) FILTER (b = 1 AND h = 1)::DOUBLE AS d FROM l GROUP BY 1),
e AS (SELECT *, b / (a + b) AS p0, d / nullif(c + d, 0) AS p1, (b + d) / (a + b + c + d) AS p FROM n)
SELECT symbol, n, hits, round(2 * (CASE WHEN hits < n THEN (n - hits) * ln(1 - hits / n) ELSE 0 END + CASE WHEN hits > 0 THEN hits * ln(hits / n) ELSE 0 END - (n - hits) * ln(0.9) - hits * ln(0.1)), 6) + 0.0 AS lr_coverage,
round(2 * (CASE WHEN a > 0 THEN a * ln(1 - p0) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(p0) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(1 - p1) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(p1) ELSE 0 END - CASE WHEN a + c > 0 THEN (a + c) * ln(1 - p) ELSE 0 END - CASE WHEN b + d > 0 THEN (b + d) * ln(p) ELSE 0 END), 6) + 0.0 AS lr_independence FROM e""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of a normal 10 % value at risk: their share and whether they cluster."""
    k = Window.partitionBy("symbol")
    rows = returns(spark, d).withColumn("low", F.avg("ret").over(k) - 1.2816 * F.stddev_pop("ret").over(k))
    return rounded(evaluation.coverage_tests(rows, F.col("ret") < F.col("low"), 0.1))


@query(RET + ", m AS (SELECT symbol, count(*) AS n, avg(ret) AS m, var_pop(ret) AS v FROM y GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS g FROM m) SELECT count(*) AS groups, sum(n)::BIGINT AS n, round(sum(n * (m - g) ** 2) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) + 0.0 AS f FROM m, t")
def return_anova(spark: SparkSession, d: str) -> DataFrame:
    """Whether mean returns differ by symbol."""
    return rounded(stats.anova(returns(spark, d), "ret", "symbol"))


@query(f"""WITH {BARS} SELECT symbol, bar_idx, round(0.04 - 2.0 / 100 * (1 + bar_idx % 3), 6) + 0.0 AS r2_out, round(0.5 - 2.0 * (1 + bar_idx % 3) / 100 * 0.75 ** 1.5, 6) + 0.0 AS sharpe_out FROM bars""")
def penalised_sharpe(spark: SparkSession, d: str) -> DataFrame:
    made = evaluation.covariance_penalty(F.lit(0.04), F.lit(100.0), (1 + F.col("bar_idx") % 3).cast("double"), F.lit(0.5))
    return rounded(bars(spark, d).select("symbol", "bar_idx", *[c.alias(k) for k, c in made.items()]))


@query(f"""WITH {BARS} SELECT symbol, bar_idx, CASE WHEN low > close THEN -1 WHEN low < close THEN 1 ELSE 0 END AS signal FROM bars""")
def low_close_signals(spark: SparkSession, d: str) -> DataFrame:
    """1 where the low lies below the close, -1 above, 0 on it."""
    return bars(spark, d).select("symbol", "bar_idx", F.signum(F.col("close") - F.col("low")).cast("int").alias("signal"))


@query(RET + """, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM y), d AS (SELECT symbol, path, d * 10 + o + 1 AS step, ('0x' || substr(md5(concat_ws('|', symbol, path, d, 7)), 1, 15))::BIGINT % (n - 9) + o AS i FROM (SELECT symbol, any_value(n) AS n FROM k GROUP BY 1), range(20) p(path), range(5) q(d), range(10) r(o))
SELECT symbol, path::INT AS path, step::INT AS step, round(100 * exp(sum(ret) OVER (PARTITION BY symbol, path ORDER BY step)), 6) + 0.0 AS value FROM d JOIN k USING (symbol, i)""")
def scenario_paths(spark: SparkSession, d: str) -> DataFrame:
    """Twenty paths of fifty steps per symbol from blocks of its own returns."""
    return rounded(evaluation.scenario_paths(returns(spark, d), "ret", 20, 50, 10))


@query(DAILY + ", e AS (SELECT *, ntile(4) OVER (PARTITION BY day ORDER BY volume, symbol) AS part FROM z WHERE fwd IS NOT NULL) SELECT part::INT AS part, count(*) AS n, round(avg(abs(fwd)), 9) + 0.0 AS spread FROM e GROUP BY 1")
def volume_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Size of the next day's move by each day's quarters of volume."""
    w = Window.partitionBy("day").orderBy("volume", "symbol")
    x = daily(spark, d).where("fwd is not null").withColumn("part", F.ntile(4).over(w))
    return x.groupBy("part").agg(F.count("*").alias("n"), (F.round(F.avg(F.abs("fwd")), 9) + F.lit(0.0)).alias("spread"))


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS chain, p_retailprice::DOUBLE AS s, p_retailprice::DOUBLE * (0.8 + (p_partkey % 7) * 0.05::DOUBLE) AS k, 0.2 + (p_partkey % 3) * 0.1::DOUBLE AS sigma FROM part), q AS (SELECT *, (ln(s / k) + (0.02 + sigma * sigma / 2) * 0.5) / (sigma * sqrt(0.5)) AS d1 FROM p), c AS (SELECT *, {cdf_sql('d1')} AS delta FROM q),
b AS (SELECT *, ntile(4) OVER (PARTITION BY chain ORDER BY round(delta, 9), p_partkey) AS bucket FROM c) SELECT chain, bucket::INT AS bucket, count(*) AS n, round(avg(delta), 6) + 0.0 AS delta, round(avg(sigma), 6) + 0.0 AS sigma FROM b GROUP BY 1, 2""")
def option_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Options of each chain in quarters of their delta."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").select(key, (key % 5).alias("chain"), F.col("p_retailprice").cast("double").alias("s"))
    rows = p.withColumns({"k": F.col("s") * (F.lit(0.8) + (key % 7) * 0.05), "sigma": F.lit(0.2) + (key % 3) * 0.1})
    priced = rows.withColumns(special.black_scholes(F.col("s"), F.col("k"), F.lit(0.5), F.lit(0.02), F.col("sigma")))
    graded = priced.withColumn("bucket", F.ntile(4).over(Window.partitionBy("chain").orderBy(F.round("delta", 9), "p_partkey")))
    return rounded(graded.groupBy("chain", "bucket").agg(F.count("*").alias("n"), F.avg("delta").alias("delta"), F.avg("sigma").alias("sigma")))


# ---- grids and accounts


@query("SELECT p_partkey, n::INT AS n, i::INT AS i, round(p + i * 3 * p / n, 6) + 0.0 AS even, round(p * 4.0 ** (i / n), 6) + 0.0 AS ratio FROM (SELECT p_partkey, p_retailprice::DOUBLE AS p FROM part) x, (VALUES (5), (10)) t(n), range(0, 11) g(i) WHERE i <= n")
def spaced_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grids of equal distance and of equal ratio from each part's price to four times it."""
    p = F.col("p_retailprice").cast("double")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.arrays_zip(grid.spaced_levels(p, 4 * p, n, False).alias("even"), grid.spaced_levels(p, 4 * p, n, True).alias("ratio")).alias("levels")) for n in (5, 10)]))
    rows = table(spark, d, "part").select("p_partkey", kinds.alias("g")).select("p_partkey", "g.n", F.posexplode("g.levels").alias("i", "x"))
    return rows.select("p_partkey", "n", "i", r(F.col("x.even"), "even"), r(F.col("x.ratio"), "ratio"))


@query("SELECT p_partkey, round((p0 / l) ** (1.0 / n_l), 6) + 0.0 AS ratio, round(f0 / ((p0 - (p0 - p0 / (p0 / l) ** (1.0 / n_l)) + l) / 2 * n_l + n_u * p0), 6) + 0.0 AS g_v FROM (SELECT p_partkey, p_retailprice::DOUBLE AS p0, p_retailprice::DOUBLE * 0.7 AS l, 4.0 + p_partkey % 3 AS n_l, (p_partkey % 2)::DOUBLE AS n_u, 5000.0 AS f0 FROM part) x")
def flexible_grids(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_retailprice").cast("double")
    rows = table(spark, d, "part").select(k, p.alias("p0"), (p * 0.7).alias("l"), (4.0 + k % 3).alias("n_l"), (k % 2).cast("double").alias("n_u"), F.lit(5000.0).alias("f0"))
    return rounded(grid.flexible_capital(rows).select("p_partkey", "ratio", "g_v"))


@query(TCB_RECURSIVE + """, a AS (SELECT symbol, close, signal, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM s WHERE f = 0.0002),
e AS (SELECT symbol, 0::BIGINT AS k, 30000.0::DOUBLE AS cash, 0.0::DOUBLE AS pos, 30000.0::DOUBLE AS before, 0::BIGINT AS closed, 30000.0::DOUBLE AS eq FROM (SELECT DISTINCT symbol FROM a)
UNION ALL SELECT symbol, k, c2, p2, CASE WHEN p2 = 0 THEN c2 ELSE before END, closed + won::INT, c2 + p2 * close FROM (SELECT symbol, k, close, before, closed, won, cash - z * close - abs(z) * close * 0.0008 AS c2, pos + z AS p2 FROM (
  SELECT a.symbol, a.k, a.close, e.cash, e.pos, e.before, e.closed, e.pos <> 0 AND e.cash + e.pos * a.close - e.before >= 0.001 * 30000 AS won, CASE WHEN e.pos <> 0 AND e.cash + e.pos * a.close - e.before >= 0.001 * 30000 THEN -e.pos ELSE 0 END + CASE WHEN signal = 1 THEN least(30000.0 / 13, greatest(e.cash, 0) / 1.0008) / a.close WHEN signal = -1 THEN -30000.0 / 13 / a.close ELSE 0 END AS z FROM e JOIN a ON a.symbol = e.symbol AND a.k = e.k + 1) q) w),
d AS (SELECT symbol, k, eq, 1 - eq / greatest(max(eq) OVER (PARTITION BY symbol ORDER BY k), 30000.0) AS dd FROM e WHERE k > 0) SELECT symbol, round((arg_max(eq, k) - 30000) / 30000 * 100, 4) + 0.0 AS roi, round(max(dd), 4) + 0.0 AS max_drawdown FROM d GROUP BY 1""")
def basket_profit(spark: SparkSession, d: str) -> DataFrame:
    """The portfolio whose basket closes at a profit of 0.1 % of the capital, without a stop."""
    made, off = S.trend_signals(forecasts(spark, d), "pred", 0.0002), F.lit(False)
    signals = made.select("symbol", "ts", "close", (F.col("signal") == 1).alias("entries"), off.alias("exits"), (F.col("signal") == -1).alias("short_entries"), off.alias("short_exits"))
    out = portfolio.equity_report(portfolio.simulate(signals, take_profit=0.001), 30_000.0)
    return out.select("symbol", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("roi", "max_drawdown")])


# ---- swings


@query(SWINGS + " SELECT symbol, pivot_seq, round((p3 - p2) / (p1 - p2) * 100, 6) + 0.0 AS s3, round((p4 - p2) / (p1 - p2) * 100, 6) + 0.0 AS s4 FROM tr_piv WHERE valid")
def range_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Third and fourth point of valid ranges, scaled to 0..100."""
    made = swings.scan_tr(pivots(spark, d)).where("valid").withColumn("s", B.norm100(F.col("pts")))
    return made.select("symbol", "pivot_seq", r(F.col("s")[2], "s3"), r(F.col("s")[3], "s4"))


@query("SELECT p_partkey, i::INT AS i, round(list_extract([a, a + 0.25 * (u - a), b, b + 0.25 * (u - b)], i + 1), 6) + 0.0 AS up, round(list_extract([a, a + 0.25 * (b - a), a + 0.25 * (b - a), b], i + 1), 6) + 0.0 AS filled FROM (SELECT p_partkey, p_retailprice::DOUBLE AS a, p_size::DOUBLE AS b, 5000.0 AS u FROM part) p, range(0, 4) g(i)")
def filled_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Both fillers, a quarter of the way each time."""
    a, b, quarter = F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"), lambda: F.lit(0.25)
    both = F.arrays_zip(swings.up_filler([a, b, a], F.lit(5000.0), quarter).alias("up"), swings.filler([a, b], quarter).alias("filled"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(both).alias("i", "x")).select("p_partkey", "i", r(F.col("x.up"), "up"), r(F.col("x.filled"), "filled"))


# ---- streams, run until they have read all there is


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All rows of a bounded stream, as Parquet in the folder that all executors share; its offsets and state go there too.

    In mode complete each batch replaces the rows before it, so the last is the result; in mode append batches add up.  The rows never pass the driver.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    empty = spark.createDataFrame([], df.schema)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/{k:09d}")

    writer = df.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{place}/state")
    query = writer.start()
    query.awaitTermination()
    last = query.lastProgress
    if last is None:
        return empty
    parts = [f"{place}/rows/{last['batchId']:09d}"] if mode == "complete" else [f"{place}/rows/*"]
    return spark.read.schema(df.schema).parquet(*parts)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return jobs.event_stream(spark, d, table(spark, d, "events").schema)


TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events)"


@query(f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume)::BIGINT AS volume FROM ticks GROUP BY 1, 2")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    return drained(jobs.stream_bars(ticks(spark, d), "4 hours", "60 days"), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {TICKS}, g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS new FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM g)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, sum(volume)::BIGINT AS volume FROM s GROUP BY symbol, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    made = drained(jobs.stream_sessions(ticks(spark, d), "30 minutes", "60 days"), "complete")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS open_time, max(ts) AS event_time, arg_max(price, ts) AS close, arg_max(volume, ts) AS volume FROM ticks GROUP BY 1, 2")
def stream_klines(spark: SparkSession, d: str) -> DataFrame:
    """The last update of each 4-hour kline, every trade being an update."""
    updates = ticks(spark, d).select("symbol", F.window("ts", "4 hours")["start"].alias("open_time"), F.col("ts").alias("event_time"), F.col("price").alias("close"), "volume")
    return drained(jobs.latest_klines(updates, "60 days"), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("open_time", "event_time")})


@query("WITH RECURSIVE prices AS (SELECT event_type AS symbol, event_id AS bar_idx, value AS high, value AS low FROM events), numbered AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS bar_idx, high, low FROM prices), " + swings_sql(0.9, "numbered", "piv") + " SELECT * FROM piv")
def stream_swings(spark: SparkSession, d: str) -> DataFrame:
    """Pivots of the values of each event type in order of their ids, from a stream with state."""
    rows = ticks(spark, d).select("symbol", F.col("seq").alias("bar_idx"), F.col("price").alias("high"), F.col("price").alias("low"))
    return drained(jobs.stream_zigzag(rows, 0.9), "append")


@query(f"""WITH RECURSIVE a AS (SELECT event_type AS symbol, event_id AS bar_idx, 100 + value AS close, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS signal, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
book AS (SELECT symbol, 0::BIGINT AS k, NULL::BIGINT AS bar_idx, NULL::DOUBLE AS close, NULL::INT AS signal, NULL::VARCHAR AS verdict, []::STRUCT(k BIGINT, p DOUBLE, d INT)[] AS o FROM (SELECT DISTINCT symbol FROM a)
UNION ALL SELECT symbol, k, bar_idx, close, signal, v, CASE WHEN v = 'admitted' THEN list_append(o, struct_pack(k := bar_idx, p := close, d := signal)) ELSE o END FROM (SELECT a.symbol, a.k, a.bar_idx, a.close, a.signal, b.o,
  CASE WHEN len(b.o) >= 13 THEN 'cap' WHEN len(list_filter(b.o, lambda x: x.d = a.signal AND a.bar_idx <= x.k + 15)) > 0 THEN 'time' WHEN len(list_filter(b.o, lambda x: x.d = a.signal AND abs(a.close - x.p) <= 1e-2 * a.close)) > 0 THEN 'price' ELSE 'admitted' END AS v FROM book b JOIN a ON a.symbol = b.symbol AND a.k = b.k + 1) q)
SELECT symbol, bar_idx, close AS price, signal AS direction, verdict FROM book WHERE verdict IS NOT NULL""")
def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on every event as an order, from a stream with state."""
    rows = ticks(spark, d).select("symbol", F.col("seq").alias("bar_idx"), (F.lit(100.0) + F.col("price")).alias("price"), F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).cast("int").alias("direction"))
    return drained(jobs.stream_admission(rows, 15, 1e-2, 13), "append")
