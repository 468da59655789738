"""Queries of fitted models and networks: excitation, zero-adjusted gamma laws, failure odds, ranks, sampling scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, evaluation, fits, hawkes, laws, micro, regression, waves
from ..operators.shared import stash
from .queries import DAILY, X_IMPACT, mean_responses, returns, symbol_pairs
from .registry import query, r, rounded
from .studies import impact
from .views import TRADES, table, trades

# ---- networks


def rank_sql(edges: str, nodes: str, rounds: int, damping: float = 0.85) -> str:
    """Rounds of rank over the tables e (i, j) and v (v), one after another."""
    steps = [f"e AS ({edges}), v AS ({nodes}), o AS (SELECT i, count(*) AS d FROM e GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT v, 1 / n AS rank FROM v, n)"]
    for k in range(rounds):
        steps.append(
            f"g{k} AS MATERIALIZED (SELECT j, sum(rank / d) AS got FROM r{k} JOIN e ON v = i JOIN o USING (i) GROUP BY 1), l{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE v NOT IN (SELECT i FROM o)), "
            f"r{k + 1} AS MATERIALIZED (SELECT v, {1 - damping:.6f} / n + {damping} * (coalesce(got, 0) + lost / n) AS rank FROM v CROSS JOIN n CROSS JOIN l{k} LEFT JOIN g{k} ON v = j)"
        )
    return ", ".join(steps) + f" SELECT v, round(rank, 9) + 0.0 AS rank FROM r{rounds}"


def _ranks(made: DataFrame) -> DataFrame:
    return made.select("v", (F.round("rank", 9) + F.lit(0.0)).alias("rank"))


@query(DAILY + X_IMPACT + ", " + rank_sql("SELECT i, j FROM c WHERE abs(z) >= 0.5", "SELECT i AS v FROM c UNION SELECT j FROM c", 20))
def impact_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each symbol in the network of significant impacts."""
    edges = impact(spark, d, 0.5)
    return _ranks(regression.pagerank(edges.where("edge"), edges.select(F.col("i").alias("v")).union(edges.select("j"))))


TRADE_EDGES = "SELECT DISTINCT 'C' || o_custkey AS i, 'S' || l_suppkey AS j FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer WHERE c_custkey % 2 = 0"


@query("WITH " + rank_sql(TRADE_EDGES, "SELECT 'C' || c_custkey AS v FROM customer UNION SELECT 'S' || s_suppkey FROM supplier UNION SELECT 'N' || n_nationkey FROM nation", 10))
def trade_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank in the network of customers, who point to their suppliers, these to their nations, and these to every second customer; some point nowhere."""
    # nodes are numbers in the rounds: the key, and in the last of three places its kind
    name = lambda letter, c: F.col(c).cast("long") * 3 + "CSN".index(letter)
    kind = F.element_at(F.array(*map(F.lit, "CSN")), (F.pmod("v", F.lit(3)) + 1).cast("int"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    customer, supplier, nation = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(name("C", "o_custkey").alias("i"), name("S", "l_suppkey").alias("j"))
    edges = bought.union(supplier.select(name("S", "s_suppkey"), name("N", "s_nationkey"))).union(customer.where("c_custkey % 2 = 0").select(name("N", "c_nationkey"), name("C", "c_custkey")))
    nodes = customer.select(name("C", "c_custkey").alias("v")).union(supplier.select(name("S", "s_suppkey"))).union(nation.select(name("N", "n_nationkey")))
    made = _ranks(regression.pagerank(edges, nodes, 10))
    return made.withColumn("v", F.concat(kind, F.floor(F.col("v") / 3).cast("string")))


# ---- sampling scales

SCALES = 9
FINE = f"WITH {TRADES}, m AS (SELECT symbol, epoch_us(ts) // 60000000 AS b, arg_min(price, (ts, seq)) AS first, arg_max(price, (ts, seq)) AS last FROM trades GROUP BY 1, 2), f AS (SELECT symbol, b, last - coalesce(lag(last) OVER (PARTITION BY symbol ORDER BY b), first) AS x FROM m), p AS (SELECT symbol, k, b // (1 << k) AS b, sum(x) AS x FROM f, range(0, {SCALES}) s(k) GROUP BY ALL)"


def block_returns(spark: SparkSession, d: str) -> DataFrame:
    """symbol, k, b, x: price changes in blocks of 2 ** k minutes, all scales from one pass over the changes by minute."""
    t = trades(spark, d).withColumn("b", F.floor(F.unix_micros("ts") / 60_000_000))
    minutes = t.groupBy("symbol", "b").agg(F.min_by("price", F.struct("ts", "seq")).alias("first"), F.max_by("price", F.struct("ts", "seq")).alias("last"))
    fine = minutes.select("symbol", "b", (F.col("last") - F.coalesce(F.lag("last").over(Window.partitionBy("symbol").orderBy("b")), "first")).alias("x"))
    scaled = fine.select("symbol", "b", "x", F.explode(F.sequence(F.lit(0), F.lit(SCALES - 1))).alias("k"))
    return scaled.groupBy("symbol", "k", F.expr("shiftright(b, k)").alias("b")).agg(F.sum("x").alias("x"))


@query(FINE + " SELECT symbol, k::INT AS k, count(*) AS n, round(sum(x * x) / (max(b) - min(b) + 1) / (1 << k), 6) + 0.0 AS variance FROM p GROUP BY symbol, k")
def signature_plot(spark: SparkSession, d: str) -> DataFrame:
    """Realised variance per minute against the sampling step of 2 ** k minutes; blocks without trades do not move."""
    made = block_returns(spark, d).groupBy("symbol", "k").agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("x")) / (F.max("b") - F.min("b") + 1) / F.expr("shiftleft(1, k)")).alias("variance"))
    return rounded(made)


@query(FINE + ", v AS (SELECT symbol, k, sum(x * x) AS v FROM p GROUP BY ALL), c AS (SELECT x.symbol AS i, y.symbol AS j, k, count(*) AS n, sum(x.x * y.x) AS c FROM p x JOIN p y USING (k, b) WHERE x.symbol < y.symbol GROUP BY ALL) SELECT i, j, c.k::INT AS k, n, round(c / sqrt(a.v * b.v), 6) + 0.0 AS correlation FROM c JOIN v a ON a.symbol = i AND a.k = c.k JOIN v b ON b.symbol = j AND b.k = c.k")
def epps_scales(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the price changes of each two symbols against the sampling step; they meet in the blocks in which both trade."""
    p = block_returns(spark, d)
    v = p.groupBy("symbol", "k").agg(F.sum(F.col("x") * F.col("x")).alias("v"))
    x, y = p.select(F.col("symbol").alias("i"), "k", "b", F.col("x").alias("xi")), p.select(F.col("symbol").alias("j"), "k", "b", F.col("x").alias("xj"))
    both = x.join(y, ["k", "b"]).where("i < j").groupBy("i", "j", "k").agg(F.count("*").alias("n"), F.sum(F.col("xi") * F.col("xj")).alias("c"))
    named = both.join(v.select(F.col("symbol").alias("i"), "k", F.col("v").alias("vi")), ["i", "k"]).join(v.select(F.col("symbol").alias("j"), "k", F.col("v").alias("vj")), ["j", "k"])
    return rounded(named.select("i", "j", "k", "n", (F.col("c") / F.sqrt(F.col("vi") * F.col("vj"))).alias("correlation")))


# ---- responses

X_CASES = f"""WITH {TRADES}, k AS (SELECT DISTINCT symbol FROM trades), a AS (SELECT symbol, seq, ts, CASE WHEN side = 'buy' THEN 1.0::DOUBLE ELSE -1.0 END AS e, volume::DOUBLE AS v FROM trades WHERE volume IS NOT NULL),
y AS (SELECT symbol AS j, seq, ts, unnest([{{'n': 'sign', 'y': e}}, {{'n': 'volume', 'y': v}}, {{'n': 'signed_volume', 'y': e * v}}]) AS u FROM a), z AS (SELECT j, seq, ts, u.n AS attribute, (u.y - avg(u.y) OVER w) / nullif(stddev_pop(u.y) OVER w, 0) AS y FROM y WINDOW w AS (PARTITION BY j, u.n)),
q AS (SELECT symbol AS i, ts, arg_max(price, seq) AS last, arg_min(price, seq) AS first FROM trades GROUP BY 1, 2), s AS (SELECT symbol AS i, stddev_pop(price) AS sx FROM trades GROUP BY 1),
t AS (SELECT k.symbol AS i, a.symbol AS j, a.seq, a.ts FROM a JOIN k ON k.symbol <> a.symbol), b AS (SELECT t.*, q.last AS b, q.ts AS b_at FROM t ASOF JOIN q ON t.i = q.i AND t.ts > q.ts), c AS (SELECT b.*, q.first AS a, q.ts AS a_at FROM b ASOF JOIN q ON b.i = q.i AND b.ts < q.ts),
d AS (SELECT c.i, c.j, c.seq, (a - b) / sx AS dx, count(*) OVER (PARTITION BY c.i, c.j, b_at, a_at) = 1 AS alone FROM c JOIN s ON s.i = c.i),
g AS (SELECT i, d.j, attribute, avg(dx * y) AS all_trades, avg(dx * y) FILTER (alone) AS single, avg(dx * y) FILTER (NOT alone) AS multiple, avg(alone::INT) AS weight, count(*) AS n FROM d JOIN z ON z.j = d.j AND z.seq = d.seq GROUP BY ALL)
SELECT i, j, attribute, {', '.join(f"round({c}, 6) + 0.0 AS {c}" for c in ("all_trades", "single", "multiple", "weight"))}, round(coalesce(weight * single, 0) + coalesce((1 - weight) * multiple, 0), 6) + 0.0 AS weighted, n FROM g"""


@query(X_CASES)
def response_cases(spark: SparkSession, d: str) -> DataFrame:
    """Responses of all ordered pairs of symbols to signs, volumes and signed volumes: over all, single and multiple trades, and weighted."""
    t = trades(spark, d)
    return rounded(micro.response_cases(asof.bracket_quotes(t, t, symbol_pairs(t), ["volume"], True), t, t))


@query()
def wave_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Shape of each symbol's volume profile of a week, in cells of one unit of price: the first that is significant."""
    cells = trades(spark, d).where("volume is not null").select("symbol", F.date_trunc("week", "ts").cast("date").cast("string").alias("week"), F.round("price").alias("price"), "volume")
    return waves.wave_profiles(micro.volume_profile(cells, ["symbol", "week"]), ["symbol", "week"])


def spectrum_entries(spark: SparkSession, d: str) -> DataFrame:
    """side (left or right) and x: the entries of the singular vectors of the matrix of mean next-day responses."""
    made = fits.matrix_spectrum(mean_responses(spark, d), "mean")
    return spark.createDataFrame([(side, float(x)) for side in ("left", "right") for x in made[side].ravel()], "side string, x double")


@query()
def spectrum_law(spark: SparkSession, d: str) -> DataFrame:
    """Location-scale t law of the pooled entries of the left and of the right singular vectors."""
    return laws.t_law(spectrum_entries(spark, d), "x", ["side"])


@query()
def return_law(spark: SparkSession, d: str) -> DataFrame:
    """Location-scale t law of each symbol's bar returns, in percent."""
    return laws.t_law(returns(spark, d).select("symbol", (F.col("ret") * 100).alias("x")), "x", ["symbol"])


# ---- fits

#: Sources and the channels they may excite: moves up feed moves up, moves down those down.
FEEDS = [(f"{s}_{a}", f"{s}_{b}") for s in ("up", "down") for a in "ab" for b in "ab"]


def quote_moves(spark: SparkSession, d: str) -> DataFrame:
    """Four channels of a tape: moves up and down, of the two kinds of participants; marks are volumes."""
    side = F.when(F.col("side") == "buy", "up").otherwise("down")
    kind = F.when(F.col("participant") % 2 == 0, "a").otherwise("b")
    return trades(spark, d).select("symbol", F.concat_ws("_", side, kind).alias("channel"), (F.unix_micros("ts") / 6e7).alias("t"), "seq", (F.col("volume") + 1).alias("mark"))


@query()
def hawkes_network(spark: SparkSession, d: str) -> DataFrame:
    """Excitation among the four channels of each symbol after eight rounds, with marks, and its spectral radius."""
    return rounded(hawkes.hawkes_em(quote_moves(spark, d), 8, 0.5, FEEDS))


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier as a strategy: pro-forma and live return over its risk, regime (how far the returns of its nation stood from their mean before
    going live), and whether it failed: a live figure below the pro-forma one.  Its returns are its mean discounts by month, less 5 %."""
    supplier, lines = table(spark, d, "supplier"), table(spark, d, "lineitem")
    months = lines.groupBy(F.col("l_suppkey").alias("s"), F.date_trunc("month", "l_shipdate").alias("month")).agg((F.avg("l_discount").cast("double") - 0.05).alias("ret"))
    months = months.join(supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("bucket")), "s").withColumn("live", F.col("month") >= F.lit("1996-01-01").cast("timestamp"))
    of = lambda live: (F.avg(F.when(F.col("live") == live, F.col("ret"))) / F.stddev_samp(F.when(F.col("live") == live, F.col("ret")))).alias("live_ratio" if live else "proforma")
    own = months.groupBy("s", "bucket").agg(of(False), of(True))
    regime = months.groupBy("bucket").agg(((F.avg(F.when(~F.col("live"), F.col("ret"))) - F.avg("ret")) / F.stddev_samp("ret") * F.sqrt(F.count("*").cast("double"))).alias("regime"))
    return own.join(regime, "bucket").withColumn("failed", (F.col("live_ratio") < F.col("proforma")).cast("int"))


@query()
def strategy_failure(spark: SparkSession, d: str) -> DataFrame:
    """Log odds that a strategy fails once live, by its pro-forma figure and its launch regime."""
    fit = regression.irls(strategies(spark, d), [], [F.lit(1.0), F.col("proforma"), F.col("regime")], F.col("failed"), "logit")
    names = F.array(*map(F.lit, ["intercept", "proforma", "regime"]))
    return fit.select("n", "deviance", F.explode(F.arrays_zip(names.alias("feature"), F.col("coef").alias("coef"))).alias("x")).select("x.feature", r("x.coef", "coef"), "n", r("deviance"))


def fold_scores(spark: SparkSession, d: str, size: int = 6) -> DataFrame:
    """Folds of `size` bars: row, symbol, fold, rv and mom (volatility and return of the fold before, in percent), d (1 for the strategy that follows the bar before, 0 for holding), y: the squared mean return,
    if above zero, over volatility and worst drawdown."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    bars = returns(spark, d).withColumn("sign", F.signum(F.lag("ret").over(w))).where("sign is not null").withColumn("fold", F.floor(F.col("bar_idx") / size))
    both = bars.select("symbol", "fold", "bar_idx", "ret", F.explode(F.array(F.struct(F.lit(0.0).alias("d"), F.col("ret").alias("x")), F.struct(F.lit(1.0).alias("d"), (F.col("sign") * F.col("ret")).alias("x")))).alias("s")).select("symbol", "fold", "bar_idx", "ret", "s.*")
    path = Window.partitionBy("symbol", "fold", "d").orderBy("bar_idx")
    equity = both.withColumn("eq", F.sum("x").over(path)).withColumn("down", F.greatest(F.lit(0.0), F.max("eq").over(path)) - F.col("eq"))
    made = equity.groupBy("symbol", "fold", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("v"), F.max("down").alias("dd"), F.stddev_pop("ret").alias("rv"), F.sum("ret").alias("mom"), F.count("*").alias("n"))
    y = F.pow(F.greatest("m", F.lit(0.0)), 2) / F.greatest(F.col("v") * F.col("dd"), F.lit(1e-6))
    number = F.pmod(F.xxhash64("symbol", "fold", "d"), F.lit(1 << 40))
    before = Window.partitionBy("symbol", "d").orderBy("fold")
    known = made.where(F.col("n") == size).select(number.alias("row"), "symbol", "fold", *[(F.lag(c).over(before) * 100).alias(c) for c in ("rv", "mom")], "d", y.alias("y"))
    return known.where("rv is not null")


def zaga_features(d: Column) -> list[Column]:
    return [F.lit(1.0), F.col("rv"), F.col("mom"), d, d * F.col("rv"), d * F.col("mom")]


def regime_points(folds: DataFrame) -> DataFrame:
    """point, rv, mom: the regimes at the quartiles, mean and ends of both covariates."""
    one = folds.agg(*[f(c).alias(f"{n}_{c}") for c in ("rv", "mom") for n, f in (("min", F.min), ("q1", lambda c: F.percentile(c, 0.25)), ("median", lambda c: F.percentile(c, 0.5)), ("mean", F.avg), ("q3", lambda c: F.percentile(c, 0.75)), ("max", F.max))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(f"{n}_rv").alias("rv"), F.col(f"{n}_mom").alias("mom")) for n in ("min", "q1", "median", "mean", "q3", "max")])).alias("x")).select("x.*")


def gaps(points: DataFrame, model: DataFrame) -> DataFrame:
    """The strategy's mean and variance less those of holding, at each point, for each fitted law."""
    met = model.crossJoin(F.broadcast(points))  # six points

    def moments(d: float) -> tuple[Column, Column]:
        eta = lambda c: sum((F.col(c)[i] * f for i, f in enumerate(zaga_features(F.lit(d)))), F.lit(0.0))
        return regression.zaga_moments(eta("nu_coef"), eta("mu_coef"), F.col("sigma2"))

    (e1, v1), (e0, v0) = moments(1.0), moments(0.0)
    return met.withColumns({"gap_mean": e1 - e0, "gap_variance": v1 - v0})


@query()
def regime_gaps(spark: SparkSession, d: str, replicas: int = 20) -> DataFrame:
    """Gaps in expected score and its variance between following and holding by regime, with the share of bootstrap tables in which following is ahead."""
    folds = fold_scores(spark, d)
    features = zaga_features(F.col("d"))
    model = regression.zero_adjusted_gamma(folds, [], features, F.col("y"))
    points = regime_points(folds)
    drawn = regression.redrawn(folds.drop("symbol", "fold"), model, features, replicas)
    again = gaps(points, regression.zero_adjusted_gamma(drawn, ["replica"], features, F.col("drawn"), 10))
    ahead = again.groupBy("point").agg(F.avg((F.col("gap_mean") > 0).cast("double")).alias("ahead"), F.count("*").alias("replicas"))
    return gaps(points, model).join(ahead, "point").select("point", r("rv"), r("mom"), "gap_mean", "gap_variance", "n", "ahead", "replicas")


@query()
def arma_baseline(spark: SparkSession, d: str) -> DataFrame:
    """An ARMA(1, 1) forecast of each symbol's returns: coefficients, error, error of no change, and share of right signs."""
    coef, made = regression.hannan_rissanen(returns(spark, d).select("symbol", "bar_idx", (F.col("ret") * 100).alias("ret")), "ret")
    err = F.col("ret") - F.col("forecast")
    scored = made.where("forecast is not null").groupBy("symbol").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("rmse_none"), F.avg((F.signum("ret") == F.signum("forecast")).cast("double")).alias("directional"))
    named = coef.select("symbol", F.col("coef")[0].alias("constant"), F.col("coef")[1].alias("ar"), F.col("coef")[2].alias("ma"), "n")
    return rounded(named.join(scored, "symbol"))


@query()
def component_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the variance along the principal components of the symbols' returns."""
    r_ = returns(spark, d)
    names = sorted(x.symbol for x in r_.select("symbol").distinct().collect())
    wide = r_.groupBy("bar_idx").pivot("symbol", names).agg(F.first("ret")).na.drop().select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    shares = evaluation.principal_shares(wide, wide.columns)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "component int, share double")


def svm_rows(spark: SparkSession, d: str, window: int = 60, step: int = 20) -> DataFrame:
    """symbol, fold, bar_idx, training, x1 to x3, side, ret: each bar in the fold it is judged in, and in the up to window / step folds it trains.

    Features are the return before, the mean of the last five, and their spread, in percent; side is the sign of the bar's return.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    last = w.rowsBetween(-5, -1)
    bars = returns(spark, d).select("symbol", "bar_idx", (F.col("ret") * 100).alias("ret")).withColumns({"x1": F.lag("ret").over(w), "x2": F.avg("ret").over(last), "x3": F.stddev_samp("ret").over(last), "k": F.count("ret").over(last)})
    known = bars.where("k = 5").withColumns({"side": F.when(F.col("ret") > 0, 1.0).otherwise(-1.0), "own": F.floor(F.col("bar_idx") / step)})
    folds = F.sequence(F.col("own"), F.col("own") + window // step)
    return known.withColumn("fold", F.explode(folds)).withColumn("training", F.col("fold") > F.col("own")).where(F.col("fold") >= window // step).select("symbol", "fold", "bar_idx", "training", "x1", "x2", "x3", "side", "ret")


@query()
def svm_signals(spark: SparkSession, d: str) -> DataFrame:
    """Support vector machines of rolling windows: per symbol and fold the in-sample 40th and 60th percentiles of the fit, how often the fold's bars go long
    above and short below them, and the mean return of doing so."""
    rows = stash(svm_rows(spark, d), "svm")
    features = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x3")]
    fit = regression.irls(rows.where("training"), ["symbol", "fold"], features, F.col("side"), "hinge", penalty=1.0).select("symbol", "fold", "coef", "n")
    scored = rows.join(fit, ["symbol", "fold"]).withColumn("score", sum((F.col("coef")[i] * f for i, f in enumerate(features)), F.lit(0.0)))
    cuts = scored.where("training").groupBy("symbol", "fold").agg(F.percentile("score", 0.4).alias("low"), F.percentile("score", 0.6).alias("high"))
    sign = F.when(F.col("score") > F.col("high"), 1).when(F.col("score") < F.col("low"), -1).otherwise(0)
    judged = scored.where("not training").join(cuts, ["symbol", "fold"]).withColumn("sign", sign)
    return rounded(judged.groupBy("symbol", "fold", "low", "high", "n").agg(F.count_if(F.col("sign") == 1).alias("longs"), F.count_if(F.col("sign") == -1).alias("shorts"), F.avg(F.col("sign") * F.col("ret")).alias("mean_return")))
