"""One small test for each finding of the round that was right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import swings


@pytest.mark.parametrize("n", [1, 2, 4001, 6000])
def test_gap_rates_are_exact_and_hold_no_column(spark, n):
    rng = np.random.default_rng(n)
    ratio = np.concatenate([rng.exponential(0.3, n - n // 4), np.full(n // 4, 1.0)])
    ratio[: n // 8] *= 50
    up, down = rng.random(n) < 0.3, rng.random(n) < 0.2
    drawn = spark.createDataFrame([(float(x), bool(a), bool(b)) for x, a, b in zip(ratio, up, down, strict=True)], "gap_ratio double, clip_up boolean, clip_down boolean")
    made = swings.gap_rates(drawn)
    assert "percentile" not in made._jdf.queryExecution().toString()  # its map holds every value in one task
    r = made.first()
    bins = np.minimum(np.floor(np.minimum(ratio, 1.5) / (1.5 / 90)), 89)
    assert r.median == pytest.approx(np.median(ratio), abs=0) and r.over_one == pytest.approx((ratio > 1).mean())
    assert (r.clip_up, r.clip_down, r.clip_any) == pytest.approx((up.mean(), down.mean(), (up | down).mean()))
    assert r.fullest_n == max((bins == b).sum() for b in set(bins))


def test_synthetic_rates_deals_the_events_out(spark, tmp_path):
    from tidemark.plans.queries import QUERIES

    one = spark.range(50).select(F.col("id").alias("event_id")).coalesce(1)
    one.write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["synthetic_rates"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "hashpartitioning(event_id" in plan


ACROSS_ZERO = """agent_account bet_schemes bet_significance bootstrap_means coverage cross_impact cross_statistic detrended_correlation impact_degree_tests
    impact_degrees impact_rank impact_topology joint_lift lagged_correlation performance quantile_bets volume_normalised""".split()


@pytest.fixture(scope="module")
def across_zero(tmp_path_factory):
    """Events whose prices fall through zero, so that some returns are logarithms of negative numbers."""
    import duckdb

    folder = tmp_path_factory.mktemp("across")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (value * 40 AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ACROSS_ZERO)
def test_returns_across_zero_as_in_sql(spark, across_zero, name):
    from tests.test_queries import rows

    from tidemark.plans import models, studies  # noqa: F401
    from tidemark.plans.queries import QUERIES, SQL

    folder, con = across_zero
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.execute(SQL[name]).df())


def test_log_ratio_has_the_values_of_ieee(spark):
    from tidemark.functions import special

    pairs = [(2.0, 1.0), (-2.0, -1.0), (-1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None)]
    got = [r.v for r in spark.createDataFrame(pairs, "a double, b double").coalesce(1).select(special.log_ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[:2] == pytest.approx([np.log(2)] * 2) and np.isnan(got[2]) and got[3:5] == [-np.inf, np.inf] and np.isnan(got[5]) and np.isnan(got[6]) and got[7:] == [None, None]


def test_implied_vol_runs_over_batches(spark):
    from tidemark.functions import special

    rows = spark.createDataFrame([(100.0, 80.0, 0.2), (100.0, 100.0, 0.3), (100.0, 120.0, 0.4), (100.0, None, 0.4)], "s double, k double, sigma double")
    t, rate = F.lit(0.5), F.lit(0.02)
    priced = rows.withColumns(special.black_scholes(F.col("s"), F.col("k"), t, rate, F.col("sigma")))
    made = priced.select("k", "sigma", special.implied_vol(F.col("call"), F.col("s"), F.col("k"), t, rate).alias("iv"))
    plan = made._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "aggregate(sequence" not in plan  # a fold of Columns is interpreted, row by row
    assert all(r.iv is None if r.k is None else r.iv == pytest.approx(r.sigma, abs=1e-4) for r in made.collect())


def test_ranks_are_written_each_round(spark):
    from tidemark.operators import regression

    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (3, 4)], "i long, j long")
    made = regression.pagerank(edges, spark.createDataFrame([(k,) for k in range(1, 6)], "v long"), 3)
    assert "Join" not in made._jdf.queryExecution().toString()  # a plan of k rounds named the first ranks 3 ** k times
    rank = np.full(5, 0.2)
    for _ in range(3):
        got = np.array([rank[2] / 2, rank[0], rank[1], rank[2] / 2, 0.0])
        rank = 0.15 / 5 + 0.85 * (got + (rank[3] + rank[4]) / 5)
    assert [r.rank for r in made.orderBy("v").collect()] == pytest.approx(list(rank))


def test_dense_trades_meet_in_narrow_buckets(spark, monkeypatch):
    from tidemark.operators import micro

    rng, met = np.random.default_rng(5), []
    real = micro.interval_overlap
    monkeypatch.setattr(micro, "interval_overlap", lambda x, y, width, key: met.append(width) or real(x, y, width, key))
    rows = []
    for s in "ab":
        t = np.cumsum(rng.exponential(1.0, 200))
        rows += [(s, float(a), float(b), float(r)) for a, b, r in zip(t, t[1:], rng.normal(size=199), strict=False)]
    got = micro.hayashi_yoshida(spark.createDataFrame(rows, "symbol string, t0 double, t1 double, ret double"), 14_400.0).first()
    assert met[0] < 10  # in one bucket of four hours all pairs were compared
    x, y = ([r[1:] for r in rows if r[0] == s] for s in "ab")
    assert got["cov"] == pytest.approx(sum(p[2] * q[2] for p in x for q in y if p[0] < q[1] and q[0] < p[1]))


@pytest.mark.parametrize("name", ["cross_statistic", "detrended_correlation", "joint_lift", "volume_normalised"])
def test_flat_prices_as_in_sql(spark, tmp_path, name):
    """Every step is taken back at once, so that no return differs from zero and statistics are zero over zero."""
    import duckdb

    from tests.test_queries import rows

    from tidemark.plans import models, studies  # noqa: F401
    from tidemark.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (event_id * 2 + k AS event_id) FROM '/root/testdata/sf0.001/events.parquet', range(2) g(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("n", [1, 7, 20_003])
def test_quantile_cuts_are_exact(spark, n):
    from tidemark.operators import stats

    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    x[: n // 3] = np.nan
    made = stats.quantile_cuts(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), ["x", "y"], 5).first()
    for got, v in ((made.q_x, x), (made.q_y, y)):
        assert list(got) == pytest.approx([np.sort(v)[-(-p * n // 5) - 1] for p in range(1, 5)], abs=0, nan_ok=True)


def test_streams_hold_packed_numbers_and_give_chunks():
    import pandas as pd

    from tidemark.streaming import jobs

    class State:
        exists = False

        def update(self, value):
            self.value = value

    rng = np.random.default_rng(3)
    n = 150_000
    bars = pd.DataFrame({"symbol": "a", "bar_idx": np.arange(n), "high": 50 + 40 * rng.random(n)})
    bars["low"] = bars.high
    mixed = bars.sample(frac=1.0, random_state=1)
    state = State()
    made = list(jobs._zigzag(0.3)(("a",), iter([mixed[k : k + 10_000] for k in range(0, n, 10_000)]), state))
    assert len(made) == 3 and state.value[0] == n  # one frame held all pivots of a symbol, and lists of all its rows
    chain = swings.ZigZag(0.3)
    want = [p for x in bars.high if (p := chain.push(x, x))]
    got = pd.concat(made)
    assert list(got[["bar_idx", "price", "kind", "confirm_idx"]].itertuples(index=False, name=None)) == want and list(got.pivot_seq) == list(range(len(want)))


@pytest.mark.parametrize("spread", [2.0, 1e4])
def test_likelihood_trials_share_the_shuffle_of_events(spark, spread):
    from tidemark.operators import fits

    t = np.cumsum(np.random.default_rng(8).exponential(1.0, 300))
    trials = [("a", k, mu, nu, alpha, float(t[0]), float(t[-1])) for k, (mu, nu, alpha) in enumerate([(0.5, 0.4, 1.0), (0.8, 0.4, 1.0), (0.5, 0.2, 1.0), (0.5, 0.4, spread), (0.5, 0.4, 1 / spread)])]
    events = spark.createDataFrame([("a", float(x)) for x in t], "symbol string, t double")
    made = fits.hawkes_loglik(events, spark.createDataFrame(trials, "symbol string, trial int, mu double, nu double, alpha double, begin double, end double"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [symbol" in plan  # before the kernels' sums: each trial moved all events with its own
    got = {r.trial: (r.loglik, r.mass) for r in made.collect()}
    for _, k, mu, nu, alpha, begin, end in trials:
        rate = [mu + nu * alpha * np.exp(-alpha * (x - t[:i])).sum() for i, x in enumerate(t)]
        mass = mu * (end - begin) + nu * (1 - np.exp(-alpha * (end - t))).sum()
        assert got[k] == pytest.approx((np.log(rate).sum() - mass, mass))


def test_events_move_once_for_all_sources(spark, monkeypatch):
    from tidemark.operators import hawkes

    monkeypatch.setattr(hawkes, "REACH", 10)
    monkeypatch.setattr(hawkes, "STRETCH", 10)  # carries pass over stretches of blocks
    rng = np.random.default_rng(4)
    rows = [("s", "ab"[int(rng.random() < 0.4)], float(x), k, float(rng.random() + 0.5)) for k, x in enumerate(np.cumsum(rng.exponential(1.0, 400)))]
    events = spark.createDataFrame(rows, "symbol string, channel string, t double, seq long, g double")
    alpha = {"a": 0.3, "b": 2.0}
    wide = hawkes.wide_sums(events, spark.createDataFrame([("s", 10 / 0.6**0.5, 0.3, 2.0)], "symbol string, width double, alpha0 double, alpha1 double"), ["a", "b"])
    got = {r.seq: r for r in wide.collect()}
    assert len(got) == 400
    for _, _, t, seq, _ in rows[::20]:
        for k, j in enumerate("ab"):
            past = [(g * np.exp(-alpha[j] * (t - x)), t - x) for _, c, x, _, g in rows if c == j and x < t]
            assert got[seq][f"s{k}"] == pytest.approx(sum(p for p, _ in past), abs=1e-9) and got[seq][f"a{k}"] == pytest.approx(sum(p * age for p, age in past), abs=1e-9)
