import dataclasses
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout  # noqa: F401

from tidemark.functions import special
from tidemark.operators import asof, bars as B, evaluation, grid, laws, micro, signals as S, stats, swings, waves


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], f"symbol string, bar_idx long, {name} double")


def next_pivot(high, low, pct, begin, after, kind):
    """First bar past `after` from which the extreme since `begin` lies pct away, and that extreme."""
    run, other, sign = (np.maximum.accumulate(high[begin:]), low[begin:], 1) if kind == "H" else (np.minimum.accumulate(low[begin:]), high[begin:], -1)
    hits = np.flatnonzero(other * sign <= run * (1 - sign * pct) * sign) + begin
    hits = hits[hits > after]
    return None if not len(hits) else (begin + int(np.argmax(run == run[hits[0] - begin])), float(run[hits[0] - begin]), kind, int(hits[0]))


def declared_pivots(high, low, pct):
    """Pivots one after another by what each of them is: the extreme between the pivot before and its confirmation."""
    both = [p for k in "HL" if (p := next_pivot(high, low, pct, 0, 0, k))]
    out = sorted(both, key=lambda p: (p[3], p[2]))[:1]
    while out and (p := next_pivot(high, low, pct, out[-1][0], out[-1][3], "L" if out[-1][2] == "H" else "H")):
        out.append(p)
    return out


def test_zigzag_finds_the_declared_pivots():
    draw = random.Random(1)
    for wide in [0.004] * 300 + [0.03] * 200:
        close = 100 * np.exp(np.cumsum([draw.gauss(0, 0.01) for _ in range(300)]))
        high, low = close * (1 + np.abs([draw.gauss(0, wide) for _ in close])), close * (1 - np.abs([draw.gauss(0, wide) for _ in close]))
        high, low = high.round(1), low.round(1)  # so that there are ties
        chain = swings.ZigZag(0.015)
        got = [p for h, l in zip(high, low, strict=True) if (p := chain.push(h, l))]  # noqa: E741
        assert got == declared_pivots(high, low, 0.015)
        assert all(a[2] != b[2] for a, b in zip(got, got[1:], strict=False))


def plain_crossings(levels, bars_):
    """Moves of the last touched level over the path: a leg ends at its own end's level unless it is there already."""
    close = np.array([b[3] for b in bars_])
    path = np.column_stack([np.append(bars_[0][0], close[:-1]), [b[2] for b in bars_], [b[1] for b in bars_], close])
    at = int(np.searchsorted(levels, bars_[0][0], "right")) - 1
    moves = 0
    for a, b in np.stack([path[:, :-1], path[:, 1:]], -1).reshape(-1, 2):
        below = int(np.searchsorted(levels, b))
        to = at if a == b else max(at, below - 1) if a < b else min(at, below)
        moves, at = moves + abs(to - at), to
    return moves


def test_crossing_sweep_equals_the_loop(spark):
    draw = random.Random(2)
    rows, want = [], {}
    sizes = [0.01, 0.03, 0.08]
    for symbol in "abc":
        close, own = 100.0, []
        for i in range(120):
            o, close = close * (1 + draw.gauss(0, 0.003)), close * (1 + draw.gauss(0, 0.02))
            close = min(max(close, 60), 180)
            own.append((o, max(o, close) * (1 + abs(draw.gauss(0, 0.01))), min(o, close) * (1 - abs(draw.gauss(0, 0.01))), close))
            rows.append((symbol, i * 14_400, *own[-1]))
        for g in sizes:
            levels = [50.0]
            while levels[-1] <= 250:
                levels.append(levels[-1] * (1 + g))
            want[symbol, g] = plain_crossings(levels, own), len(levels) - 1
    df = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds("t"))
    got = grid.crossing_sweep(df, spark.createDataFrame([(s,) for s in sizes], "grid_size double"), 50, 250).collect()
    assert {(r.symbol, r.grid_size): (r.trade_count, r.grid_count) for r in got} == want


def test_summaries_merge(spark):
    draw = random.Random(3)
    for _ in range(20):
        legs = [(draw.randrange(20), draw.random() < 0.5) for _ in range(draw.randrange(1, 12))]
        k = draw.randrange(len(legs) + 1)
        df = spark.createDataFrame([(legs, legs[:k], legs[k:])], ", ".join(f"{c} array<struct<x:long,up:boolean>>" for c in "wab"))
        row = df.select(grid.crossing_summary(F.col("w")).alias("w"), grid.merge_summaries(F.array(grid.crossing_summary(F.col("a")), grid.crossing_summary(F.col("b")))).alias("m")).first()
        for entry in range(22):
            level, moved = entry, 0
            for x, up in legs:
                new = max(level, x) if up else min(level, x)
                moved, level = moved + abs(new - level), new
            for s in (row.w, row.m):
                assert s.c + max(s.lo - entry, 0) + max(entry - s.hi, 0) == moved
                assert (s.s if s.one else min(max(entry, s.lo), s.hi)) == level


def test_level_counts(spark):
    sizes = spark.createDataFrame([(0.003,), (0.05,), (0.1,)], "g double")
    got = {r.g: r.n for r in sizes.select("g", (F.size(grid.geometric_levels(F.lit(10_000.0), F.lit(80_000.0), F.col("g"))) - 1).alias("n")).collect()}
    assert got == {0.003: 695, 0.05: 43, 0.1: 22}
    assert grid.sweep_sizes(spark).count() == 98


def test_grid_closed_forms(spark):
    r = grid.closed_forms(spark.createDataFrame([(600.0, 6)], "m double, n int")).first()
    assert (r.p_u, r.l_l, r.expected, r.e0, r.cycles) == (600, 1200, -300, 9, 3)
    levels = spark.range(1).select(F.transform(grid.centred_levels(F.lit(100.0), F.lit(0.05), 3, 3), lambda x: F.round(x, 2)).alias("l")).first().l
    assert levels == [86.38, 90.7, 95.24, 100, 105, 110.25, 115.76]
    r = grid.flexible_capital(spark.createDataFrame([(100.0, 70.0, 6.0, 0.0, 5000.0)], "p0 double, l double, n_l double, n_u double, f0 double")).first()
    assert round(r.ratio, 5) == 1.06125


def test_dynamic_grid_goes_on_where_a_plain_one_ends(spark):
    close = [100, 103, 107, 111, 116, 121, 126, 131, 126, 121]
    df = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate(close)], "symbol string, ts long, close double")
    plain, dynamic = (grid.grid_backtest(df, 0.05, 6, 1000.0, d).first() for d in (False, True))
    assert plain.n_resets == 0 and plain.n_sells == 3 and abs(plain.coins) < 1e-9 and dynamic.n_resets >= 1
    sold = 500 / 100 / 3 * (105 + 110.25 + 115.7625)
    assert plain.cash == pytest.approx(500 + sold)


def test_trend_classification(spark):
    rows = [(100, 101, 103, 0.5), (104, 102, 99.5, 0.5), (100, 100, 100.2, 0.5), (100, 102, 103, 0.5), (103, 101, 100, 0.5), (100, 100, 100, 0.5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, b double, c double, p double, d double")
    got = df.withColumns(S.classify(F.col("p"), F.col("c"), F.col("b"), F.col("d"))).orderBy("i").collect()
    assert [r.signal for r in got] == [1, -1, 0, 0, 0, 0]


def test_order_book():
    limits, book = S.Limits(15, amount=0.0002), {}
    verdicts = [S.place(book, limits, *c) for c in [(100, 1.1, 1), (112, 1.101, 1), (118, 1.1003, 1), (119, 1.1003, -1), (140, 1.10035, 1), (140, 1.1001, 1)]]
    assert verdicts == ["admitted", "time", "admitted", "admitted", "price", "price"]
    for bad in ({"amount": 1.0, "orders": 12}, {}, {"amount": 1.0, "share": 1.0}):
        with pytest.raises(ValueError):
            S.Limits(15, **bad)
    full, book = S.Limits(0, share=1e-12), {}
    assert [S.place(book, full, i * 10, 100.0 + i, 1) for i in range(14)] == ["admitted"] * 13 + ["cap"]


def test_places_equal_looking_at_every_open_order():
    draw = random.Random(12)
    for _ in range(50):
        limits, book, held = S.Limits(draw.randrange(6), share=draw.choice([1e-12, 0.002, 0.01]), orders=draw.choice([5, 99])), {}, []
        for bar in range(150):
            price, side = 100 + draw.randrange(40) / 10, draw.choice([1, -1])
            own = [o for o in held if o[2] == side]
            rules = {"cap": len(held) >= limits.orders, "time": any(bar <= o[0] + limits.bars for o in own), "price": any(abs(price - o[1]) <= limits.share * price for o in own)}
            want = next((k for k, v in rules.items() if v), "admitted")
            assert S.place(book, limits, bar, price, side) == want
            held += [(bar, price, side)] * (want == "admitted")


def test_admission_spacing(spark):
    draw = random.Random(5)
    rows = [("a", i, 100 + draw.random(), draw.choice([-1, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, close double, signal int")
    took = [r for r in S.admit(df, 15, 1e-4).collect() if r.verdict == "admitted"]
    assert 0 < len(took) <= 13
    for d in (1, -1):
        own = sorted(r.bar_idx for r in took if r.direction == d)
        assert all(b - a > 15 for a, b in zip(own, own[1:], strict=False))


def test_net_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.tanh(x @ [1.0, -0.5, 0.3])
    net = S.TanhLayer(3, 12)
    of, w = net.objective(x, y), net.start(0) + rng.normal(size=12 * 4 + 13) * 0.1
    for k in rng.integers(0, len(w), 8):
        e = np.eye(len(w))[k] * 1e-6
        assert (of(w + e)[0] - of(w - e)[0]) / 2e-6 == pytest.approx(of(w)[1][k], abs=1e-6)
    got, history = S.scaled_conjugate(of, net.start(0), 150)
    assert of(got)[0] == history[-1] < 0.02 * history[0] and all(b <= a for a, b in zip(history, history[1:], strict=False))
    # on a parabola it ends at the bottom, also from a saddle of one that opens downwards on one side first
    m = np.diag([1.0, 5.0, 20.0])
    low, _ = S.scaled_conjugate(lambda v: (float(v @ m @ v) / 2 - v.sum(), m @ v - 1), np.zeros(3), 60)
    assert low == pytest.approx([1.0, 0.2, 0.05], abs=1e-5)
    well, _ = S.scaled_conjugate(lambda v: (float((v * v - 1) @ (v * v - 1)), 4 * v * (v * v - 1)), np.array([0.1, -0.2]), 100)
    assert well == pytest.approx([1, -1], abs=1e-4)


def test_range_rules(spark):
    df = spark.createDataFrame([(80.0, 50.0, 65.0, 58.0), (64896.0, 62538.0, 64388.0, 63312.0), (80.0, 50.0, 65.0, 40.0)], "a double, b double, c double, d double")
    p = [F.col(c) for c in "abcd"]
    assert [tuple(r) for r in df.select(swings.tr_rule(*p), swings.tr_rule_prose(*p)).collect()] == [(True, False), (True, False), (False, True)]
    rate = swings.synthetic_tr(spark.range(100_000), False, 9).agg(F.avg(F.col("label").cast("double"))).first()[0]
    assert abs(rate - 1 / 24) < 0.003
    assert swings.synthetic_tr(spark.range(1000), True, 9).where("not label").count() == 0


def test_norm100(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([5.0, 5.0],)], "p array<double>")
    assert [r[0] for r in df.select(B.norm100(F.col("p"))).collect()] == [[100.0, 0.0, 50.0], [0.0, 0.0]]


def test_repeated_trades_and_calendar_bars(spark):
    t = spark.createDataFrame([("a", 5, 0, 101.0, 200), ("a", 5, 1, 101.5, 100), ("a", 5, 2, 100.8, 50)], "symbol string, t long, seq long, price double, volume long").withColumn("ts", F.timestamp_seconds("t"))
    r = B.collapse_repeated(t).first()
    assert round(r.price, 4) == 101.1143 and r.volume == 350
    t = spark.createDataFrame([("a", 5, 0, 100.0, 100), ("a", 20, 1, 101.0, 200), ("a", 50, 2, 100.5, 300)], "symbol string, t long, seq long, price double, volume long").withColumn("ts", F.timestamp_seconds("t"))
    r = B.calendar_bars(t, 60).first()
    assert (r.open, r.high, r.low, r.close, r.volume, round(r.vwap, 4), r.stamp) == (100, 101, 100, 100.5, 600, 100.5833, 65)


PRICE, VOLUME = (2, -1, 1, -2, 5, -4, 2, -3), (1, 1, -2, 0, 3, -2, -1, 0)


def test_detrended_analysis(spark):
    df = series(spark, PRICE).join(series(spark, VOLUME, "y"), ["symbol", "bar_idx"])
    rho = {r.s: round(r.rho, 4) for r in stats.dxa_coefficient(df, "x", "y", [4, 8]).collect()}
    assert rho == {4: 0.7247, 8: 0.9025}
    h = stats.scaling_exponent(stats.fluctuation(stats.detrended_covariance(df, "x", "y", [4, 8], absolute=True), [-4.0, 0.0, 2.0, 4.0]))
    got = {r.q: r.h for r in h.collect()}
    assert [got[q] for q in (-4.0, 0.0, 2.0, 4.0)] == pytest.approx([1.0716, 0.9695, 0.9148, 0.8674], abs=1e-4)
    q = stats.cross_statistic(df, "x", "y", 2, ts="bar_idx").where("m = 2").first().q_cc
    assert round(q, 4) == 0.5869


def test_hayashi_yoshida(spark):
    a, b = [(0, 2, 0.00995033), (2, 5, -0.00496278), (5, 9, 0.01481506)], [(1, 4, 0.00399202), (4, 8, 0.01581073)]
    df = spark.createDataFrame([("a", float(s), float(e), x) for s, e, x in a] + [("b", float(s), float(e), x) for s, e, x in b], "symbol string, t0 double, t1 double, ret double")
    want = sum(x * y for s, e, x in a for u, v, y in b if s < v and u < e)
    for width in (1.0, 3.0, 100.0):
        assert micro.hayashi_yoshida(df, width).first().cov == pytest.approx(want)


def test_tails_and_sizing(spark):
    fit = {r.x_min: r.delta for r in stats.power_law(series(spark, [1.6, 2.2, 3.5, 6, 15]), "x", [1.46, 3.5]).collect()}
    assert round(fit[1.46], 3) == 1.977 and round(fit[3.5], 3) == 2.504
    row = spark.range(1).select(stats.sharpe_test(F.lit(-4.42), F.lit(1257), F.lit(0.2), F.lit(8.0)), special.kelly(F.lit(0.6))).first()
    assert round(row[0], 1) == -9.0 and round(row[1], 6) == 0.2
    gaps = stats.recurrence_intervals(series(spark, [9, 1, 9, 1, 1, 1, 9, 1, 9]), "x", [2.0])
    assert sorted(r.tau for r in gaps.collect()) == [2, 2, 4]


def test_imbalance_and_hawkes(spark):
    flow = spark.createDataFrame([(True, 23.0), (False, 17.0)], "up boolean, size double").withColumn("k", F.lit(1))
    assert micro.imbalance(flow, F.col("up"), F.col("size"), ["k"]).first().ovi == pytest.approx(0.15)
    e = spark.createDataFrame([("s", "b", t, i, m) for i, (t, m) in enumerate([(0.0, 1.0), (1.0, 2.0), (3.0, 1.0)])], "symbol string, channel string, t double, seq long, mark double")
    got = [r.intensity for r in micro.hawkes_intensity(e, 0.4, 0.5, 0.7, 1.0).orderBy("t").collect()]
    assert got == pytest.approx([0.4, 0.4 + 0.35 * math.exp(-0.7), 0.4 + 0.35 * (math.exp(-2.1) + 2 * math.exp(-1.4))])


def test_special_functions(spark):
    x = [0.5, 1.0, 2.5, 5.0, 11.0, 14.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", special.norm_cdf(F.col("x")).alias("n"), special.ln_gamma(F.col("x")).alias("g"), special.bessel_j0(F.col("x")).alias("j"), special.kummer(-2, 1.0, F.col("x")).alias("k")).collect()
    for r in rows:
        assert r.n == pytest.approx(0.5 * math.erfc(-r.x / 2**0.5), abs=1e-6)
        assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-9)
        t = np.linspace(0, math.pi, 20_001)
        y = np.cos(r.x * np.sin(t))
        assert r.j == pytest.approx(float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum() / math.pi), abs=2e-4)
        assert r.k == pytest.approx(1 - 2 * r.x + r.x**2 / 2)
    bs = spark.range(1).select(*[v.alias(k) for k, v in special.black_scholes(F.lit(100.0), F.lit(95.0), F.lit(0.5), F.lit(0.02), F.lit(0.3)).items()]).first()
    iv = spark.range(1).select(special.implied_vol(F.lit(bs.call), F.lit(100.0), F.lit(95.0), F.lit(0.5), F.lit(0.02))).first()[0]
    assert iv == pytest.approx(0.3, abs=1e-6) and bs.call - bs.put == pytest.approx(100 - 95 * math.exp(-0.01))


def test_overfitting_and_pruning(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", i * 86_400, float(rng.normal())) for k in range(8) for i in range(240)]
    df = spark.createDataFrame(rows, "strategy string, t long, ret double").withColumn("ts", F.timestamp_seconds("t"))
    noise = evaluation.overfitting_probability(df).first()
    best = evaluation.overfitting_probability(df.withColumn("ret", F.col("ret") + F.when(F.col("strategy") == "s3", 1.5).otherwise(0))).first()
    assert noise.splits == 20 and best.p_overfit == 0 and noise.p_overfit > 0.1
    x = rng.normal(size=200)
    wide = spark.createDataFrame([(float(a), float(a + 0.1 * b), float(b)) for a, b in zip(x, rng.normal(size=200), strict=True)], "a double, b double, c double")
    assert evaluation.prune_correlated(wide, ["a", "b", "c"]) == ["a", "c"]


def test_bootstrap_and_alternation(spark):
    from tidemark.operators import portfolio

    df = series(spark, range(100), "v").withColumn("ts", F.col("bar_idx"))
    got = [r["mean"] for r in evaluation.moving_block_bootstrap(df, "v", 60, 10).collect()]
    assert len(got) == 60 and 40 < sum(got) / 60 < 59
    marks = spark.createDataFrame([("a", i, float(p), m) for i, (p, m) in enumerate([(1, "s"), (2, "b"), (3, "b"), (4, "s"), (5, "s"), (6, "b"), (9, "s")])], "symbol string, ts long, close double, m string")
    trips = portfolio.round_trips(portfolio.alternating_trades(marks, F.col("m") == "b", F.col("m") == "s")).orderBy("entry_ts").collect()
    assert [(t.entry, t.exit) for t in trips] == [(2, 4), (6, 9)]


def test_simulators(spark):
    from tidemark.operators import simulate

    end = simulate.gbm(spark, 3000, 12, 0.1, 0.2, dt=1 / 12).where("step = 12").agg(F.avg("value"), F.stddev(F.ln("value"))).first()
    assert end[0] == pytest.approx(100 * math.exp(0.1), rel=0.02) and end[1] == pytest.approx(0.2, rel=0.08)
    end = simulate.merton(spark, 3000, 12, 0.1, 0.2, 2.0, -0.1, 0.1, dt=1 / 12).where("step = 12").agg(F.avg("value")).first()
    assert end[0] == pytest.approx(100 * math.exp(0.1), rel=0.03)
    sd = simulate.ornstein_uhlenbeck(spark, 2000, 200, 5.0, 1.0, 0.5, dt=0.02).where("step = 200").agg(F.avg("value"), F.stddev("value")).first()
    assert sd[0] == pytest.approx(1.0, abs=0.03) and sd[1] == pytest.approx(0.5 / 10**0.5, rel=0.08)
    n = simulate.hawkes_thinning(spark, 200, 100.0, 0.5, 0.5, 2.0).count() / 200
    assert n == pytest.approx(100.0, rel=0.08)
    same = [r.value for r in simulate.garch(spark, 2, 10, 1e-6, 0.1, 0.8).orderBy("path", "step").collect()]
    assert same == [r.value for r in simulate.garch(spark, 2, 10, 1e-6, 0.1, 0.8).orderBy("path", "step").collect()]
    with pytest.raises(ValueError):
        simulate.hawkes_thinning(spark, 1, 1.0, 1.0, 1.0, 1.0)
    best, y = simulate.swarm(lambda p: p.select("id", (-((F.col("x")[0] - 3) ** 2) - (F.col("x")[1] + 1) ** 2).alias("y")), spark, [-5, -5], [5, 5], size=40, generations=8)
    assert y > -1.0


def test_grid_search_is_the_best_of_each_symbols_sweep(spark):
    from tidemark.operators import grid
    from tidemark.plans.queries import QUERIES
    from tidemark.plans.views import bars

    sf = "/root/testdata/sf0.001"
    got = {r.symbol: r.profit for r in QUERIES["grid_search"](spark, sf).collect()}
    want = grid.crossing_sweep(bars(spark, sf), grid.sweep_sizes(spark), 500.0, 2000.0, 0.0008).groupBy("symbol").agg(F.max("profit").alias("profit")).collect()
    assert len(want) == 5 and got == pytest.approx({r.symbol: r.profit for r in want})


def test_all_pairs_of_symbols(spark):
    from tidemark.plans.queries import QUERIES
    from tidemark.plans.views import trades

    sf = "/root/testdata/sf0.001"
    t = trades(spark, sf).orderBy("ts", "seq").collect()
    last, want = {}, {}
    instants = {}
    for r in t:
        instants.setdefault(r.ts, []).append(r)
    for rows in instants.values():
        last |= {r.symbol: r.price for r in rows}
        want |= {(i, r.symbol, r.seq): last.get(i) for r in rows for i in {x.symbol for x in t} - {r.symbol}}
    assert {(r.i, r.j, r.seq): r.asof_price for r in QUERIES["asof_prices"](spark, sf).collect()} == want
    assert len({(r.i, r.j) for r in QUERIES["response_matrix"](spark, sf).collect()}) == 20


def test_hawkes_composes_over_blocks_of_time(spark):
    draw = np.random.default_rng(3)
    t = np.sort(np.round(np.concatenate([draw.random(300) * 50, 9000 + draw.random(300) * 900, [20000.0, 1e7]]), 1))
    rows = [("a", "x", float(x), k, float(k % 4)) for k, x in enumerate(t)] + [("a", None, 5.0, 0, 2.0), ("a", None, 6.0, 1, None)]
    for alpha, power in ((0.05, 0.0), (3.0, 1.0)):
        e = spark.createDataFrame(rows[: 602 if power else 604], "symbol string, channel string, t double, seq long, mark double")
        made = micro.hawkes_intensity(e, 0.0, 0.5, alpha, power)
        got = {(r.channel, r.seq): r.intensity for r in made.collect()}
        held, last = 0.0, t[0]
        for k, x in enumerate(t):
            held *= np.exp(-alpha * (x - last))
            assert got["x", k] == pytest.approx(0.5 * alpha * held, rel=1e-9, abs=1e-300)
            held, last = held + (k % 4) ** power, x
        if not power:
            assert got[None, 1] == pytest.approx(0.5 * alpha * np.exp(-alpha))
        # no group function takes a whole channel
        assert "InPandas" not in made._jdf.queryExecution().toString()


def test_fits(spark):
    from tidemark.operators import fits, simulate

    e = simulate.hawkes_thinning(spark, 1, 1500.0, 0.5, 0.5, 2.0).select(F.lit("a").alias("symbol"), F.col("value").alias("t"))
    r = fits.hawkes_fit(e).first()
    assert r.mu == pytest.approx(0.5, rel=0.35) and r.nu == pytest.approx(0.5, rel=0.35) and r.residual == pytest.approx(1.0, abs=0.05)
    tail = spark.range(2000).select(F.pow((F.col("id") + 0.5) / 2000, -1 / 1.5).alias("x"))
    r = fits.power_law_bootstrap(tail, "x", [1.0, 1.5, 2.0], 40).first()
    assert r.delta == pytest.approx(2.5, abs=0.02) and r.p > 0.5
    ramp = series(spark, np.random.default_rng(1).normal(size=600))
    assert fits.dfa(ramp, "x", [8, 16, 32]).first().exponent == pytest.approx(0.5, abs=0.15)
    level = fits.kalman_level(series(spark, [5.0] * 50), "x", 0.1, 1.0).orderBy("bar_idx").collect()
    assert level[-1].level == pytest.approx(5.0) and level[-1].gain < level[1].gain
    both = series(spark, [1, 2, 3, 4, 3, 2]).unionByName(series(spark, [1, 1, 2, 3, 4, 3]).withColumn("symbol", F.lit("b")))
    got = fits.dtw_distances(both, "x", spark.createDataFrame([("a", "a"), ("a", "b")], "i string, j string")).collect()
    assert {(r.i, r.j): r.dtw for r in got}[("a", "a")] == 0
    account = fits.trading_account(series(spark, [10, 11, 12, 13], "close").withColumns({"act": F.lit(1e9), "turb": F.when(F.col("bar_idx") == 3, 100.0).otherwise(0.0)}), "act", turbulence="turb", cash=1000.0, order="bar_idx").orderBy("bar_idx").collect()
    assert all(r.cash >= -1e-6 for r in account) and account[-1].held == 0 and account[0].held > 0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + 0.5 * rng.normal())) for a, b in x], "a double, b double, y double")
    w, losses = fits.pnl_regression(df, ["a", "b"], "y", 25)
    assert losses[-1] < losses[0] and w[0] > 3 * abs(w[1])
    m = fits.matrix_spectrum(spark.createDataFrame([("x", "x", 3.0), ("y", "y", 2.0)], "i string, j string, v double"), "v")
    assert m["singular"].tolist() == [3, 2]


def test_synchronised_volume_bars(spark):
    rows = [("A", 1, 0, 10.0, 60), ("A", 2, 1, 10.1, 70), ("A", 4, 2, 10.2, 90), ("B", 1, 3, 20.0, 120), ("B", 3, 4, 20.4, 50), ("B", 4, 5, 20.2, 40)]
    t = spark.createDataFrame(rows, "symbol string, t long, seq long, price double, volume long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.tau, r.symbol): (round(r.price, 4), r.ts.second) for r in B.synchronised_volume_bars(t, 100).collect()}
    assert got == {(1, "B"): (20.0, 1), (2, "A"): (10.04, 2), (3, "A"): (10.17, 4), (3, "B"): (20.26, 4)}


def test_median_flow_and_bets(spark):
    rows = [("a", 1, "mm", "buy", 300, 2.5), ("a", 1, "cust", "buy", 700, 2.5), ("a", 1, "mm", "sell", 600, 2.5), ("a", 1, "brk", "sell", 400, 2.5)]
    t = spark.createDataFrame(rows, "symbol string, day int, participant string, side string, volume long, price double")
    got = {(r.buyer, r.seller): round(r.share, 6) for r in micro.median_flow(t, ["symbol"]).collect()}
    assert got == {("mm", "mm"): 0.18, ("mm", "brk"): 0.12, ("cust", "mm"): 0.42, ("cust", "brk"): 0.28}
    df = spark.createDataFrame([(1, "a", 0.15, 0.005), (1, "b", -0.3, -0.004), (1, "c", 0.05, -0.002), (1, "d", -0.1, 0.006), (1, "e", 0.0, 9.0)], "day int, symbol string, s double, f double")
    made = {(r.scheme, r.q): (r.pnl, r.n) for r in micro.bet_portfolios(df, "s", "f", "day", {"uniform": F.lit(1), "imbalance": F.abs("s")}, groups=4).collect()}
    assert made["uniform", 1] == (pytest.approx(0.00025), 4) and made["uniform", 3] == (pytest.approx(0.0045), 2)
    assert made["imbalance", 1][0] == pytest.approx((0.15 * 0.005 + 0.3 * 0.004 - 0.05 * 0.002 - 0.1 * 0.006) / 0.6)


def test_channels_excite_each_other(spark):
    e = spark.createDataFrame([("s", "a", 0.0, 0), ("s", "b", 0.4, 1), ("s", "b", 5000.0, 2)], "symbol string, channel string, t double, seq long")
    got = micro.hawkes_cross(e, {"a": 0.5, "b": 0.4}, {("a", "a"): 0.5, ("a", "b"): 0.31, ("b", "b"): 0.2}, 2.0).orderBy("t").collect()
    assert [r.lambda_a for r in got] == pytest.approx([0.5, 0.5 + 0.5 * 2 * math.exp(-0.8), 0.5]) and [r.lambda_b for r in got] == pytest.approx([0.4, 0.4, 0.4])


def test_lagged_lmv_of_the_published_example(spark):
    v = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5]
    g = [(0.3, 1.1, 2.6), (0.2, 0.9, 2.2), (0.4, 1.5, 3.4), (0.5, 1.3, 3.3), (0.6, 1.8, 5.0), (0.7, 2.1, 5.3)]
    df = spark.createDataFrame([("a", i * 3 + k, a, float(x)) for i, (a, xs) in enumerate(zip(v, g, strict=True)) for k, x in enumerate(xs)], "symbol string, bar_idx long, v double, g double")
    got = {r.lag: r for r in stats.lagged_lmv(df, "v", "g", 1).collect()}
    assert round(got[0].lmv, 3) == 0.925 and round(got[0]["corr"], 3) == 0.352


def test_intervals_bracket_in_linear_time(spark):
    """The plan holds no frame that ends at the partition's end and starts before it: both quotes come from growing frames."""
    from tidemark.operators import asof

    t = spark.createDataFrame([(s, i, i, float(i), "buy") for s in "ab" for i in range(50)], "symbol string, t long, seq long, price double, side string").withColumn("ts", F.timestamp_seconds("t"))
    made = asof.bracket_quotes(t, t, spark.createDataFrame([("a", "b")], "i string, j string"))
    assert "unboundedfollowing" not in made._jdf.queryExecution().toString().lower().replace(" ", "").replace("$", "")
    assert {(r.ts.second + 60 * r.ts.minute, r.before, r.after) for r in made.collect()} == {(i, i - 1.0 if i else None, i + 1.0 if i < 49 else None) for i in range(50)}


def test_basket_closes_at_its_profit(spark):
    from tidemark.operators import portfolio

    rows = [("a", i, float(p), i == 0, False, False, False) for i, p in enumerate([100, 101, 104, 90, 90])]
    s = spark.createDataFrame(rows, "symbol string, t long, close double, entries boolean, exits boolean, short_entries boolean, short_exits boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = portfolio.simulate(s, 1000.0, 0.0, 1, take_profit=0.03).orderBy("ts").collect()
    assert [round(r.position, 6) for r in got] == [10, 10, 0, 0, 0] and got[-1].equity == pytest.approx(1040)
    assert portfolio.simulate(s, 1000.0, 0.0, 1).orderBy("ts").collect()[-1].equity == pytest.approx(900)


def test_running_values_compose_over_blocks(spark):
    """Blocks of any length give what one window over all rows gives; null keys, null values and blocks without values too."""
    from tidemark.operators import scan

    draw = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else f"s{i % 3}", int(t), i, None if draw.random() < 0.6 else int(draw.integers(1, 50))) for i, t in enumerate(draw.integers(0, 400, 300))]
    df = spark.createDataFrame(rows, "symbol string, t int, seq int, v int")
    w = Window.partitionBy("symbol").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before, after = (Window.partitionBy("symbol").orderBy(c).rangeBetween(Window.unboundedPreceding, -1) for c in (F.col("t"), -F.col("t")))
    want = df.select("seq", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("sum"), F.last("v", True).over(w).alias("last"))
    for width in (1, 13, 90, 1000):
        block = F.floor(F.col("t") / width)
        made = scan.running_sum(df, ["symbol"], ["t", "seq"], F.coalesce("v", F.lit(0)), block, "sum")
        made = scan.running_last(made, ["symbol"], [F.col("t"), F.col("seq")], "v", block, "last")
        assert sorted(map(tuple, made.select("seq", "sum", "last").collect())) == sorted(map(tuple, want.collect()))
        one = df.groupBy("symbol", "t").agg(F.max("v").alias("v"))
        both = scan.running_last(one, ["symbol"], [F.col("t")], "v", block, "b", rows=False)
        both = scan.running_last(both, ["symbol"], [-F.col("t")], "v", block, "a", forward=False, rows=False).collect()
        plain = one.withColumns({"b": F.last("v", True).over(before), "a": F.last("v", True).over(after)}).select("symbol", "t", "v", "b", "a").collect()
        assert {tuple(r) for r in both} == {tuple(r) for r in plain}


def wide_bars(spark, seed):
    """Bars of three symbols, some of them as wide as a reversal; Z goes nowhere for hundreds of bars, and one has a single bar."""
    rng, rows = random.Random(seed), [("one", 0, 5.0, 5.0)]
    for s, vol, wide in (("A", 0.01, 0.0), ("B", 0.004, 0.02), ("Z", 0.0002, 0.0)):
        x = 100.0
        for k in range(700):
            x *= 1 + rng.gauss(0, vol)
            rows.append((s, k, round(x * (1 + abs(rng.gauss(0, wide))), 1 + 2 * (s == "Z")), round(x * (1 - abs(rng.gauss(0, wide))), 1 + 2 * (s == "Z"))))
    rng.shuffle(rows)
    return spark.createDataFrame([*rows, (None, 0, 5.0, 5.0), (None, 1, 6.0, 5.9)], "symbol string, bar_idx long, high double, low double"), rows


@pytest.mark.parametrize("block", [60, 200, 4096])
def test_swings_in_blocks(spark, block):
    bars_, rows = wide_bars(spark, block)
    want = []
    for s in ("A", "B", "Z"):
        chain, n = swings.ZigZag(0.02), 0
        for _, _, high, low in sorted(r for r in rows if r[0] == s):
            if p := chain.push(high, low):
                want.append((s, n, *p))
                n += 1
    assert len(want) > 100
    got = swings.zigzag(bars_, 0.02, block).collect()
    assert sorted(tuple(r) for r in got if r.symbol) == want
    assert [tuple(r) for r in got if r.symbol is None] == [(None, 0, 0, 5.0, "L", 1)]
    assert swings.zigzag(bars_.limit(0), 0.02, block).count() == 0


def test_block_summaries_tell_the_next_leg():
    """For random blocks and the legs that truly enter them: a summary tells the leg after the block, or says that it cannot."""
    told = 0
    for seed in range(300):
        rng, x, rows = random.Random(seed), 100.0, []
        vol, wide, pct, size = rng.choice([0.001, 0.01, 0.03]), rng.choice([0, 0.002, 0.03]), rng.choice([0.005, 0.02]), rng.choice([1, 3, 20, 50])
        for k in range(200):
            x *= 1 + rng.gauss(0, vol)
            rows.append((k, round(x * (1 + abs(rng.gauss(0, wide))), seed % 3), round(x * (1 - abs(rng.gauss(0, wide))), seed % 3)))
        legs = []
        for b in range(0, len(rows), size):
            entered, made = [dataclasses.astuple(leg) for leg in legs], swings._summary(rows[b : b + size], pct)
            _, legs = swings._run(rows[b : b + size], pct, legs)
            after = swings._through(json.loads(json.dumps(made)), entered, pct) if entered else None
            assert after is None or after == [dataclasses.astuple(leg) for leg in legs]
            told += after is not None
    assert told > 5000


def test_planted_profiles(spark):
    """Each shape is found again with its parameters from cells with a little noise, and named as the first that passes."""
    p, rng = np.round(np.arange(5.5, 6.1, 0.01), 2), np.random.default_rng(3)
    j = lambda z: np.array([np.cos(v * np.sin((np.arange(2000) + 0.5) * math.pi / 2000)).mean() for v in z])
    planted = {"one": (0.1065 * np.abs(j(31.677 * (p - 5.742))), "one_centre"), "two": (0.13 * (np.abs(j(90 * (p - 5.6))) + np.abs(j(90 * (p - 5.93)))), None)}
    rows = [(name, float(a), float(max(0.0, b + rng.normal(0, 1e-4)))) for name, (y, *_) in planted.items() for a, b in zip(p, y, strict=True)]
    rows += [("flat", 5.0, 1.0), ("flat", 6.0, 1.0), ("single", 5.0, 1.0), ("nothing", 5.0, 0.0), ("nothing", 6.0, None), (None, 5.0, 0.2), (None, 6.0, 0.8)]
    got = {r.name: r for r in waves.wave_profiles(spark.createDataFrame(rows, "name string, price double, share double"), ["name"]).collect()}
    assert (got["one"].model, got["one"].passed) == ("one_centre", True) and (got["one"].omega, got["one"].p0, got["one"].c) == (pytest.approx(31.677, rel=1e-2), pytest.approx(5.742, abs=1e-3), pytest.approx(0.1065, rel=1e-2))
    assert all(got[k].model == "none" and not got[k].passed for k in ("flat", "single", "nothing")) and not got[None].passed
    span = np.ptp(p)
    x = (p - p.min()) / span
    for name, true, before in (("two_centres", (25.0, 0.2, 0.75), ()), ("two_widths", (30.0, 9.0, 0.2, 0.7), (16.0, 0.2, 0.7)), ("random_day", (7.0, 0.4), ())):
        shape, n = waves.SHAPES[name]
        y = 0.2 * shape(x, *true)
        error, c, found = waves._fit(shape, n, x, y, waves._starts(name, x, y, before))
        assert error < 1e-6 and c == pytest.approx(0.2, rel=1e-2), (name, error, c, found)
        assert sorted(found) == pytest.approx(sorted(true), rel=1e-2)
    # the worked values: sample 600005's curve, and quantiles of the beta law with two parameters, 1 - 0.05 ** (2 / (n - 3))
    assert 0.11529 * waves.random_day(np.array([6.10]), 29.694, 6.15089)[0] == pytest.approx(0.0514, abs=1e-4)
    assert waves.critical_r2(23, 2) == pytest.approx(1 - 0.05 ** (2 / 20), abs=1e-4) and math.isnan(waves.critical_r2(3, 2))


def test_jumped_equilibrium_takes_two_centres():
    """Narrow peaks far apart and noise on many cells: the one centre explains less, and each fit's worth is that of its parameters."""
    p = np.arange(0, 1.0, 0.01)
    y = waves.two_centres(p, 55.0, 0.1, 0.85)
    error = {name: waves._fit(*waves.SHAPES[name], p, y, waves._starts(name, p, y, ()))[0] for name in ("one_centre", "two_centres")}
    assert error["two_centres"] < 1e-6 < 0.1 * error["one_centre"]
    fit = waves.fit_profile(p + 10, y + 0.3 * np.random.default_rng(1).random(100))
    assert fit["cells"] == 100 and fit["model"] in waves.SHAPES and fit["critical"] == pytest.approx(waves.critical_r2(100, 3 if fit["model"] in ("one_centre", "random_day") else 4), abs=0.03)


def test_t_law_of_odd_groups(spark):
    """A planted law is found again; groups that have none give nulls; no key and no rows work."""
    rng = np.random.default_rng(5)
    x = (3 + 0.5 * rng.standard_t(2.5, 4000)).tolist()
    rows = [("t", v) for v in x] + [("same", 1.0)] * 5 + [("few", 1.0), ("few", 2.0), ("null", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in laws.t_law(df, "x", ["g"]).collect()}
    assert (got["t"].mu, got["t"].sigma, got["t"].beta, got["t"].n) == (pytest.approx(3, abs=0.05), pytest.approx(0.5, rel=0.1), pytest.approx(2.5, rel=0.15), 4000)
    assert all(got[g].mu is None and got[g].beta is None for g in ("same", "few", None)) and "null" not in got
    whole = laws.t_law(df.where("g = 't'"), "x", []).first()
    assert whole.loglik == pytest.approx(got["t"].loglik, abs=1e-6)
    assert laws.t_law(df.limit(0), "x", ["g"]).count() == 0


def test_responses_of_shared_quotes(spark):
    """Two trades between the same quotes are multiple; the weighted response is the mean of both kinds, which is that of all."""
    t = spark.createDataFrame([("b", 10, 1, "buy", 100), ("b", 30, 2, "sell", 300), ("b", 32, 3, "buy", 200), ("b", 50, 4, "sell", None)], "symbol string, s long, seq long, side string, volume long")
    q = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 20, 2, 11.0), ("a", 40, 3, 9.0), ("a", 60, 4, 12.0)], "symbol string, s long, seq long, price double")
    t, q = (f.withColumn("ts", F.timestamp_seconds("s")) for f in (t, q))
    pairs = spark.createDataFrame([("a", "b")], "i string, j string")
    got = {r.attribute: r for r in micro.response_cases(asof.bracket_quotes(t, q, pairs, ["volume"], True), t, q).collect()}
    dx, sx = np.array([1.0, -2.0, -2.0]), np.std([10.0, 11.0, 9.0, 12.0])
    for name, y in {"sign": [1, -1, 1], "volume": [100, 300, 200], "signed_volume": [100, -300, 200]}.items():
        each = dx / sx * (np.array(y) - np.mean(y)) / np.std(y)
        r = got[name]
        assert (r.single, r.multiple, r.weight, r.n) == (pytest.approx(each[0]), pytest.approx(each[1:].mean()), pytest.approx(1 / 3), 3)
        assert r.weighted == pytest.approx(each.mean()) and r.all_trades == pytest.approx(each.mean())
