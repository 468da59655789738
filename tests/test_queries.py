import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import micro, signals as S
from tidemark.plans import models, studies
from tidemark.plans.queries import QUERIES, SQL, daily, returns
from tidemark.plans.views import bars, trades

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [q for q in QUERIES if q in SQL])
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def check_synthetic_rates(got, spark):
    r = got.iloc[0]
    # published rates of 200,000 draws
    assert r.relabel == pytest.approx(1 / 24, abs=0.002) and r["median"] == pytest.approx(0.163, abs=0.004) and r.over_one == pytest.approx(0.065, abs=0.003)
    assert r.clip_up == pytest.approx(0.0774, abs=0.003) and r.clip_down == pytest.approx(0.0793, abs=0.003) and r.clip_any == pytest.approx(0.1567, abs=0.004)
    assert r.fullest_bin == 60 and r.fullest_n == pytest.approx(0.0784 * 200_000, rel=0.05)  # clipped to the high: a ratio of 1


def check_power_law_test(got, spark):
    best = QUERIES["power_law_best"](spark, SF).toPandas().iloc[0]
    r = got.iloc[0]
    assert (r.x_min, r.n) == (best.x_min, best.n) and r.delta == pytest.approx(best.delta, abs=1e-6) and r.ks == pytest.approx(best.ks, abs=1e-6)
    far = []
    for i in range(100):
        x = np.sort(r.x_min * np.random.default_rng([1, i]).random(int(r.n)) ** (-1 / (r.delta - 1)))
        own = []
        for cut in sorted({r.x_min, *(c for c in (0.002, 0.003, 0.004, 0.006) if c > r.x_min)}):
            v = x[x >= cut] / cut
            if len(v) >= 10 or cut == r.x_min:
                delta = 1 + len(v) / np.log(v).sum()
                law = 1 - v ** (1 - delta)
                own.append(max(np.abs(np.arange(1, len(v) + 1) / len(v) - law).max(), np.abs(np.arange(len(v)) / len(v) - law).max()))
        far.append(min(own) > r.ks)
    assert r.p == pytest.approx(np.mean(far))


def check_response_spectrum(got, spark):
    edges = studies.impact(spark, SF, 1.5).toPandas()
    want = np.linalg.svd(edges.pivot(index="i", columns="j", values="mean").fillna(0).to_numpy())[1]
    assert sorted(got.singular) == pytest.approx(sorted(want))


def check_warping_distances(got, spark):
    bars_ = bars(spark, SF).toPandas().sort_values("bar_idx")
    z = {s: ((g.close - g.close.mean()) / g.close.std(ddof=0)).to_numpy() for s, g in bars_.groupby("symbol")}
    assert len(got) == len(z) * (len(z) - 1) / 2
    for r in got.itertuples():
        a, b = z[r.i], z[r.j]
        wide = max(20, abs(len(a) - len(b)))
        cost = {(0, 0): 0.0}
        for i in range(1, len(a) + 1):
            for j in range(max(1, i - wide), min(len(b), i + wide) + 1):
                cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost.get((i - 1, j), math.inf), cost.get((i, j - 1), math.inf), cost.get((i - 1, j - 1), math.inf))
        assert r.dtw == pytest.approx(cost[len(a), len(b)])


def check_pnl_weights(got, spark):
    x = daily(spark, SF).where("ret is not null and fwd is not null").toPandas()
    rows, y = np.column_stack([x.ret * 100, np.log(x.volume) - 7]), x.fwd.to_numpy() * 100

    def loss(w):
        s = rows @ w
        h = np.sqrt(s * s + 1e-3)
        return -(y * h * np.tanh(5 * s)).sum() / h.sum() + 1e-3 * np.sqrt(w * w + 1e-3).sum()

    w, m, v = np.full(2, 0.1), np.zeros(2), np.zeros(2)
    for k in range(1, 11):
        g = np.array([(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(2) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert dict(zip(got.feature, got.weight, strict=True)) == pytest.approx({"r": w[0], "v": w[1]}, abs=1e-4)


def check_bessel_profiles(got, spark):
    cells = micro.volume_profile(trades(spark, SF).withColumn("price", F.round(F.col("price") / 5) * 5), ["symbol"]).toPandas()
    t = (np.arange(4000) + 0.5) * math.pi / 4000
    assert set(got.symbol) == set(cells.symbol)
    for r in got.itertuples():
        p, y = cells[cells.symbol == r.symbol].price.to_numpy(), cells[cells.symbol == r.symbol].share.to_numpy()
        total, width = ((y - y.mean()) ** 2).sum(), max(np.ptp(p), 1e-9)
        r2 = lambda omega, p0: 1 - min(((y - c * f) ** 2).sum() for f in [np.abs(np.cos(omega * (p - p0)[:, None] * np.sin(t)).mean(1))] for c in [(f * y).sum() / (f * f).sum()]) / total  # noqa: B023, E731
        assert r.r2 == pytest.approx(r2(r.omega, r.p0), abs=1e-3)
        centre = (p * y).sum() / y.sum()
        assert r.r2 >= max(r2(o, c) for o in np.linspace(0.5 / width, 60 / width, 12) for c in (centre - width / 8, centre, centre + width / 8)) - 0.02


def check_hawkes_fits(got, spark):
    t = trades(spark, SF).selectExpr("symbol", "unix_micros(ts) / 6e7 t").toPandas()

    def loglik(x, mu, nu, alpha):
        gaps = x[:, None] - x[None]
        held = np.where(np.tril(np.ones((len(x),) * 2, bool), -1), np.exp(-alpha * np.maximum(gaps, 0)), 0).sum(1)
        return np.log(mu + nu * alpha * held).sum() - mu * (x[-1] - x[0]) - nu * (1 - np.exp(-alpha * (x[-1] - x))).sum()

    for r in got.itertuples():
        x = np.sort(t[t.symbol == r.symbol].t.to_numpy())
        assert r.n == len(x) and r.loglik == pytest.approx(loglik(x, r.mu, r.nu, r.alpha), rel=1e-6)
        assert all(r.loglik >= loglik(x, r.mu * a, r.nu * b, r.alpha) - 0.05 for a, b in ((0.8, 1), (1.25, 1)))


def check_volatility_clusters(got, spark):
    x = got[["rv", "volume"]].to_numpy()
    centres = {k: x[got.cluster == k].mean(0) for k in set(got.cluster)}
    assert len(centres) == 3
    nearest = [min(centres, key=lambda k: ((row - centres[k]) ** 2).sum()) for row in x]
    assert np.mean(got.cluster.to_numpy() == nearest) > 0.97


def plain_net(x, y, seed, hidden, rounds):
    """Weights of one tanh layer by the same method, its error and slope written out layer by layer."""
    inputs = x.shape[1]
    net = S.TanhLayer(inputs, hidden)

    def objective(w):
        first, second = w[: hidden * (inputs + 1)].reshape(hidden, inputs + 1), w[hidden * (inputs + 1) :]
        inner = np.tanh(np.einsum("ni,hi->nh", x, first[:, :inputs]) + first[:, inputs])
        miss = inner @ second[:hidden] + second[hidden] - y
        back = np.outer(miss, second[:hidden]) * (1 - inner**2) / len(y)
        slope = np.hstack([np.einsum("nh,ni->hi", back, x), back.sum(0)[:, None]]).ravel()
        return (miss**2).sum() / (2 * len(y)), np.concatenate([slope, inner.T @ miss / len(y), [miss.mean()]])

    w, _ = S.scaled_conjugate(objective, net.start(seed), rounds)
    first, second = w[: hidden * (inputs + 1)].reshape(hidden, inputs + 1), w[hidden * (inputs + 1) :]
    return lambda z: np.tanh(z @ first[:, :inputs].T + first[:, inputs]) @ second[:hidden] + second[hidden]


def check_composite_strategy(got, spark):
    """Features, training, forecasts, signals and admission of every symbol in plain Python.  The query's 200 rounds carry the last bits of
    the sums to the front, so forecasts are compared after 12 rounds, and the query's signals and verdicts with its own forecasts."""
    sf = SF.replace("0.001", "0.01")  # the smaller table ends with the training bars
    few = S.composite(bars(spark, sf), 120, forecast=lambda rows, cols: S.net_forecast(rows, cols, 500, 12)).toPandas()
    walk_composite(few, spark, sf, 12)
    walk_composite(QUERIES["composite_strategy"](spark, sf).toPandas(), spark, sf, None)


def walk_composite(got, spark, sf, rounds):
    b = bars(spark, sf).toPandas().sort_values("bar_idx")
    assert len(got) and not got.exits.any() and not got.short_exits.any()
    for symbol, g in b.groupby("symbol"):
        raw = g[["open", "high", "low", "close", "volume"]].to_numpy(float)
        x, y = raw[:-1], raw[1:, 3]
        mx, sx, my, sy = x[:120].mean(0), x[:120].std(0), y[:120].mean(), y[:120].std()
        pred = plain_net((x[:120] - mx) / sx, (y[:120] - my) / sy, 0, 500, rounds or 1)((x - mx) / sx) * sy + my  # pred[k] is of bar k + 1, made at bar k
        own = got[got.symbol == symbol].set_index("bar_idx").sort_index()
        assert own.index.tolist() == list(range(121, len(g) - 2))  # the first and last forecasts have no bar before or behind them
        opened = {1: [], -1: []}
        for k, r in own.iterrows():
            close, before = raw[k, 3], raw[k - 1, 3]
            d1, d2 = pred[k] - close, pred[k] - 2 * close + before
            assert rounds is None or (r.d1, r.d2) == pytest.approx((d1, d2), abs=2e-4)
            assert r.d2 - r.d1 == pytest.approx(before - close, abs=1e-6)
            want = 1 if r.d1 > 0 and r.d2 > 0 else -1 if r.d1 < 0 and r.d2 < 0 else 0
            assert r.signal == want
            verdict = None
            if want:
                same = opened[want]
                verdict = "cap" if sum(map(len, opened.values())) >= 13 else "time" if same and k - same[-1][0] <= 15 else "price" if any(abs(p - close) <= 1e-4 * close for _, p in same) else "admitted"
                if verdict == "admitted":
                    same.append((k, close))
            assert (r.verdict if want else None) == verdict and (want or r.verdict is None or r.verdict != r.verdict)
            assert r.entries == (verdict == "admitted" and want == 1) and r.short_entries == (verdict == "admitted" and want == -1)


def plain_irls(x, y, family, rounds=60):
    beta = np.zeros(x.shape[1])
    for k in range(rounds):
        eta = np.full(len(y), math.log(y.mean())) if family == "gamma" and k == 0 else np.clip(x @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(p * (1 - p), 1e-10) if family == "logit" else np.ones(len(y))
        z = eta + ((y - p) / w if family == "logit" else y / np.exp(eta) - 1)
        gram = (x * w[:, None]).T @ x
        new = np.linalg.solve(gram + 1e-9 * max(np.trace(gram) / len(beta), 1) * np.eye(len(beta)), (x * w[:, None]).T @ z)
        done, beta = np.abs(new - beta).max() < 1e-11, new
        if done:
            break
    return beta


def check_strategy_failure(got, spark):
    s = models.strategies(spark, SF).toPandas().dropna()
    x = np.column_stack([np.ones(len(s)), s.proforma, s.regime])
    beta = plain_irls(x, s.failed.to_numpy(float), "logit")
    assert dict(zip(got.feature, got.coef, strict=True)) == pytest.approx(dict(zip(["intercept", "proforma", "regime"], beta, strict=True)), abs=2e-6)
    assert (got.n == len(s)).all() and 0 < s.failed.mean() < 1


def plain_gaps(f, y, points):
    x = np.column_stack([np.ones(len(f)), f.rv, f.mom, f.d, f.d * f.rv, f.d * f.mom])
    nu, up = plain_irls(x, (y <= 0).astype(float), "logit", 25), y > 0
    mu = plain_irls(x[up], y[up], "gamma", 25)
    s2 = ((y[up] / np.exp(np.clip(x[up] @ mu, -30, 30)) - 1) ** 2).sum() / max(up.sum() - 6, 1)
    out = {}
    for r in points.itertuples():
        e, v = [], []
        for d in (0.0, 1.0):
            z = np.array([1, r.rv, r.mom, d, d * r.rv, d * r.mom])
            zero, mean = 1 / (1 + math.exp(-z @ nu)), math.exp(z @ mu)
            e.append((1 - zero) * mean)
            v.append((1 - zero) * mean**2 * (s2 + zero))
        out[r.point] = (e[1] - e[0], v[1] - v[0])
    return out, nu, mu, s2, x


def check_regime_gaps(got, spark):
    f = models.fold_scores(spark, SF).toPandas()
    points = got[["point", "rv", "mom"]].drop_duplicates()
    exact = models.regime_points(models.fold_scores(spark, SF)).toPandas()
    assert sorted(points.point) == sorted(exact.point) and 0 < (f.y == 0).mean() < 1
    want, nu, mu, s2, x = plain_gaps(f, f.y.to_numpy(), exact)
    for r in got.itertuples():
        assert r.gap_mean == pytest.approx(want[r.point][0], rel=1e-5, abs=1e-9) and r.gap_variance == pytest.approx(want[r.point][1], rel=1e-5, abs=1e-9)
    ahead = {p: [] for p in want}
    for k in range(20):
        drawn = np.zeros(len(f))
        for i, row in enumerate(f.row):
            rng = np.random.default_rng([1, int(row), k])
            if rng.random() >= 1 / (1 + math.exp(-(x[i] @ nu))):
                drawn[i] = rng.gamma(1 / s2, math.exp(x[i] @ mu) * s2)
        for p, (gap, _) in plain_gaps(f, drawn, exact)[0].items():
            ahead[p].append(gap > 0)
    # a table whose gap is next to nothing may fall on either side
    assert all(r.replicas == 20 and abs(r.ahead - np.mean(ahead[r.point])) <= 0.051 for r in got.itertuples())


def check_arma_baseline(got, spark):
    b = plain_returns(spark).sort_values("bar_idx")
    for r in got.itertuples():
        x = b[b.symbol == r.symbol].ret.to_numpy() * 100
        long = np.column_stack([np.ones(len(x) - 6), *[x[6 - i : len(x) - i] for i in range(1, 7)]])
        e = np.full(len(x), np.nan)
        e[6:] = x[6:] - long @ np.linalg.lstsq(long, x[6:], rcond=None)[0]
        z = np.column_stack([np.ones(len(x) - 7), x[6:-1], e[6:-1]])
        beta = np.linalg.lstsq(z, x[7:], rcond=None)[0]
        f = z @ beta
        assert (r.constant, r.ar, r.ma) == pytest.approx(tuple(beta), abs=1e-5) and r.n == len(f)
        assert r.rmse == pytest.approx(np.sqrt(((x[7:] - f) ** 2).mean()), abs=1e-5) and r.rmse <= r.rmse_none + 1e-6
        assert r.rmse_none == pytest.approx(np.sqrt((x[7:] ** 2).mean()), abs=1e-5) and r.directional == pytest.approx((np.sign(x[7:]) == np.sign(f)).mean(), abs=1e-5)


def plain_returns(spark):
    from tidemark.plans.queries import returns

    return returns(spark, SF).toPandas()


def check_component_shares(got, spark):
    wide = plain_returns(spark).pivot(index="bar_idx", columns="symbol", values="ret").dropna()
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(wide.to_numpy().T)))[::-1]
    assert got.sort_values("component").share.to_numpy() == pytest.approx(values / values.sum(), abs=1e-9)


def check_svm_signals(got, spark):
    """Each fold's machine by gradient descent with halved steps, to within a thousandth of its loss; cuts and signals from that of the query's method."""
    rows = models.svm_rows(spark, SF).toPandas()
    assert len(got) and not got.duplicated(["symbol", "fold"]).any()
    for r in got.itertuples():
        g = rows[(rows.symbol == r.symbol) & (rows.fold == r.fold)].sort_values("bar_idx")
        x, y = np.column_stack([np.ones(len(g)), g.x1, g.x2, g.x3]), g.side.to_numpy()
        train = g.training.to_numpy()
        loss = lambda w: (np.maximum(0, 1 - y[train] * (x[train] @ w)) ** 2).sum() + w @ w  # noqa: B023, E731
        beta = np.zeros(4)
        for _ in range(25):
            inside = train & (y * (x @ beta) < 1)
            gram = x[inside].T @ x[inside]
            new = np.linalg.solve(gram + (1 + 1e-9 * max(np.trace(gram) / 4, 1)) * np.eye(4), x[inside].T @ y[inside])
            done, beta = np.abs(new - beta).max() < 1e-9, new
            if done:
                break
        w, size = np.zeros(4), 0.1
        for _ in range(400):
            slope = 2 * w - 2 * x[train].T @ (np.maximum(0, 1 - y[train] * (x[train] @ w)) * y[train])
            while size > 1e-9 and loss(w - size * slope) > loss(w) - 0.3 * size * slope @ slope:
                size /= 2
            w, size = w - size * slope, size * 1.5
        assert loss(beta) <= loss(w) * 1.001
        score = x @ beta
        low, high = np.percentile(score[train], [40, 60])
        sign = np.where(score > high + 1e-9, 1, np.where(score < low - 1e-9, -1, 0))[~train]
        assert (r.low, r.high) == pytest.approx((low, high), abs=2e-6) and r.n == train.sum()
        assert (r.longs, r.shorts) == ((sign == 1).sum(), (sign == -1).sum()) and r.mean_return == pytest.approx((sign * g.ret.to_numpy()[~train]).mean(), abs=2e-6)


def check_hawkes_network(got, spark):
    moves = models.quote_moves(spark, SF).toPandas()
    names = sorted(moves.channel.unique())
    for symbol, g in moves.groupby("symbol"):
        t, c = g.t.to_numpy(), np.array([names.index(x) for x in g.channel])
        w = g["mark"].to_numpy() ** 0.5
        w = w / np.array([w[c == k].mean() for k in range(4)])[c]
        lo, hi, n = t.min(), t.max(), np.bincount(c, minlength=4)
        fed = np.array([[(names[j], names[i]) in models.FEEDS for j in range(4)] for i in range(4)])
        mu, nu, al = n / (hi - lo) / 2, np.where(fed, 0.25, 0.0), np.full(4, len(t) / (hi - lo))
        gap = t[:, None] - t[None]
        for _ in range(8):
            s, a = np.zeros((len(t), 4)), np.zeros((len(t), 4))
            for j in range(4):
                m = (gap > 0) & (c[None] == j)
                e = np.where(m, w[None] * np.exp(-al[j] * np.where(m, gap, 0)), 0)
                s[:, j], a[:, j] = e.sum(1), (e * gap).sum(1)
            part = nu[c] * al * s
            rate = mu[c] + part.sum(1)
            p, mass = part / rate[:, None], np.array([(w[c == j] * (1 - np.exp(-al[j] * (hi - t[c == j])))).sum() for j in range(4)])
            mu = np.array([(mu[i] / rate[c == i]).sum() for i in range(4)]) / (hi - lo)
            nu = np.array([[p[c == i, j].sum() / mass[j] for j in range(4)] for i in range(4)])
            al = np.array([p[:, j].sum() / (p[:, j] * np.where(s[:, j] > 0, a[:, j] / np.maximum(s[:, j], 1e-300), 0)).sum() for j in range(4)])
        radius = np.abs(np.linalg.eigvals(nu)).max()
        for r in got[got.symbol == symbol].itertuples():
            i, j = names.index(r.channel), names.index(r.source)
            assert (r.mu, r.nu, r.alpha, r.radius) == pytest.approx((mu[i], nu[i, j], al[j], radius), abs=3e-6, rel=1e-4)
            assert 0 <= r.radius < 1 and r.residual == pytest.approx(1, abs=0.1) and r.n == n[i]


def plain_profit(bars_, size):
    """Profit of one grid size on one symbol's bars, leg by leg."""
    levels = [500.0]
    while levels[-1] <= 2000:
        levels.append(levels[-1] * (1 + size))
    levels = np.array(levels)
    below = lambda x: int((levels < x).sum())
    at = max(int((levels <= bars_[0][0]).sum()) - 1, 0)
    trades, before = 0, bars_[0][0]
    for _, low, high, close in bars_:
        for a, b in ((before, low), (low, high), (high, close)):
            to = at if a == b else max(at, below(b) - 1) if a < b else min(at, below(b))
            trades, at = trades + abs(to - at), to
        before = close
    fake = abs(below(bars_[0][0]) - below(bars_[-1][3]))
    return 100 / (len(levels) - 1) * (size - 2 * 0.0008) * (trades - fake) / 2


def check_grid_search(got, spark):
    """The size found is worth what a plain walk over the bars says, and no less than 97 % of the best of all sizes of three digits."""
    b = bars(spark, SF).toPandas().sort_values("bar_idx")
    assert len(got) == b.symbol.nunique()
    for r in got.itertuples():
        own = b[b.symbol == r.symbol][["open", "low", "high", "close"]].to_numpy().tolist()
        assert 0.003 <= r.grid_size <= 0.1 and r.profit == pytest.approx(plain_profit(own, r.grid_size), rel=1e-9)
        assert r.profit >= 0.97 * max(plain_profit(own, round(0.003 + k / 1000, 3)) for k in range(98)), r.symbol


def check_wave_profiles(got, spark):
    """The fit is worth what its parameters say, no worse than a grid of one-centre curves, and significant where it says so."""
    t = trades(spark, SF).toPandas().dropna(subset=["volume"])
    t["week"] = (t.ts.dt.normalize() - pd.to_timedelta(t.ts.dt.weekday, unit="D")).dt.strftime("%Y-%m-%d")
    cells = t.assign(price=np.floor(t.price + 0.5)).groupby(["symbol", "week", "price"]).volume.sum().reset_index()
    assert len(got) == len(cells[["symbol", "week"]].drop_duplicates())
    angle = (np.arange(3000) + 0.5) * math.pi / 3000
    j = lambda w, a, p: np.abs(np.cos(w * (p - a)[:, None] * np.sin(angle)).mean(1))
    for r in got[got.model != "none"].sample(min(25, len(got)), random_state=1).itertuples():
        own = cells[(cells.symbol == r.symbol) & (cells.week == r.week)]
        p, y = own.price.to_numpy(), (own.volume / own.volume.sum()).to_numpy()
        total = ((y - y.mean()) ** 2).sum()
        x = r.omega * np.abs(p - r.p0)
        f = {"one_centre": lambda: j(r.omega, r.p0, p), "two_centres": lambda: j(r.omega, r.p0, p) + j(r.omega, r.p02, p), "two_widths": lambda: j(r.omega, r.p0, p) + j(r.omega2, r.p02, p), "random_day": lambda: np.exp(-x) * np.abs(1 - 2 * x)}[r.model]()  # noqa: B023
        assert r.cells == len(p) and r.r2 == pytest.approx(1 - ((y - r.c * f) ** 2).sum() / total, abs=1e-4) and r.passed == (r.r2 > r.critical)
        if r.model == "one_centre":
            grid_ = [1 - ((y - (g * y).sum() / (g * g).sum() * g) ** 2).sum() / total for w in np.geomspace(1, 40, 9) / np.ptp(p) for a in np.linspace(p.min(), p.max(), 5) for g in [j(w, a, p)]]
            assert r.r2 >= max(grid_) - 0.05


def t_loglik(x, mu, sigma, beta):
    z = (x - mu) / sigma
    return float((math.lgamma((beta + 1) / 2) - math.lgamma(beta / 2) - 0.5 * math.log(beta * math.pi) - math.log(sigma) - (beta + 1) / 2 * np.log1p(z * z / beta)).sum())


def same_law(r, x):
    """The likelihood is that of the values, and none near the law found or on a wide grid is above it."""
    top = t_loglik(x, r.mu, r.sigma, r.beta)
    assert r.n == len(x) and r.loglik == pytest.approx(top, abs=1e-6)
    near = [t_loglik(x, r.mu + a * r.sigma, r.sigma * math.exp(b), min(200.0, r.beta * math.exp(c))) for a in (-0.02, 0, 0.02) for b in (-0.02, 0, 0.02) for c in (-0.05, 0, 0.05)]
    wide = [t_loglik(x, m, s * x.std(), b) for m in (np.median(x), x.mean()) for s in np.linspace(0.1, 1.2, 23) for b in (0.5, 1, 2, 3, 5, 10, 30, 200)]
    assert top >= max(near + wide) - 1e-6


def check_return_law(got, spark):
    x = returns(spark, SF).select("symbol", "ret").toPandas().dropna()
    assert set(got.symbol) == set(x.symbol)
    for r in got.itertuples():
        same_law(r, x[x.symbol == r.symbol].ret.to_numpy() * 100)


def check_spectrum_law(got, spark):
    edges = studies.impact(spark, SF, 1.5).toPandas()
    u, _, vt = np.linalg.svd(edges.pivot(index="i", columns="j", values="mean").fillna(0).to_numpy())
    for r in got.itertuples():
        same_law(r, (u if r.side == "left" else vt).ravel())
    assert sorted(got.side) == ["left", "right"]


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SQL])
def test_query_without_sql_equals_its_plain_version(spark, name):
    globals()[f"check_{name}"](QUERIES[name](spark, SF).toPandas(), spark)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
