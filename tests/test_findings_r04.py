"""One small test for each finding of the round that was right."""

import math

import numpy as np
import pytest

from tests.test_queries import same_law
from tidemark.plans import models, studies  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL, daily, returns


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


def test_spectrum_of_returns_across_zero(spark, across_zero):
    x = daily(spark, across_zero[0]).toPandas()
    assert np.isnan(x.ret[x.day > x.day.min()].astype(float)).any()
    names, mean = sorted(set(x.symbol)), {}
    for i in names:
        for j in names:
            both = x[x.symbol == i].merge(x[x.symbol == j], on="day")
            v = [math.copysign(1, a) * b if a else 0.0 for a, b in zip(both.ret_x, both.fwd_y, strict=True) if not math.isnan(a) and math.isfinite(b)]
            mean[i, j] = np.mean(v) if v else 0.0
    want = np.linalg.svd(np.array([[mean[i, j] for j in names] for i in names]))[1]
    assert [r.singular for r in QUERIES["response_spectrum"](spark, across_zero[0]).orderBy("k").collect()] == pytest.approx(list(want))


def test_laws_of_returns_across_zero(spark, across_zero):
    x = returns(spark, across_zero[0]).select("symbol", "ret").toPandas()
    assert not np.isfinite(x.ret).all()
    for r in QUERIES["return_law"](spark, across_zero[0]).collect():
        same_law(r, x[(x.symbol == r.symbol) & np.isfinite(x.ret)].ret.to_numpy() * 100)


def test_laws_of_vectors_across_zero(spark, across_zero):
    x = models.spectrum_entries(spark, across_zero[0]).toPandas()
    assert np.isfinite(x.x).all() and len(x) == 50
    for r in QUERIES["spectrum_law"](spark, across_zero[0]).collect():
        same_law(r, x[x.side == r.side].x.to_numpy())


@pytest.fixture(scope="module")
def odd_prices(tmp_path_factory):
    """Trades every ten minutes whose prices are far apart, negative, or zero, and one symbol that moves little."""
    import duckdb

    rng, events = np.random.default_rng(2), []
    for symbol, prices in (("click", [-40000, 0, 30000, 90000, 110000, 260000]), ("view", [99000, 100000, 101000])):
        at = 100_000
        for k in range(1500):
            to = int(rng.choice(prices)) if rng.random() < 0.3 else at
            events.append((len(events) * 2 + (to < at), k * 10, symbol, abs(to - at) / 2))
            at = to
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    folder = tmp_path_factory.mktemp("odd")
    con.execute("CREATE TABLE made (event_id BIGINT, minute BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?, ?)", events)
    con.execute(f"""COPY (SELECT event_id, TIMESTAMP '2024-01-01' + minute * INTERVAL '1 minute' AS ts, event_id % 7 AS user_id, event_type, value, '{{"k": ' || (event_id % 50 + 1) || '}}' AS props FROM made) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


def told_apart(table):
    """Rows to six digits, NaN and null told apart."""
    cell = lambda x: "null" if x is None else f"{x + 0.0:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r.values())) for r in table.select(sorted(table.column_names)).to_pylist())


SHARED = ["extreme_events", "extreme_events_trimmed", "forward_after_range", "grid_sweep", "range_volatility", "response_matrix", "tail_forms"]


@pytest.mark.parametrize("kind", ["across_zero", "odd_prices"])
@pytest.mark.parametrize("name", SHARED)
def test_prices_below_zero_as_in_sql(spark, request, kind, name):
    folder, con = request.getfixturevalue(kind)
    assert told_apart(QUERIES[name](spark, folder).toArrow()) == told_apart(con.sql(SQL[name]).to_arrow_table())
