"""Grid trading: levels, level crossings as mergeable folds, sweeps, closed forms and grid backtests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def geometric_levels(lower: Column, upper: Column, g: Column) -> Column:
    """Levels from lower by the factor 1 + g while not above upper, and one more beyond it.

    Built by repeated multiplication, the last digit included, as a reader of published counts expects.
    """
    n = (F.floor(F.log(upper / lower) / F.log1p(g)) + 3).cast("int")
    grown = F.aggregate(F.sequence(F.lit(1), n), F.array(lower), lambda acc, _: F.array_append(acc, F.element_at(acc, -1) * (1 + g)))
    return _once(grown, lambda g: F.filter(g, lambda x, i: (i == 0) | (F.element_at(g, F.greatest(i, F.lit(1))) <= upper)))


def centred_levels(price: Column, k: Column, below: int, above: int) -> Column:
    """price * (1 + k) ** i for i from -below to above."""
    return F.transform(F.sequence(F.lit(-below), F.lit(above)), lambda i: price * F.pow(1 + k, i))


def spaced_levels(lower: float | Column, upper: float | Column, n: int, ratio: bool) -> Column:
    """n steps of equal distance, or of equal ratio, from lower to upper."""
    i = F.sequence(F.lit(0), F.lit(n))
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (lower, upper))
    if ratio:
        return F.transform(i, lambda x: low * F.pow(high / low, x / n))
    return F.transform(i, lambda x: low + (high - low) / n * x)


def bucket_of(levels: Column, price: Column) -> Column:
    """i with level[i] <= price < level[i + 1], 0 where there is none: a closed form checked against its neighbours."""
    n = F.size(levels)
    low, step = levels[0], F.log(levels[1] / levels[0])
    guess = F.when(price > low, F.greatest(F.lit(0), F.least(F.floor(F.log(price / low) / step).cast("int"), n - 2))).otherwise(0)
    near = F.filter(F.array(guess, F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, n - 2)), lambda i: (levels[i] <= price) & (price < levels[i + 1]))
    return F.coalesce(F.get(near, F.lit(0)), F.lit(0))


def levels_below(levels: Column, price: Column) -> Column:
    """How many levels lie strictly below price: a closed form checked against its neighbours."""
    n = F.size(levels)
    # prices at or below the lowest level, zero and negative ones too, have none below them
    guess = F.when(price > levels[0], F.greatest(F.lit(0), F.least(F.ceil(F.log(price / levels[0]) / F.log(levels[1] / levels[0])).cast("int"), n))).otherwise(0)
    under = F.when((guess > 0) & (F.get(levels, guess - 1) >= price), guess - 1).otherwise(guess)
    return F.when((under < n) & (F.get(levels, under) < price), under + 1).otherwise(under)


def _stay(lo: Column, hi: Column, add: Column, s: Column, one: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), add.alias("c"), s.alias("s"), one.alias("one"))


def _push(acc: Column, x: Column, up: Column) -> Column:
    """One leg on a summary: the state becomes max(state, x) going up, min(state, x) going down.

    A summary says for every entry state what a stretch of legs does: until both sides have met, entry states in
    [lo, hi] stay; afterwards (one) all end at s.  Moves are c + (lo - entry)+ + (entry - hi)+.
    """
    lo, hi, c, s, one = (acc[n] for n in ("lo", "hi", "c", "s", "one"))
    moved = F.when(up, F.greatest(s, x)).otherwise(F.least(s, x))
    meets = F.when(up, x >= hi).otherwise(x <= lo)
    edge = F.when(up, hi).otherwise(lo)
    return (
        F.when(one, _stay(lo, hi, c + F.abs(moved - s), moved, one))
        .when(meets, _stay(edge, edge, c + F.abs(x - edge), x, F.lit(True)))
        .otherwise(_stay(F.when(up, F.greatest(lo, x)).otherwise(lo), F.when(up, hi).otherwise(F.least(hi, x)), c, s, one))
    )


_OPEN = "named_struct('lo', -1000000000L, 'hi', 1000000000L, 'c', 0L, 's', 0L, 'one', false)"


def crossing_summary(legs: Column) -> Column:
    """Summary of an ordered array of legs (x: level, up: direction)."""
    return F.aggregate(legs, F.expr(_OPEN), lambda acc, leg: _push(acc, leg["x"].cast("long"), leg["up"]))


def merge_summaries(parts: Column) -> Column:
    """Summary of consecutive stretches from theirs, in order: clamps compose to a clamp."""

    def join(acc: Column, nxt: Column) -> Column:
        up = _once(_push(acc, nxt["lo"], F.lit(True)), lambda m: _push(m, nxt["hi"], F.lit(False)))
        return _once(up, lambda m: _stay(m["lo"], m["hi"], m["c"] + nxt["c"], F.when(nxt["one"], nxt["s"]).otherwise(m["s"]), m["one"]))

    return F.aggregate(parts, F.expr(_OPEN), join)


def sweep_sizes(spark: SparkSession, first: float = 0.003, last: float = 0.1, step: float = 0.001) -> DataFrame:
    """The grid sizes of a sweep, rounded to three digits."""
    n = round((last - first) / step) + 1
    return spark.range(n).select(F.round(F.lit(first) + F.col("id") * step, 3).alias("grid_size"))


def crossing_sweep(bars: DataFrame, sizes: DataFrame, lower: float, upper: float, fee: float = 0.0, block: str = "1 day") -> DataFrame:
    """Grid sweep: symbol, grid_size, grid_count, trade_count, fake_count, arbitrage_number, profit.

    A bar's path is open, low, high, close, its open replaced by the close before but for the first.  A leg up from
    a to b moves the last touched level to the last one below b, a leg down to the first one not below b; the
    moves are the trades.  Crossings between the first open and the last close are no arbitrage.

    Bars fold in blocks of time to summaries and these merge in order, so one task never holds a whole series.
    Prices outside the levels, whatever their sign, touch the outermost ones; sizes is a small parameter table (broadcast by its row count).  With a column
    symbol, sizes has each symbol's own.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    path = bars.select("symbol", "ts", F.coalesce(F.lag("close").over(w), F.col("open")).alias("p0"), "open", "low", "high", "close")
    own = ["symbol"] if "symbol" in sizes.columns else []
    grids = sizes.select(*own, "grid_size", geometric_levels(F.lit(float(lower)), F.lit(float(upper)), F.col("grid_size")).alias("levels"))
    if (sizes.groupBy(*own).count().agg(F.max("count")).first()[0] or 0) > 10_000:
        raise ValueError("a sweep has at most 10,000 sizes; split it")
    grids = grids if own else F.broadcast(grids)
    ends = bars.groupBy("symbol").agg(F.min_by("open", "ts").alias("first"), F.max_by("close", "ts").alias("last"))

    def leg(a: str, b: str) -> Column:
        up = F.col(a) < F.col(b)
        k = levels_below(F.col("levels"), F.col(b))
        return F.when(F.col(a) == F.col(b), F.lit(None)).otherwise(F.struct(F.when(up, k - 1).otherwise(k).cast("long").alias("x"), up.alias("up")))

    legs = (path.join(grids, own) if own else path.crossJoin(grids)).select("symbol", "grid_size", F.window("ts", block)["start"].alias("block"), "ts", F.array_compact(F.array(leg("p0", "low"), leg("low", "high"), leg("high", "close"))).alias("legs"))
    per_block = legs.groupBy("symbol", "grid_size", "block").agg(F.array_sort(F.collect_list(F.struct("ts", "legs"))).alias("l"))
    per_block = per_block.select("symbol", "grid_size", "block", crossing_summary(F.flatten(F.col("l.legs"))).alias("summary"))
    whole = per_block.groupBy("symbol", "grid_size").agg(F.array_sort(F.collect_list(F.struct("block", "summary"))).alias("b"))
    whole = whole.select("symbol", "grid_size", merge_summaries(F.col("b.summary")).alias("m"))
    full = whole.join(grids, [*own, "grid_size"]).join(ends, "symbol")
    start = bucket_of(F.col("levels"), F.col("first")).cast("long")
    trades = F.col("m.c") + F.greatest(F.col("m.lo") - start, F.lit(0)) + F.greatest(start - F.col("m.hi"), F.lit(0))
    low, high = F.least("first", "last"), F.greatest("first", "last")
    fake = levels_below(F.col("levels"), high) - levels_below(F.col("levels"), low)
    n = F.size("levels") - 1
    arbitrage = (F.col("trade_count") - F.col("fake_count")) / 2
    return full.select("symbol", "grid_size", n.alias("grid_count"), trades.alias("trade_count"), fake.cast("long").alias("fake_count")).select(
        "*", arbitrage.alias("arbitrage_number"), (100 / F.col("grid_count") * (F.col("grid_size") - 2 * fee) * arbitrage).alias("profit")
    )


def closed_forms(df: DataFrame) -> DataFrame:
    """From money m and an even number of grids n: profit p_u above, loss l_l below, expectation, cycles and rounds."""
    half = F.col("n") / 2
    unit = F.col("m") / F.col("n")
    p_u = unit * half * (half + 1) / 2
    l_l = unit * (half * half + (half - 1) * half / 2)
    return df.withColumns({"p_u": p_u, "l_l": l_l, "expected": (p_u - l_l) / 2, "cycles": F.col("n") ** 2 / 8 - F.col("n") / 4, "e0": F.col("n") ** 2 / 4})


def flexible_capital(df: DataFrame) -> DataFrame:
    """From funds f0, price p0, lower l, n_l grids below and n_u above: the ratio below and the volume per grid g_v."""
    ratio = F.pow(F.col("p0") / F.col("l"), 1 / F.col("n_l"))
    step = F.col("p0") - F.col("p0") / ratio
    return df.withColumns({"ratio": ratio, "g_v": F.col("f0") / (((F.col("p0") - step) + F.col("l")) / 2 * F.col("n_l") + F.col("n_u") * F.col("p0"))})


GRID_RESULT = T.StructType([T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("cash", "coins", "wallet", "final_value", "invested", "profit")], T.StructField("n_buys", T.LongType()), T.StructField("n_sells", T.LongType()), T.StructField("n_resets", T.LongType())])


def grid_backtest(bars: DataFrame, k: float, n: int, money: float, dynamic: bool) -> DataFrame:
    """Trade a grid of n levels around the first close on every close of a symbol.

    Crossing a level upwards sells held / (active levels above and at it), downwards spends cash / (levels below and at it).
    Outside the grid a plain grid ends; a dynamic one recentres there: above it reinvests everything, below it keeps its coins
    and starts again with the money in the wallet.  A recursion over one symbol's closes, which one task holds.
    """
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        half = n // 2
        buys = sells = resets = 0
        cash = coins = wallet = 0.0
        invested, fund, centre, last = money, money, None, None
        for p in pdf.sort_values("ts").close.tolist():
            if centre is None:
                centre, last = p, 0
                coins += fund * half / n / p
                cash = fund * (n - half) / n
                continue
            while last < half and p >= centre * (1 + k) ** (last + 1):
                last += 1
                part = coins / (half - last + 1)
                at = centre * (1 + k) ** last
                coins, cash, sells = coins - part, cash + part * at, sells + 1
            while last > -half and p <= centre * (1 + k) ** (last - 1):
                last -= 1
                part = cash / (half + last + 1)
                at = centre * (1 + k) ** last
                coins, cash, buys = coins + part / at, cash - part, buys + 1
            if abs(last) == half:
                if not dynamic:
                    break
                resets += 1
                if last == half:
                    fund = cash + coins * p + wallet
                    wallet, coins = 0.0, 0.0
                else:
                    wallet, fund = wallet + cash, money
                    invested += max(0.0, money - wallet)
                    wallet = max(0.0, wallet - money)
                centre, last = p, 0
                coins += fund * half / n / p
                cash = fund * (n - half) / n
        end = float(pdf.sort_values("ts").close.iloc[-1])
        value = cash + coins * end + wallet
        return pd.DataFrame([[key[0], cash, coins, wallet, value, invested, value - invested, buys, sells, resets]], columns=GRID_RESULT.names)

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, GRID_RESULT)
