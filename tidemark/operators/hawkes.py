"""Self- and cross-exciting marked point processes: expectation maximisation over who caused whom.

Every event has a chance of being spontaneous and, for each channel, of being a child of that channel's past.  With exponential kernels these
chances need only decayed sums of the past, of the marks and of the marks times ages.  Time is cut into blocks per channel in which its kernel decays by exp(-10):
within a block the sums run, and what earlier blocks left is carried in decayed.  So a task holds one block's events, and a round
of the fit is one job for all symbols.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

DECAY, REACH = 10.0, 80
#: Kernels of a symbol whose decays are at most this apart share blocks: the fastest falls by exp(-200) in one, the slowest by exp(-40) in REACH of them.
APART = 400.0
#: Blocks of one task; REACH at least, so that a block matters in its own stretch and the next alone.
STRETCH = 2_000


def _mark(power: float):  # noqa: ANN202
    """Mean-one weight of a mark within its symbol and channel: mark ** power over its mean."""
    raw = F.pow(F.col("mark").cast("double"), F.lit(float(power)))
    return raw / F.avg(raw).over(Window.partitionBy("symbol", "channel"))


def past_sums(events: DataFrame, rates: DataFrame) -> DataFrame:
    """For each event and source channel: symbol, channel, t, seq, source, alpha, s (decayed sum of the source's earlier weights), a (of weights times ages).

    events: symbol, channel, t, seq, g.  rates: symbol, source, alpha; broadcast, one row per symbol and channel.  Events of one time do not feed each other.
    """
    met = events.join(F.broadcast(rates), "symbol")
    age = F.col("t") * F.col("alpha") / DECAY
    own = F.when(F.col("channel") == F.col("source"), F.col("g")).otherwise(0.0)
    rows = met.withColumn("_b", F.floor(age)).withColumn("_u", F.col("t") - F.col("_b") * DECAY / F.col("alpha"))
    rows = rows.withColumn("_w", own * F.exp(F.col("alpha") * F.col("_u"))).withColumn("_p", F.col("_w") * F.col("_u"))
    keys = ["symbol", "source"]
    # rows strictly before in time: a range frame up to the current time, less the rows of that time
    upto = Window.partitionBy(*keys, "_b").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    now = Window.partitionBy(*keys, "_b", "t")
    near = {f"_n{c}": F.sum(c).over(upto) - F.sum(c).over(now) for c in ("_w", "_p")}
    sums = rows.groupBy(*keys, "alpha", "_b").agg(F.sum("_w").alias("_sw"), F.sum("_p").alias("_sp"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-REACH, -1)
    width = DECAY / F.col("alpha")

    def carried(part):  # noqa: ANN001, ANN202
        return F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + part(x) * F.exp(DECAY * (x["_b"] - F.col("_b"))))

    # a block's carry, seen from its own start: weights, and weights times their age there
    left = sums.withColumn("_l", F.collect_list(F.struct("_b", "_sw", "_sp")).over(earlier)).select(
        *keys, "_b", carried(lambda x: x["_sw"]).alias("_cs"), carried(lambda x: x["_sw"] * (F.col("_b") - x["_b"]) * width - x["_sp"]).alias("_ca"),
    )
    both = rows.withColumns(near).join(left, [*keys, "_b"])
    fade = F.exp(-F.col("alpha") * F.col("_u"))
    s = (F.col("_n_w") + F.col("_cs")) * fade
    a = (F.col("_u") * F.col("_n_w") - F.col("_n_p") + F.col("_ca") + F.col("_u") * F.col("_cs")) * fade
    return both.select("symbol", "channel", "t", "seq", "source", "alpha", F.greatest(s, F.lit(0.0)).alias("s"), F.greatest(a, F.lit(0.0)).alias("a"))


def wide_sums(events: DataFrame, rates: DataFrame, names: list[str]) -> DataFrame:
    """Each event once, with the sums of past_sums for source k of names as s<k> and a<k>, and its decay as alpha<k>.

    rates: symbol, width (of the blocks), alpha0, alpha1 ...; broadcast.  All sources have the blocks of their symbol, so events move once and an
    event's parts need not meet again.
    """
    ks, keys = range(len(names)), ["symbol", "_b"]
    fixed = ["width", *[f"alpha{k}" for k in ks]]
    cut = events.join(F.broadcast(rates.select("symbol", "width")), "symbol").withColumn("_b", F.floor(F.col("t") / F.col("width"))).drop("width").repartition(*keys)
    rows = cut.join(F.broadcast(rates), "symbol").withColumn("_u", F.col("t") - F.col("_b") * F.col("width"))
    rows = rows.withColumns({f"_w{k}": F.when(F.col("channel") == j, F.col("g") * F.exp(F.col(f"alpha{k}") * F.col("_u"))).otherwise(0.0) for k, j in enumerate(names)})
    rows = rows.withColumns({f"_p{k}": F.col(f"_w{k}") * F.col("_u") for k in ks})
    parts = [f"_{c}{k}" for c in "wp" for k in ks]
    # rows strictly before in time, as in past_sums
    upto = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    now = Window.partitionBy(*keys, "t")
    near = {f"_n{c}": F.sum(c).over(upto) - F.sum(c).over(now) for c in parts}
    sums = rows.groupBy(*keys, *fixed).agg(*[F.sum(c).alias(f"_s{c}") for c in parts])
    # stretches of blocks are tasks of their own; a stretch is told the last blocks of the one before
    home = F.floor(F.col("_b") / STRETCH)
    sums = sums.withColumn("_z", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_b") + REACH) / STRETCH)))))
    earlier = Window.partitionBy("symbol", "_z").orderBy("_b").rangeBetween(-REACH, -1)

    def carried(k: int, part):  # noqa: ANN001, ANN202
        return F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + part(x) * F.exp(F.col(f"alpha{k}") * F.col("width") * (x["_b"] - F.col("_b"))))

    listed = sums.withColumn("_l", F.collect_list(F.struct("_b", *[f"_s{c}" for c in parts])).over(earlier)).where(F.col("_z") == home)
    weights = [carried(k, lambda x, k=k: x[f"_s_w{k}"]).alias(f"_cs{k}") for k in ks]
    ages = [carried(k, lambda x, k=k: x[f"_s_w{k}"] * (F.col("_b") - x["_b"]) * F.col("width") - x[f"_s_p{k}"]).alias(f"_ca{k}") for k in ks]
    both = rows.withColumns(near).join(listed.select(*keys, *weights, *ages), keys)
    made, u = [], F.col("_u")
    for k in ks:
        fade = F.exp(-F.col(f"alpha{k}") * u)
        s = (F.col(f"_n_w{k}") + F.col(f"_cs{k}")) * fade
        a = (u * F.col(f"_n_w{k}") - F.col(f"_n_p{k}") + F.col(f"_ca{k}") + u * F.col(f"_cs{k}")) * fade
        made += [F.greatest(s, F.lit(0.0)).alias(f"s{k}"), F.greatest(a, F.lit(0.0)).alias(f"a{k}")]
    return both.select("symbol", "channel", "t", "seq", *fixed[1:], *made)


def hawkes_em(events: DataFrame, rounds: int = 20, power: float = 0.0, feeds: list[tuple[str, str]] | None = None) -> DataFrame:
    """Fit per symbol: channel, source, mu (of the channel), nu (children of the channel per event of the source), alpha (decay of
    the source's kernel), radius (spectral, below 1 for a stationary process), residual (mean compensator over an event of the channel), loglik, n.

    events: symbol, channel, t, seq, mark (weights are mark ** power over their mean).  feeds lists (source, channel) pairs
    that may excite; all by default.  mu, nu and the ages are sums of chances, so each round raises the likelihood but for the
    kernels' cut at the end, which alpha leaves out of account.  Parameters, channels squared numbers per symbol, are on the driver; events never.
    """
    spark = events.sparkSession
    data = stash(events.select("symbol", "channel", F.col("t").cast("double").alias("t"), "seq", "mark").withColumn("g", _mark(power) if power else F.lit(1.0)).drop("mark"), "events")
    span = {r.symbol: (r.lo, r.hi) for r in data.groupBy("symbol").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    count = {(r.symbol, r.channel): r.n for r in data.groupBy("symbol", "channel").agg(F.count("*").alias("n")).collect()}
    names = sorted({c for _, c in count})
    open_ = {(j, i) for j in names for i in names} if feeds is None else set(feeds)
    able = [s for s, (lo, hi) in span.items() if hi > lo]
    mu = {(s, i): count.get((s, i), 0) / (span[s][1] - span[s][0]) / 2 for s in able for i in names}
    nu = {(s, j, i): (0.5 / max(1, sum((k, i) in open_ for k in names)) if (j, i) in open_ else 0.0) for s in able for j in names for i in names}
    alpha = {(s, j): max(sum(count.get((s, i), 0) for i in names) / (span[s][1] - span[s][0]), 1e-9) for s in able for j in names}

    def expected() -> tuple[dict, dict, dict]:
        """Sums over the events of each symbol and channel: chances by source, ages, log intensities; and the sources' masses up to the end."""
        left_of = lambda rates: data.join(F.broadcast(rates.withColumnRenamed("source", "channel")), ["symbol", "channel"]).groupBy("symbol", "channel").agg(F.sum(F.col("g") * (1 - F.exp(-F.col("alpha") * (F.col("end") - F.col("t"))))).alias("m"))
        rates = spark.createDataFrame([(s, j, float(a), span[s][1]) for (s, j), a in alpha.items()], "symbol string, source string, alpha double, end double")
        mass = {(r.symbol, r.channel): r.m for r in left_of(rates).collect()}
        kernels = {s: [float(alpha[s, j]) for j in names] for s in able}
        if all(max(k) <= APART * min(k) for k in kernels.values()):
            ks = range(len(names))
            wide = spark.createDataFrame([(s, DECAY / (min(k) * max(k)) ** 0.5, *k) for s, k in kernels.items()], "symbol string, width double, " + ", ".join(f"alpha{k} double" for k in ks))
            held = spark.createDataFrame([(s, i, float(mu[s, i]), *[float(nu[s, j, i]) for j in names]) for s in able for i in names], "symbol string, channel string, mu double, " + ", ".join(f"nu{k} double" for k in ks))
            each = wide_sums(data, wide, names).join(F.broadcast(held), ["symbol", "channel"]).withColumns({f"f{k}": F.col(f"nu{k}") * F.col(f"alpha{k}") * F.col(f"s{k}") for k in ks})
            each = each.withColumn("rate", sum((F.col(f"f{k}") for k in ks), F.col("mu")))
            part = lambda k: F.col(f"f{k}") / F.col("rate")
            row = each.groupBy("symbol", "channel").agg(
                *[F.sum(part(k)).alias(f"p{k}") for k in ks], *[F.sum(part(k) * F.coalesce(F.try_divide(f"a{k}", f"s{k}"), F.lit(0.0))).alias(f"age{k}") for k in ks], F.sum(F.col("mu") / F.col("rate")).alias("own"), F.sum(F.ln("rate")).alias("ll"),
            )
            return {(r.symbol, r.channel, j): (r[f"p{k}"], r[f"age{k}"], r.own, r.ll) for r in row.collect() for k, j in enumerate(names)}, mass
        # kernels too far apart for common blocks: each source has its own
        weights = spark.createDataFrame([(s, i, j, mu[s, i], nu[s, j, i]) for s in able for i in names for j in names], "symbol string, channel string, source string, mu double, nu double")
        sums = past_sums(data, rates.drop("end")).join(F.broadcast(weights), ["symbol", "channel", "source"])
        force = F.col("nu") * F.col("alpha") * F.col("s")
        # the parts of an event's intensity, one for each source, meet at the event
        by_event = sums.groupBy("symbol", "channel", "t", "seq", "mu").agg((F.first("mu") + F.sum(force)).alias("rate"), F.collect_list(F.struct("source", force.alias("f"), F.try_divide("a", "s").alias("age"))).alias("parts"))
        chances = by_event.select("symbol", "channel", "mu", "rate", F.posexplode("parts").alias("k", "x")).groupBy("symbol", "channel", "x.source").agg(
            F.sum(F.col("x.f") / F.col("rate")).alias("p"), F.sum(F.col("x.f") / F.col("rate") * F.coalesce("x.age", F.lit(0.0))).alias("age"), F.sum(F.col("mu") / F.col("rate")).alias("own"), F.sum(F.ln("rate")).alias("ll"),
        )
        got = {(r.symbol, r.channel, r.source): (r.p, r.age, r.own, r.ll) for r in chances.collect()}
        return got, mass

    for _ in range(rounds):
        got, mass = expected()
        for s in able:
            for i in names:
                parts = [got.get((s, i, j), (0.0, 0.0, 0.0, 0.0)) for j in names]
                mu[s, i] = parts[0][2] / (span[s][1] - span[s][0])
                for j, part in zip(names, parts, strict=True):
                    nu[s, j, i] = part[0] / mass[s, j] if mass.get((s, j)) else 0.0
            for j in names:
                born, ages = (sum(got.get((s, i, j), (0.0, 0.0))[k] for i in names) for k in (0, 1))
                alpha[s, j] = born / ages if ages > 0 else alpha[s, j]
    got, mass = expected()
    out = []
    for s in able:
        matrix = np.array([[nu[s, j, i] for j in names] for i in names])
        radius = float(np.abs(np.linalg.eigvals(matrix)).max())
        width = span[s][1] - span[s][0]
        compensator = {i: mu[s, i] * width + sum(nu[s, j, i] * mass.get((s, j), 0.0) for j in names) for i in names}
        loglik = sum(got[s, i, names[0]][3] for i in names if (s, i) in count) - sum(compensator.values())
        out += [(s, i, j, float(mu[s, i]), float(nu[s, j, i]), float(alpha[s, j]), radius, float(compensator[i] / count[s, i]), float(loglik), count[s, i]) for i in names if (s, i) in count for j in names]
    return spark.createDataFrame(out, "symbol string, channel string, source string, mu double, nu double, alpha double, radius double, residual double, loglik double, n long")
