"""Metrics of trades, scores and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, sdiv, with_average_rank
from ..sources.staging import staged
from .quantiles import with_counts_below

#: Units of capital: as many positions as may be open at once.
CAPITAL = 10.0


def profit_factor(net: Column, without_loss: float | None = None) -> Column:
    """Won over lost, as an aggregate; ``without_loss`` (or NULL) if nothing was lost."""
    won = F.sum(F.when(net > 0, net).otherwise(0.0))
    lost = -F.sum(F.when(net < 0, net).otherwise(0.0))
    return F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).otherwise(F.lit(without_loss).cast("double"))


def equity(trades: DataFrame, net: Column, order: list[str], keys: tuple[str, ...] = (), base: float = CAPITAL) -> DataFrame:
    """``trades`` with net, equity (the base plus all net so far) and peak, in the order of their exits."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("net", net).withColumn("equity", F.lit(base) + F.sum("net").over(w))
    return out.withColumn("peak", F.greatest(F.lit(base), F.max("equity").over(w)))


def trade_metrics(trades: DataFrame, cost: float = 0.003, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("exit_time", "symbol", "bar_i"), base: float = CAPITAL) -> DataFrame:
    """Number, net, net on capital, mean, win rate, profit factor (infinite without losses) and the greatest drawdown."""
    run = equity(trades, F.col("realized_ret") - cost, list(order), keys, base)
    net = F.col("net")
    return run.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.round(F.sum(net), 4).alias("net_total"),
        F.round(F.sum(net) / base, 4).alias("net_on_capital"),
        F.round(F.avg(net), 5).alias("mean_net"),
        F.round(F.avg((net > 0).cast("double")), 4).alias("win_rate"),
        F.round(profit_factor(net, float("inf")), 3).alias("profit_factor"),
        F.round(F.max((F.col("peak") - F.col("equity")) / F.col("peak")), 4).alias("max_drawdown"),
    )


def cost_grid(trades: DataFrame, costs: dict[str, float], side: str = "side") -> DataFrame:
    """Stats by side, and over both, at each cost: one grouping-set aggregate over the trades times the costs."""
    costed = trades.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(n).alias("cost_name"), F.lit(c).alias("cost")) for n, c in costs.items())))).select("*", "_c.*")
    net = F.col("realized_ret") - F.col("cost")
    grouped = costed.groupingSets([[F.col(side), F.col("cost_name")], [F.col("cost_name")]], F.col(side), F.col("cost_name"))
    return grouped.agg(
        F.count("*").alias("n"), F.round(F.avg((net > 0).cast("double")), 6).alias("win_rate"), F.round(F.avg(net), 6).alias("mean_net"), F.round(F.sum(net), 6).alias("sum_net"), F.round(profit_factor(net), 6).alias("profit_factor")
    ).withColumn(side, F.coalesce(F.col(side), F.lit("both")))


def by_period(trades: DataFrame, time: str, cost: float, period: str = "month") -> DataFrame:
    """Number, net and profit factor by month (YYYY-MM) or quarter (YYYYQn)."""
    label = F.date_format(time, "yyyy-MM") if period == "month" else F.concat(F.year(time).cast("string"), F.lit("Q"), F.quarter(time).cast("string"))
    net = F.col("realized_ret") - cost
    return trades.groupBy(label.alias("period")).agg(F.count("*").alias("n"), F.round(F.sum(net), 6).alias("sum_net"), F.round(profit_factor(net), 6).alias("profit_factor"))


def concentration(periods: DataFrame, least: int = 1) -> DataFrame:
    """One row: the share of the best period and of the best two in all net, periods with a profit factor of 1.3 or more,
    and whether one period makes more than 0.6 of it. Only periods with ``least`` trades count, or all if none has."""
    any_ = F.max((F.col("n") >= least).cast("int")).over(Window.partitionBy(F.lit(0)))
    rows = periods.withColumn("_any", any_).where((F.col("n") >= least) | (F.col("_any") == 0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sum_net"), "period"))
    total = F.sum("sum_net")
    top = lambda k: F.sum(F.when(F.col("_r") <= k, F.col("sum_net")))
    out = rows.withColumn("_r", rank).agg(F.count("*").alias("n_periods"), F.round(sdiv(top(1), total), 6).alias("top1"), F.round(sdiv(top(2), total), 6).alias("top2"), F.count_if(F.col("profit_factor") >= 1.3).alias("n_good"))
    return out.withColumn("fragile", F.coalesce(F.col("top1") > 0.6, F.lit(False)))


def deciles(rows: DataFrame, score: str, value: str) -> DataFrame:
    """Number, mean and sum of ``value`` by decile of the score, from average ranks."""
    ranked = with_average_rank(rows.where(F.col(score).isNotNull()), score, "_rank")
    bucket = (F.floor(F.least(F.col("_rank") / F.col("_rank_n") * 10, F.lit(9.999))) + 1).cast("int")
    return ranked.withColumn("decile", bucket).groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.sum(value), 6).alias("sum_value"))


def ranking(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: number, positive rate, ROC AUC by rank sum with ties averaged, and average precision (ties as one step).

    From the counts of distinct scores, which are written to the shared folder and summed up in ranges: no task orders all
    scores."""
    usable = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.lit(0).alias("k"), F.col(label).cast("long").alias("y"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    by_score = staged(usable.groupBy("k", "s").agg(F.count("*").alias("n"), F.sum("y").alias("p")).withColumn("q", F.col("n") - F.col("p")), "scores")
    below = with_counts_below(by_score, "s", {"p": "p_below", "q": "q_below"}, ["k"])
    whole = by_score.groupBy("k").agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))  # one row
    p, q, above = F.col("p"), F.col("q"), F.col("pos") - F.col("p_below")
    found = below.join(F.broadcast(whole), "k").agg(
        F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.sum(p * (F.col("q_below") + q / 2)).alias("wins"), F.sum(p * above / (above + F.col("neg") - F.col("q_below"))).alias("steps")
    )
    pos, neg = F.col("pos"), F.col("neg")
    return found.select(
        F.coalesce(pos + neg, F.lit(0)).alias("n"), F.round(sdiv(pos, pos + neg), 6).alias("positive_rate"), F.round(sdiv("wins", pos * neg), 6).alias("roc_auc"), F.round(sdiv("steps", pos), 6).alias("average_precision")
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, by moments; NULL where a side doesn't vary."""
    return sdiv(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def factor_screen(rows: DataFrame, factors: list[str], target: str, time: str, least: int = 30) -> DataFrame:
    """One row a factor: the rank correlation with the target, its mean, spread and ratio over months with ``least``
    rows, the share of months with the mean's sign, and a verdict."""
    stacked = rows.select(F.date_format(time, "yyyy-MM").alias("month"), F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors))).alias("f")).select("month", "y", "f.*")
    stacked = stacked.where("x is not null and y is not null")
    whole = with_average_rank(with_average_rank(stacked, "x", "rx", ("factor",)), "y", "ry", ("factor",)).groupBy("factor").agg(pearson(F.col("rx"), F.col("ry")).alias("ic"), F.count("*").alias("n"))
    month = stacked.select("factor", "month", average_rank("x", "factor", "month").alias("rx"), average_rank("y", "factor", "month").alias("ry")).groupBy("factor", "month").agg(pearson(F.col("rx"), F.col("ry")).alias("m"), F.count("*").alias("k")).where((F.col("k") >= least) & F.col("m").isNotNull())
    months = month.groupBy("factor").agg(F.avg("m").alias("mean_ic"), F.stddev_pop("m").alias("std_ic"), F.count("*").alias("n_months"), F.avg((F.col("m") > 0).cast("double")).alias("up"))
    out = whole.join(months, "factor", "left")
    stable = F.greatest("up", 1 - F.col("up"))
    verdict = F.when(F.coalesce(stable < 0.7, F.lit(True)), "dead").when(F.col("mean_ic") > 0, "alive").otherwise("reversed")
    six = lambda c: F.round(c, 6)
    return out.select("factor", "n", six(F.col("ic")).alias("ic"), six(F.col("mean_ic")).alias("mean_ic"), six(sdiv("mean_ic", "std_ic")).alias("ir"), F.coalesce("n_months", F.lit(0)).alias("n_months"), six(stable).alias("stability"), verdict.alias("verdict"))


def utilisation(trades: DataFrame, start: str, end: str, weight: str, low: Column, high: Column) -> DataFrame:
    """One row: the mean weight in open trades over time from ``low`` to ``high``, by a sweep of their openings and ends."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    a, b = F.greatest(seconds(F.col(start)), seconds(low)), F.least(seconds(F.col(end)), seconds(high))
    inside = trades.select(a.alias("a"), b.alias("b"), F.col(weight).alias("w"), (seconds(high) - seconds(low)).alias("span")).where("b > a")
    events = inside.select("span", F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("w").alias("d")), F.struct(F.col("b").alias("t"), (-F.col("w")).alias("d")))).alias("e")).select("span", "e.*")
    at = events.groupBy("t").agg(F.sum("d").alias("d"), F.first("span").alias("span"))
    w = Window.partitionBy(F.lit(0)).orderBy("t")
    run = at.withColumn("held", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("len", F.lead("t").over(w) - F.col("t"))
    return run.agg(F.round(F.sum(F.col("held") * F.coalesce("len", F.lit(0))) / F.max("span"), 6).alias("utilisation"))


def permutation_pvalue(rows: DataFrame, label: str, score: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row: ROC AUC and the part of ``rounds`` random orders of the labels whose AUC reaches it, (hits + 1) /
    (rounds + 1). Orders come from hashes of row and round, so the table is dealt out by round."""
    usable = with_average_rank(rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()), score, "_rank").select(F.col(label).cast("long").alias("y"), F.col("_rank").alias("r"), F.xxhash64(*rows.columns).alias("_h"))
    n, p = F.count("*"), F.sum("y")
    real = usable.agg(((F.sum(F.col("y") * F.col("r")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))).alias("auc"), p.alias("p"), n.alias("n"))
    drawn = usable.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_o", F.row_number().over(Window.partitionBy("round").orderBy(F.xxhash64("_h", "round", F.lit(seed)), "r")))
    each = drawn.join(F.broadcast(real), F.lit(True)).groupBy("round").agg(((F.sum(F.when(F.col("_o") <= F.col("p"), F.col("r"))) - F.max("p") * (F.max("p") + 1) / 2) / F.nullif(F.max(F.col("p") * (F.col("n") - F.col("p"))), F.lit(0))).alias("a"), F.max("auc").alias("auc"))
    return each.agg(F.round(F.max("auc"), 6).alias("roc_auc"), F.round((F.count_if(F.col("a") >= F.col("auc")) + 1) / F.lit(rounds + 1), 6).alias("p_value"))


def build_summary(rows: DataFrame, time: str, *groups: str) -> DataFrame:
    """(group, value, n, symbols, first, last): rows by each of the grouping columns, and over all of them."""
    named = F.array(F.struct(F.lit("all").alias("group"), F.lit("all").alias("value")), *(F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("value")) for g in groups))
    each = rows.select("symbol", F.col(time).alias("_t"), F.explode(named).alias("g")).select("symbol", "_t", "g.*")
    return each.groupBy("group", "value").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("_t").alias("first"), F.max("_t").alias("last"))


def base_rate(chosen: DataFrame, control: DataFrame, cost: float) -> DataFrame:
    """One row a pool, ``chosen`` and ``control``: trades, mean net, win rate and profit factor, and by how much the mean of the
    chosen is above the control's."""
    net = F.col("realized_ret") - cost
    both = chosen.select(F.lit("chosen").alias("pool"), net.alias("net")).unionByName(control.select(F.lit("control").alias("pool"), net.alias("net")))
    stats = both.groupBy("pool").agg(F.count("*").alias("n"), F.avg("net").alias("_mean"), F.round(F.avg((F.col("net") > 0).cast("double")), 4).alias("win_rate"), F.round(profit_factor(F.col("net")), 3).alias("profit_factor"))
    w = Window.partitionBy(F.lit(0))  # two rows
    lift = F.max(F.when(F.col("pool") == "chosen", F.col("_mean"))).over(w) - F.max(F.when(F.col("pool") == "control", F.col("_mean"))).over(w)
    return stats.select("pool", "n", F.round("_mean", 5).alias("mean_net"), "win_rate", "profit_factor", F.round(lift, 5).alias("lift"))


def and_rule(rows: DataFrame, features: list[str], label: str, top: int = 5, least: int = 30) -> DataFrame:
    """(place, feature, op, threshold, gap, positive_median, negative_median): the clauses of a conjunction, of the features whose
    medians lie furthest apart in standard deviations. A clause keeps the three quarters of the positives on the side away
    from the negatives. Features need ``least`` values of either kind; equals go by name."""
    each = rows.select((F.col(label) > 0).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select("y", "f.*").where("x is not null and not isnan(x)")
    pick = lambda want: F.when(F.col("y") == want, F.col("x"))
    stats = each.groupBy("feature").agg(
        F.percentile(pick(True), F.lit(0.5)).alias("p"), F.percentile(pick(False), F.lit(0.5)).alias("q"), F.percentile(pick(True), F.lit(0.25)).alias("low"), F.percentile(pick(True), F.lit(0.75)).alias("high"),
        F.stddev_samp("x").alias("scale"), F.count(pick(True)).alias("np"), F.count(pick(False)).alias("nq"),
    ).where((F.col("np") >= least) & (F.col("nq") >= least))
    gap = F.round(F.abs(F.col("p") - F.col("q")) / F.greatest("scale", F.lit(1e-12)), 6)
    below = F.col("p") <= F.col("q")
    placed = stats.withColumn("gap", gap).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gap"), "feature")))  # one row a feature
    six = lambda c: F.round(c, 6)
    return placed.where(F.col("place") <= top).select(
        "place", "feature", F.when(below, "<=").otherwise(">=").alias("op"), six(F.when(below, F.col("high")).otherwise(F.col("low"))).alias("threshold"), "gap", six(F.col("p")).alias("positive_median"), six(F.col("q")).alias("negative_median")
    )
