"""Models that are fitted anew for every month, tier and set of features, all in one pass.

A ridge regression needs of its rows only sums: of the features, the target and their products. Sums by the month in which
a trade closed, added up over the months before, are those of all trades closed before a month. So one grouped aggregate
and a running sum over months hold every fit; tiers are one more key, and a set of features is a part of the same sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import profit_factor


def month_of(time: Column) -> Column:
    return F.date_trunc("month", time).cast("date")


def _solved(sums: np.ndarray, n: float, picked: list[int], k: int, ridge: float) -> list[float]:
    """(intercept, one weight for each of all k features, 0 for those left out) from n rows' sums: of each of the features and
    the target, then of their products row by row. The intercept is not held down."""
    first, second = sums[: k + 1], sums[k + 1 :].reshape(k + 1, k + 1)
    cov = second - np.outer(first, first) / n
    weights = np.zeros(k)
    if picked:
        weights[picked] = np.linalg.lstsq(cov[np.ix_(picked, picked)] + ridge * np.eye(len(picked)), cov[picked, k], rcond=None)[0]
    return [float(first[k] / n - weights @ first[:k] / n), *map(float, weights)]


def monthly_fits(
    rows: DataFrame, features: Sequence[str], target: str, time: str, closed: str, sets: Mapping[str, Sequence[str]] | None = None, tier: Column | None = None, ridge: float = 1.0, least: int = 300,
) -> DataFrame:
    """(tier, month, variant, n_train, last_closed, weights): for every month in which a trade of the tier begins, and every
    set of features, the fit on all trades of the tier that closed before the month began.

    ``weights`` is the intercept and one number for each of ``features``. ``tier`` is one value a row, ``all`` by default. A
    month with fewer than ``least`` trades before it has no fit. Rows without a time, close or target are left out;
    missing features count as 0.
    """
    sets = {"all": list(features)} if sets is None else {n: list(s) for n, s in sets.items()}
    k = len(features)
    picked = {n: [list(features).index(f) for f in s] for n, s in sets.items()}
    named = rows.withColumn("tier", F.lit("all") if tier is None else tier).where(F.col(time).isNotNull() & F.col(closed).isNotNull() & F.col(target).isNotNull())
    x = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features] + [F.col(target).cast("double")]
    # a trade is known from the month after the one in which it closed
    known = F.add_months(month_of(F.col(closed)), 1)
    given = named.select("tier", known.alias("month"), F.col(closed).alias("closed"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
    products = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = given.groupBy("tier", "month").agg(
        F.count("*").alias("n"), F.max("closed").alias("last_closed"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(k + 1)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in products),
    )
    asked = named.select("tier", month_of(F.col(time)).alias("month")).distinct().withColumn("asked", F.lit(True))
    both = asked.unionByName(sums, allowMissingColumns=True).groupBy("tier", "month").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"), F.max("last_closed").alias("last_closed"), *(F.sum(c).alias(c) for c in sums.columns if c[0] in "sp"))
    until = Window.partitionBy("tier").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    entry = lambda i, j: F.col(f"_p{min(i, j)}_{max(i, j)}")
    run = both.select("tier", "month", "asked", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("n_train"), F.max("last_closed").over(until).alias("last_closed"), *(F.coalesce(F.sum(c).over(until), F.lit(0.0)).alias(f"_{c}") for c in sums.columns if c[0] in "sp"))
    flat = F.array(*(F.col(f"_s{i}") for i in range(k + 1)), *(entry(i, j) for i in range(k + 1) for j in range(k + 1)))
    run = run.where(F.col("asked") & (F.col("n_train") >= least)).select("tier", "month", "n_train", "last_closed", flat.alias("sums"))

    def fit(frames):
        for frame in frames:
            out = [(t, m, name, n, last, _solved(np.asarray(s, float), n, own, k, ridge)) for t, m, n, last, s in frame.itertuples(index=False) for name, own in picked.items()]
            yield pd.DataFrame(out, columns=["tier", "month", "variant", "n_train", "last_closed", "weights"])

    kinds = dict(run.dtypes)
    return run.mapInPandas(fit, f"tier {kinds['tier']}, month date, variant string, n_train long, last_closed {kinds['last_closed']}, weights array<double>")


def monthly_scores(rows: DataFrame, fits: DataFrame, features: Sequence[str], time: str, tier: Column | None = None) -> DataFrame:
    """``rows`` of the months that have fits, once for each variant, with month, variant, n_train and score."""
    own = rows.withColumn("_tier", F.lit("all") if tier is None else tier).withColumn("month", month_of(F.col(time)))
    met = own.join(fits.withColumnRenamed("tier", "_tier").select("_tier", "month", "variant", "n_train", "weights"), ["_tier", "month"])
    score = F.col("weights")[0]
    for i, f in enumerate(features):
        score = score + F.col("weights")[i + 1] * F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    return met.withColumn("score", score).drop("weights").withColumnRenamed("_tier", "tier")


def monthly_metrics(scored: DataFrame, target: str, order: Sequence[str], groups: Sequence[str] = ("variant", "month"), least: int = 25) -> DataFrame:
    """One row a group: n_test, the profit factor of all its trades, and number, profit factor and mean in basis points of the
    tenth and fifth of best score, rounded down but one at least. Scores count to nine digits, equal ones go by ``order``.
    Groups of fewer than ``least`` trades have no row."""
    w = Window.partitionBy(*groups)
    ranked = scored.withColumn("_place", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), *order))).withColumn("_n", F.count("*").over(w))
    net, place, n = F.col(target), F.col("_place"), F.col("_n")
    top = lambda part: place <= F.greatest(F.floor(n * part + 1e-9), F.lit(1))
    of = lambda part: F.when(top(part), net)
    return ranked.where(n >= least).groupBy(*groups).agg(
        F.count("*").alias("n_test"), F.round(profit_factor(net), 3).alias("pf"), F.count(of(0.1)).alias("top10_n"), F.round(profit_factor(of(0.1)), 3).alias("top10_pf"), F.round(profit_factor(of(0.2)), 3).alias("top20_pf"), F.round(F.avg(of(0.2)) * 1e4, 1).alias("top20_bps"),
    )
