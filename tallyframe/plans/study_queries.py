"""Named queries of the live book and of studies over trades, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ewm, scalars, windows
from ..functions import indicators as ind
from ..operators import armed, barriers, directional, matching, outcomes, pool, quantiles, rank_tests, rolling, rule_grid, selection
from ..sources import records as from_records
from ..sources.staging import staged
from ..streaming import book
from .oracles import _BASE, _POOL, BARS, _lag, _r
from .table_queries import _boxes
from .queries import COST, GAP, HORIZON, WARMUP, _bars, _dense, _rounded, _signals, _table

_BOOK = book.Rules(slots=2, hours=18.0, losses=2, minutes=30.0)


def means_over_gaps(spark, d):
    """Exponential means of closes that are known on two thirds of the bars only, by chunks of 100 bars."""
    rows = _bars(spark, d).withColumn("seen", F.when(F.col("volume") % 3 != 0, F.col("close")))
    return _rounded(ewm.with_ewm(rows, {"m5": ("seen", ewm.span(5)), "m55": ("seen", ewm.span(55))}, chunk=100), ["symbol", "bar_i"], ["m5", "m55"])


def book_events(events):
    """Users as books: views, clicks and sign-ups signal, by type and hour; the rest closes the user's last signal. What a value
    below 5 entered has an unknown entry time."""
    signals = F.col("event_type").isin("view", "click", "signup")
    hour = F.date_trunc("hour", "ts")
    key = F.when(signals, F.concat_ws("@", "event_type", hour.cast("string")))
    last = F.last(key, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select(
        "user_id", "ts", "event_id", F.when(signals, "signal").otherwise("close").alias("kind"), last.alias("signal_key"), F.when(signals, hour).alias("signal_time"),
        F.when(signals & (F.col("value") >= 5), F.col("ts")).alias("entry_time"), ((F.col("value") - 50) / 1000).alias("net_ret"),
    )


def live_book(spark, d):
    events = _table(spark, d, "events").where("event_type is not null and value is not null and user_id is not null")
    until = events.agg(F.max("ts")).first()[0]
    rows = book.book_actions(book_events(events), "user_id", _BOOK, until)
    return rows.select(F.col("book").cast("long").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("at"), "event_id", "action", "signal_key", "n_open", "losses")


_QUANTILES = (0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)


def value_quantiles(spark, d):
    """Quantiles of the events' values by type."""
    found = quantiles.exact_quantiles(_table(spark, d, "events"), "value", _QUANTILES, ["event_type"])
    return found.select("event_type", "quantile", F.round("value", 9).alias("value"), "n")


_WAIT, _FIRST, _CONFIRMED, _GAPS = 24, (0.001, 0.002, 0.004, 0.006), (0.001, 0.003), (18, 36, 72)


def _armable(spark, d):
    """Bars but the last of each series; an arm is the fifth bar of a dense run."""
    rows = ind.with_indicators(_bars(spark, d))
    w = windows.series()
    run = windows.run_length((F.col("fast_spread") <= 0.008) & (F.col("full_spread") <= 0.02), w)
    mid = (F.col("cluster_max") + F.col("cluster_min")) / 2
    rows = rows.withColumn("run", run).withColumn("wider", F.col("fast_spread") - F.lag("fast_spread", 8).over(w)).withColumn("ret8", windows.change("close", 8, w))
    rows = rows.withColumn("side", F.when(mid > 0, F.when(F.col("close") < mid, -1).otherwise(1))).withColumn("_last", F.max("bar_i").over(windows.series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    prior = w.rowsBetween(-20, -1)
    rows = rows.withColumn("prior_high", F.max("high").over(prior)).withColumn("prior_low", F.min("low").over(prior))
    return rows.where(F.col("bar_i") < F.col("_last")), (F.col("run") == 5) & (F.col("bar_i") >= WARMUP)


def _grid(spark, d):
    rows, arm = _armable(spark, d)
    confirmed = (F.col("order_score") <= 1) & (F.col("ret8") <= -0.002)
    return armed.threshold_grid(rows, arm, F.col("wider"), F.col("side"), confirmed, _FIRST, _CONFIRMED, _WAIT)


def armed_grid(spark, d):
    """Short hits of two families of thresholds on widening averages."""
    return _grid(spark, d)


def armed_config(spark, d):
    """Hits that are left at different gaps, and the cell that each family takes."""
    return armed.picked_config(armed.counted_grid(_grid(spark, d), _GAPS), 5, 40, 20, 18, 0.001)


def direction_hits(spark, d):
    """Which way dense runs go, by five rules: always long, always short, the order of the averages at the run, the first break
    of the range of 20 bars and the first widening of the averages after it; each at least 18 bars apart."""
    rows, arm = _armable(spark, d)
    up, down = F.col("order_score"), F.col("down_order_score")
    ordered = F.when((up >= 3) & (up > down), 1).when((down >= 3) & (down > up), -1)
    plain = [armed.arms(rows, arm, side).withColumn("hit", F.lit(name)) for name, side in (("long", F.lit(1)), ("short", F.lit(-1)), ("order", ordered))]
    broken = F.when(F.col("close") > F.col("prior_high"), 1).when(F.col("close") < F.col("prior_low"), -1)
    hits = armed.armed_hits(rows, arm, {"range": (broken.isNotNull(), broken), "spread": ((F.col("wider") >= 0.002) & F.col("side").isNotNull(), F.col("side"))}, _WAIT)
    for more in plain:
        hits = hits.unionByName(more)
    return selection.min_gap(hits.select("symbol", "hit", "bar_i", "side"), GAP, ("symbol", "hit"))


def _directional(spark, d):
    averaged = _dense(ind.with_averages(_bars(spark, d)))
    tips = directional.dense_tips(averaged, F.col("spread") <= 0.01).where(F.col("bar_i") >= WARMUP)
    paths = outcomes.with_open_path(tips.select("symbol", "bar_i", "close", "atr14", "atr_pct", "range_high", "range_low"), averaged, HORIZON + directional.BREAK_BARS)
    return directional.taken_apart(paths, GAP, HORIZON).withColumn("o", directional.direction_outcomes(HORIZON, cost=scalars.COSTS["swap_maker"]))


def takeable_signals(spark, d):
    """Fifth bars of dense runs that can be traded, 18 bars after the last one that could, and what either direction makes."""
    return _rounded(_directional(spark, d).select("symbol", "bar_i", "o.*"), ["symbol", "bar_i"], ["long", "short", "breakout", "oracle"])


def direction_summary(spark, d):
    return directional.by_rule(_directional(spark, d))


def excursion_rank_tests(spark, d):
    """Whether winners' paths run further for and less against the trade than losers', by series and over all."""
    averaged = ind.with_averages(_bars(spark, d))
    paths = barriers.with_path(_signals(averaged), averaged, HORIZON).withColumn("won", (barriers.triple_barrier()["realized_ret"] > COST).cast("int"))
    ends = {"for": F.array_max(F.transform("path", lambda b: b["high"])), "against": F.array_min(F.transform("path", lambda b: b["low"]))}
    each = F.array(*(F.struct(F.lit(n).alias("measure"), F.round(p / F.col("entry_price") - 1, 9).alias("x")) for n, p in ends.items())).cast("array<struct<measure:string,x:double>>")
    rows = paths.select("won", F.explode(F.array("symbol", F.lit("all"))).alias("group"), each.alias("each")).select("won", "group", F.explode("each").alias("e")).select("won", "group", "e.*")
    return _rounded(rank_tests.mann_whitney(rows, "won", "x", ["group", "measure"]), ["group", "measure", "n_pos", "n_neg"], ["median_pos", "median_neg", "u", "rank_biserial", "z", "p_value"])


_SETS = {"price": ["price"], "both": ["price", "customer"], "none": []}


def _closed_orders(spark, d):
    """Orders as trades of up to forty days, whose return leans on their customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = _table(spark, d, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("begun"), (F.col("o_totalprice") / 100_000).alias("price"), (c % 17 / 17.0).alias("customer"), ((k * 7 + c) % 200 / 1000.0 - 0.1 + c % 17 / 300.0).alias("net"), (k % 40).cast("int").alias("days")
    )
    return rows.withColumn("ended", F.col("begun") + F.make_dt_interval(F.col("days")))


def _tiers(rows):
    """Above or below the median price of what had closed when the second year began."""
    early = rows.where("ended < timestamp_ntz'1996-01-01 00:00:00'").withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(quantiles.quantile_table(early, "price", {"cut": 0.5}, ["_one"]).drop("n")), "_one").withColumn("size", F.when(F.col("price") >= F.col("cut"), "large").otherwise("small")).drop("_one", "cut")


def _fits(spark, d, rows, tier=None):
    return rolling.monthly_fits(rows, ["price", "customer"], "net", "begun", "ended", _SETS, tier, 1.0, 100)


def rolling_weights(spark, d):
    """Fits of every month on what had closed before it, by size and set of features."""
    rows = _tiers(_closed_orders(spark, d))
    fits = _fits(spark, d, rows, F.col("size"))
    return fits.select("tier", F.date_format("month", "yyyy-MM").alias("month"), "variant", "n_train", "last_closed", *((F.round(F.col("weights")[k], 9) + 0.0).alias(n) for k, n in enumerate(("intercept", "price", "customer"))))


def rolling_months(spark, d):
    """How each month's trades do by the scores of its fits, for every set of features."""
    rows = _closed_orders(spark, d)
    found = rolling.monthly_metrics(rolling.monthly_scores(rows, _fits(spark, d, rows), ["price", "customer"], "begun"), "net", ["id"])
    return found.withColumn("month", F.date_format("month", "yyyy-MM"))


def tiered_months(spark, d):
    """Pooled fits, and those of either size put together again, side by side over all months after the first year."""
    rows = _tiers(_closed_orders(spark, d))
    pooled = rolling.monthly_scores(rows, _fits(spark, d, rows), ["price", "customer"], "begun").withColumn("fit", F.lit("pooled"))
    apart = rolling.monthly_scores(rows, _fits(spark, d, rows, F.col("size")), ["price", "customer"], "begun", F.col("size")).withColumn("fit", F.lit("tiered"))
    both = pooled.unionByName(apart).where("variant = 'both' and month >= date'1996-02-01'")
    return rolling.monthly_metrics(both, "net", ["id"], ("fit", "size"))


_PINNED = ("7", "3", "999999", "11")


def ranked_pool(spark, d):
    """Customers as tickers: pinned ones, most volume, gains and losses of the liquid, thirty at most."""
    k = F.col("c_custkey")
    tickers = _table(spark, d, "customer").select(k.cast("string").alias("symbol"), (F.col("c_acctbal") / 100).alias("change"), (k * 7919 % 10007).cast("double").alias("volume"))
    return pool.scan_pool(tickers, _PINNED, 10, 12, 5000.0, most=30)


def results_flattened(spark, d):
    """Result files made of the customers of each nation, as a list, an object with a list, or an object without one."""
    item = F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("n")).alias("deep"))
    of = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    n = F.col("c_nationkey")
    text = F.when(n % 3 == 0, F.to_json("rows")).when(n % 3 == 1, F.to_json(F.struct(n.alias("nation"), F.lit("own").alias("segment"), F.array(n).alias("left_out"), F.col("rows").alias("runs")))).otherwise(F.to_json(F.struct(n.alias("nation"), F.size("rows").alias("size"))))
    return from_records.flattened(of.select("c_nationkey", text.alias("text")), "text", "c_nationkey")


def boxes_disagreement(spark, d):
    """What the moved boxes made of the parts' own."""
    return matching.disagreement(*_boxes(spark, d))[1]


_SCALES, _MIN_BARS, _MAX_BARS, _WEEK = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0), (5, 8, 12), (12, 20, 40), 168
_FAST_LIMITS, _FULL_LIMITS = [round(0.008 * x, 6) for x in _SCALES], [round(0.02 * x, 6) for x in _SCALES]


def _weeks(spark, d):
    return ind.with_indicators(_bars(spark, d)).withColumn("week", F.floor(F.col("bar_i") / _WEEK).cast("int"))


def rule_grid_segments(spark, d):
    """Dense segments of every cell of a grid of 324 rules, in windows of a week of bars."""
    return rule_grid.swept_segments(_weeks(spark, d), ["symbol", "week"], _FAST_LIMITS, _FULL_LIMITS, _MIN_BARS, _MAX_BARS)


def rule_grid_fit(spark, d):
    """The five cells whose boxes meet known ones best on the first two weeks, and what they reach on the others. Known are the
    boxes of one rule, a bar longer on either side."""
    weeks = staged(_weeks(spark, d), "weeks")
    keys, averages = ["symbol", "week"], [f"ema{n}" for n in ind.SPANS]
    part = F.when(F.col("week") < 2, "fit").otherwise("hold").alias("part")
    found = staged(rule_grid.swept_segments(weeks, keys, _FAST_LIMITS, _FULL_LIMITS, _MIN_BARS, _MAX_BARS), "segments")
    known = rule_grid.swept_segments(weeks, keys, [0.0065], [0.017], [6], [16]).withColumn("start_i", F.col("start_i") - 1).withColumn("end_i", F.col("end_i") + 1)
    boxes = lambda some: staged(rule_grid.boxed(some, weeks, keys, averages).select("*", part), "boxes")
    scores = staged(rule_grid.cell_scores(boxes(found), boxes(known), keys, "part"), "scores")
    return rule_grid.best_cells(scores, "part", "fit")


STUDY_QUERIES = {
    f.__name__: f
    for f in (means_over_gaps, live_book, value_quantiles, armed_grid, armed_config, direction_hits, takeable_signals, direction_summary, excursion_rank_tests, rolling_weights, rolling_months, tiered_months, ranked_pool, results_flattened, boxes_disagreement, rule_grid_segments, rule_grid_fit)
}

_ARMED = f"""{_BASE},
marked as (
  select *, fast_spread <= 0.008 and full_spread <= 0.02 as dense, fast_spread - {_lag('fast_spread', 8)} as wider, close / nullif({_lag('close', 8)}, 0) - 1 as ret8,
    case when (cluster_max + cluster_min) / 2 > 0 then case when close < (cluster_max + cluster_min) / 2 then -1 else 1 end end as side,
    max(high) over (partition by symbol order by bar_i rows between 20 preceding and 1 preceding) as prior_high, min(low) over (partition by symbol order by bar_i rows between 20 preceding and 1 preceding) as prior_low,
    max(bar_i) over (partition by symbol) as last_i from enriched),
runs as (select *, bar_i - coalesce(max(case when not coalesce(dense, false) then bar_i end) over (partition by symbol order by bar_i), -1) as run from marked),
arms as (select symbol, bar_i as armed_i, order_score, down_order_score, lead(bar_i) over (partition by symbol order by bar_i) as next_i from runs where run = 5 and bar_i >= {WARMUP} and bar_i < last_i),
armed as (select r.*, a.armed_i from arms a join runs r on r.symbol = a.symbol and r.bar_i > a.armed_i and r.bar_i <= a.armed_i + {_WAIT} and r.bar_i < coalesce(a.next_i, 1000000000) and r.bar_i < r.last_i)"""
_GRID = f"""{_ARMED},
firsts as (
  select symbol, 'first' as family, t as threshold, armed_i, min(bar_i) as bar_i, arg_min(side, bar_i) as side from armed, unnest([{', '.join(f'{t}::double' for t in _FIRST)}]) as g(t) where wider >= t and side is not null group by symbol, t, armed_i
  union all
  select symbol, 'confirmed', t, armed_i, min(bar_i), -1 from armed, unnest([{', '.join(f'{t}::double' for t in _CONFIRMED)}]) as g(t) where wider >= t and side = -1 and order_score <= 1 and ret8 <= -0.002 group by symbol, t, armed_i),
grid as (select symbol, family, threshold, armed_i, bar_i from firsts where side = -1)"""


def _apart(source: str, keys: str, gap: str) -> str:
    """The hits of ``source`` from left to right, ``gap`` apart: (keys, bar_i) as a recursive pick."""
    same = " and ".join(f"s.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"select {keys}, min(bar_i) as bar_i from {source} group by {keys} union all select {pk}, (select min(s.bar_i) from {source} s where {same} and s.bar_i >= p.bar_i + {gap}) from picked p where p.bar_i is not null"


_TIPS = f"""{_BASE},
spreads as (select *, (greatest(ema8, ema21, ema55) - least(ema8, ema21, ema55)) / nullif(close, 0) <= 0.01 as dense from enriched),
runs as (select *, bar_i - coalesce(max(case when not coalesce(dense, false) then bar_i end) over (partition by symbol order by bar_i), -1) as run,
  max(high) over (partition by symbol order by bar_i rows between 19 preceding and current row) as range_high, min(low) over (partition by symbol order by bar_i rows between 19 preceding and current row) as range_low from spreads),
paths as (
  select t.symbol, t.bar_i, t.atr14, t.range_high, t.range_low, list({{'j': b.bar_i - t.bar_i - 1, 'open': b.open, 'high': b.high, 'low': b.low, 'close': b.close}} order by b.bar_i) as path
  from runs t join bars b on b.symbol = t.symbol and b.bar_i between t.bar_i + 1 and t.bar_i + {HORIZON + directional.BREAK_BARS}
  where t.run = 5 and t.bar_i >= {WARMUP} and t.atr14 > 0 and t.atr_pct >= 0.0015 group by all),
fit as (select * from paths where path[1].open > 0 and len(list_filter(path, lambda b: b.j < {HORIZON})) >= 8),
picked as ({_apart('fit', 'symbol', str(GAP))}),
taken as (select f.* from fit f join picked p using (symbol, bar_i)),
breaks as (
  select *, path[1].open as entry, list_filter(path, lambda b: b.j < {HORIZON}) as own, list_filter(path, lambda b: b.j < 6 and (b.close > range_high or b.close < range_low))[1] as broken from taken),
rests as (select *, list_filter(path, lambda b: b.j > broken.j and b.j <= broken.j + {HORIZON}) as rest, case when broken.close > range_high then 1 else -1 end as sign from breaks),
sides as (
  select symbol, bar_i, 'long' as rule, entry, 1 as sign, own as path, atr14 from rests union all select symbol, bar_i, 'short', entry, -1, own, atr14 from rests
  union all select symbol, bar_i, 'breakout', rest[1].open, sign, rest, atr14 from rests where broken is not null and len(rest) >= 4 and rest[1].open > 0),
touched as (
  select *, list_filter(path, lambda b: case when sign > 0 then b.high >= entry + 3 * atr14 else b.low <= entry - 3 * atr14 end)[1].j as won, list_filter(path, lambda b: case when sign > 0 then b.low <= entry - atr14 else b.high >= entry + atr14 end)[1].j as lost from sides),
nets as (
  select symbol, bar_i, rule, case when won is not null and (lost is null or won <= lost) then 3 * atr14 / entry when lost is not null then -atr14 / entry when sign > 0 then path[-1].close / entry - 1 else entry / path[-1].close - 1 end - {scalars.COSTS['swap_maker']} as net from touched),
ruled as (select * from nets union all select symbol, bar_i, 'oracle', max(net) from nets where rule in ('long', 'short') group by all)"""

_CLOSED = """
orders_ as (
  select o_orderkey as id, o_orderdate as begun, o_totalprice / 100000 as price, o_custkey % 17 / 17.0::double as customer, (o_orderkey * 7 + o_custkey) % 200 / 1000.0::double - 0.1::double + o_custkey % 17 / 300.0::double as net,
    o_orderdate + to_days((o_orderkey % 40)::int) as ended from orders),
sized as (select *, case when price >= (select quantile_cont(price, 0.5) from orders_ where ended < timestamp '1996-01-01') then 'large' else 'small' end as size from orders_)"""


def _monthly(rows: str, tier: str, name: str = "") -> str:
    """The fits of every month, tier and set of features, from sums of what had closed before."""
    return f"""
months{name} as (select distinct {tier} as tier, date_trunc('month', begun)::date as month from {rows}),
sums{name} as (
  select m.tier, m.month, count(*) as n, max(o.ended) as last_closed, avg(price) as mp, avg(customer) as mc, avg(net) as mn, sum(price * price) - sum(price) * sum(price) / count(*) as pp, sum(customer * customer) - sum(customer) * sum(customer) / count(*) as cc,
    sum(price * customer) - sum(price) * sum(customer) / count(*) as pc, sum(price * net) - sum(price) * sum(net) / count(*) as pn, sum(customer * net) - sum(customer) * sum(net) / count(*) as cn
  from months{name} m join (select *, {tier} as tier from {rows}) o on o.tier = m.tier and o.ended < m.month group by 1, 2 having count(*) >= 100),
solved{name} as (
  select *, 'none' as variant, 0.0::double as wp, 0.0::double as wc from sums{name} union all select *, 'price', pn / (pp + 1), 0.0 from sums{name}
  union all select *, 'both', (pn * (cc + 1) - cn * pc) / ((pp + 1) * (cc + 1) - pc * pc), (cn * (pp + 1) - pn * pc) / ((pp + 1) * (cc + 1) - pc * pc) from sums{name}),
scored{name} as (
  select o.*, f.month, f.variant, round(f.mn - f.wp * f.mp - f.wc * f.mc + f.wp * o.price + f.wc * o.customer, 9) as score from (select *, {tier} as tier from {rows}) o join solved{name} f on f.tier = o.tier and f.month = date_trunc('month', o.begun))"""


def _metrics(source: str, groups: str) -> str:
    pf = lambda where: f"round(case when sum(net) filter ({where} and net < 0) < 0 then coalesce(sum(net) filter ({where} and net > 0), 0) / -sum(net) filter ({where} and net < 0) end, 3)"
    top = lambda part: f"place <= greatest(floor(n * {part} + 1e-9), 1)"
    return f"""select {groups}, count(*) as n_test, {pf('true')} as pf, count(*) filter ({top(0.1)}) as top10_n, {pf(top(0.1))} as top10_pf, {pf(top(0.2))} as top20_pf, round(avg(net) filter ({top(0.2)}) * 1e4, 1) as top20_bps
from (select *, row_number() over (partition by {groups} order by score desc, id) as place, count(*) over (partition by {groups}) as n from {source}) where n >= 25 group by {groups}"""


_ERFC = """case when x < 2 then 1 - 2 / sqrt(pi()) * exp(-x * x) * list_reduce(list_prepend({'t': x, 's': x}, list_transform(range(1, 101), lambda k: {'t': k::double, 's': 0.0::double})), lambda a, b: {'t': a.t * 2 * x * x / (2 * b.t + 1), 's': a.s + a.t * 2 * x * x / (2 * b.t + 1)}).s
  else exp(-x * x) / (sqrt(pi()) * list_reduce(list_prepend(x, list_transform(range(1, 101), lambda k: (101 - k)::double)), lambda t, k: x + k / 2 / t)) end"""

STUDY_SQL: dict[str, str] = {
    "means_over_gaps": f"""with recursive {BARS},
seen as (select symbol, bar_i, case when volume % 3 <> 0 then close end as x from bars),
means as (
  select symbol, bar_i, x as m5, x as m55, 0 as gap from seen where bar_i = 0
  union all
  select s.symbol, s.bar_i,
    case when s.x is null then m.m5 when m.m5 is null then s.x else (m.m5 * pow(2.0 / 3, m.gap + 1) + s.x / 3.0) / (pow(2.0 / 3, m.gap + 1) + 1 / 3.0) end,
    case when s.x is null then m.m55 when m.m55 is null then s.x else (m.m55 * pow(27.0 / 28, m.gap + 1) + s.x / 28.0) / (pow(27.0 / 28, m.gap + 1) + 1 / 28.0) end,
    case when s.x is null and m.m5 is not null then m.gap + 1 else 0 end
  from means m join seen s on s.symbol = m.symbol and s.bar_i = m.bar_i + 1)
select symbol, bar_i, round(m5, 6) + 0.0 as m5, round(m55, 6) + 0.0 as m55 from means""",
    "live_book": f"""with recursive given as (
  select user_id, ts, event_id, value, event_type in ('view', 'click', 'signup') as is_signal, date_trunc('hour', ts) as hour,
    case when event_type in ('view', 'click', 'signup') then event_type || '@' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') end as own
  from events where event_type is not null and value is not null and user_id is not null),
ev as (
  select user_id, ts, event_id, is_signal, value, row_number() over w as k, last_value(own ignore nulls) over (w rows between unbounded preceding and current row) as key,
    ts - hour > interval '{int(_BOOK.minutes)} minutes' as old, case when value >= 5 then ts + interval '{int(_BOOK.hours)} hours' end as due from given window w as (partition by user_id order by ts, event_id)),
fold as (
  select distinct user_id, 0::bigint as k, null::timestamp as ts, null::bigint as event_id, null::varchar as action, null::varchar as key, []::struct(due timestamp, key varchar)[] as expired,
    0 as n_before, 0 as losses_before, []::struct(due timestamp, key varchar)[] as open, []::varchar[] as taken, 0 as losses from ev
  union all
  select user_id, k, ts, event_id, action, key, expired, n_before, losses_before,
    case action when 'opened' then list_append(left_open, {{'due': due, 'key': key}}) when 'closed' then list_filter(left_open, lambda x: x.key <> key) else left_open end,
    case when action = 'opened' then list_append(taken, key) else taken end,
    case when action <> 'closed' then losses_before when value < 50 then losses_before + 1 else 0 end
  from (
    select *, case
      when not is_signal then case when list_contains(list_transform(left_open, lambda x: x.key), key) then 'closed' else 'unknown' end
      when old then 'stale' when list_contains(taken, key) then 'taken' when losses_before >= {_BOOK.losses} then 'paused' when len(left_open) >= {_BOOK.slots} then 'full' else 'opened' end as action
    from (
      select e.*, f.taken, f.losses as losses_before, len(f.open)::int as n_before, list_sort(list_filter(f.open, lambda x: x.due <= e.ts)) as expired, list_filter(f.open, lambda x: x.due is null or x.due > e.ts) as left_open
      from fold f join ev e on e.user_id = f.user_id and e.k = f.k + 1))),
ends as (select max(ts) as until from given),
lasts as (select * from fold qualify k = max(k) over (partition by user_id)),
expiries as (
  select user_id, unnest(expired) as x, generate_subscripts(expired, 1) as i, n_before, losses_before as losses from fold
  union all
  select user_id, unnest(late), generate_subscripts(late, 1), n, losses from (select user_id, losses, len(open)::int as n, list_sort(list_filter(open, lambda x: x.due <= until)) as late from lasts, ends))
select user_id, ts as at, event_id, action, key as signal_key, len(open)::int as n_open, losses::int as losses from fold where k > 0
union all
select user_id, x.due, null, 'timeout_close', x.key, (n_before - i)::int, losses::int from expiries""",
    "value_quantiles": f"""
select event_type, q as quantile, round(case q {' '.join(f'when {q}::double then quantile_cont(value, {q})' for q in _QUANTILES)} end, 9) as value, count(*) as n
from (select event_type, value, unnest([{', '.join(f'{q}::double' for q in _QUANTILES)}]) as q from events where value is not null) group by event_type, q""",
    "armed_grid": f"{_GRID} select * from grid",
    "armed_config": f"""{_GRID.replace('with recursive', 'with recursive', 1)},
spaced as (select g.symbol, g.family, g.threshold, gap, g.bar_i from grid g, unnest([{', '.join(map(str, _GAPS))}]) as x(gap)),
picked as (
  select symbol, family, threshold, gap, min(bar_i) as bar_i from spaced group by all
  union all
  select symbol, family, threshold, gap, (select min(s.bar_i) from spaced s where s.symbol = p.symbol and s.family = p.family and s.threshold = p.threshold and s.gap = p.gap and s.bar_i >= p.bar_i + p.gap) from picked p where p.bar_i is not null),
cells as (select family, threshold, gap, count(*) as n from picked where bar_i is not null group by all),
judged as (select *, n between 5 and 40 as in_band, case when n not between 5 and 40 then 0 when threshold > 0.001 + 1e-12 and gap = 18 then 0 when abs(threshold - 0.001) < 1e-12 and gap > 18 then 1 when threshold > 0.001 + 1e-12 and gap > 18 then 2 else 3 end as kind from cells)
select family, threshold, gap::int as gap, n, in_band from judged qualify row_number() over (partition by family order by not in_band, kind, abs(n - 20), threshold, gap) = 1""",
    "direction_hits": f"""{_ARMED},
hits as (
  select symbol, 'long' as hit, armed_i as bar_i, 1 as side from arms union all select symbol, 'short', armed_i, -1 from arms
  union all select symbol, 'order', armed_i, case when order_score > down_order_score then 1 else -1 end from arms where (order_score >= 3 and order_score > down_order_score) or (down_order_score >= 3 and down_order_score > order_score)
  union all select symbol, 'range', min(bar_i), arg_min(case when close > prior_high then 1 else -1 end, bar_i) from armed where close > prior_high or close < prior_low group by symbol, armed_i
  union all select symbol, 'spread', min(bar_i), arg_min(side, bar_i) from armed where wider >= 0.002 and side is not null group by symbol, armed_i),
picked as ({_apart('hits', 'symbol, hit', str(GAP))})
select h.symbol, h.hit, h.bar_i, h.side from hits h join picked p using (symbol, hit, bar_i)""",
    "takeable_signals": f"""{_TIPS}
select symbol, bar_i, {', '.join(f"round(max(net) filter (rule = '{r}'), 6) + 0.0 as {r}" for r in ('long', 'short', 'breakout', 'oracle'))} from ruled group by symbol, bar_i""",
    "direction_summary": f"""{_TIPS}
select rule, count(*) as n, round(avg((net > 0)::int::double), 3) as win_rate, round(case when sum(net) filter (net < 0) < 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net < 0) end, 3) as profit_factor, round(avg(net) * 1e4, 1) as mean_bps from ruled group by rule""",
    "excursion_rank_tests": f"""{_POOL},
ends as (select t.symbol, t.bar_i, (any_value(t.realized_ret) > {COST})::int as won, max(b.high) / any_value(t.entry_price) - 1 as up, min(b.low) / any_value(t.entry_price) - 1 as down from trades t join bars b on b.symbol = t.symbol and b.bar_i between t.bar_i + 1 and t.bar_i + {HORIZON} group by 1, 2),
stacked as (select won, g, 'for' as measure, round(up, 9) as x from ends, unnest([symbol, 'all']) as u(g) union all select won, g, 'against', round(down, 9) from ends, unnest([symbol, 'all']) as u(g)),
ranked as (select *, rank() over (partition by g, measure order by x) + (count(*) over (partition by g, measure, x) - 1) / 2.0 as r, count(*) over (partition by g, measure, x) as t from stacked),
summed as (
  select g, measure, sum(won)::bigint as n1, (count(*) - sum(won))::bigint as n0, median(x) filter (won = 1) as m1, median(x) filter (won = 0) as m0, sum(r) filter (won = 1) - sum(won) * (sum(won) + 1) / 2.0 as u, sum(t::double * t - 1) as ties from ranked group by g, measure),
tested as (select *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / nullif(sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / nullif((n1 + n0) * (n1 + n0 - 1.0), 0))), 0) as z from summed)
select g as group, measure, n1 as n_pos, n0 as n_neg, round(m1, 6) + 0.0 as median_pos, round(m0, 6) + 0.0 as median_neg, round(case when n1 * n0 > 0 then u end, 6) + 0.0 as u, round(case when n1 * n0 > 0 then 2 * u / (n1 * n0) - 1 end, 6) + 0.0 as rank_biserial, round(case when n1 * n0 > 0 then z end, 6) + 0.0 as z,
  round(case when n1 * n0 > 0 then least(coalesce(p, 1), 1) end, 6) + 0.0 as p_value
from (select *, {_ERFC} as p from (select *, greatest(z, 0) / sqrt(2.0::double) as x from tested))""",
    "rolling_weights": f"""with {_CLOSED}, {_monthly('sized', 'size')}
select tier, strftime(month, '%Y-%m') as month, variant, n as n_train, last_closed, round(mn - wp * mp - wc * mc, 9) + 0.0 as intercept, round(wp, 9) + 0.0 as price, round(wc, 9) + 0.0 as customer from solved""",
    "rolling_months": f"with {_CLOSED}, {_monthly('orders_', chr(39) + 'all' + chr(39))} {_metrics("(select * replace (strftime(month, '%Y-%m') as month) from scored)", 'variant, month')}",
    "tiered_months": f"""with {_CLOSED}, {_monthly('sized', chr(39) + 'all' + chr(39), '_p')}, {_monthly('sized', 'size', '_t')},
fits as (select 'pooled' as fit, * from scored_p union all select 'tiered', * from scored_t)
{_metrics("(select * from fits where variant = 'both' and month >= date '1996-02-01')", 'fit, size')}""",
    "ranked_pool": f"""
with t as (select c_custkey::varchar as symbol, c_acctbal / 100 as change, (c_custkey * 7919 % 10007)::double as volume from customer where c_acctbal is not null),
listed as (
  select symbol, 0 as s, list_position({list(_PINNED)}, symbol) as rank from t where symbol in {_PINNED}
  union all select * from (select symbol, 1, row_number() over (order by volume desc, symbol) as rank from t where symbol not in {_PINNED}) where rank <= 10
  union all select * from (select symbol, 2, row_number() over (order by change desc, symbol) as rank from t where volume >= 5000) where rank <= 12
  union all select * from (select symbol, 3, row_number() over (order by change, symbol) as rank from t where volume >= 5000) where rank <= 12),
once as (select * from listed qualify row_number() over (partition by symbol order by s) = 1)
select symbol, ['major', 'volume', 'gain', 'loss'][s + 1] as side, rank::int as rank, change, volume from once join t using (symbol) order by s, rank limit 30""",
    "results_flattened": """
with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as size from customer),
rows as (
  select c_nationkey, i::int as row_index, unnest(['k', 'segment', 'deep']) as name, unnest([c_custkey::varchar, c_mktsegment, '{"n":' || c_nationkey || '}']) as value from c where c_nationkey % 3 < 2
  union all select c_nationkey, i::int, 'nation', c_nationkey::varchar from c where c_nationkey % 3 = 1
  union all select distinct c_nationkey, null, 'nation', c_nationkey::varchar from c where c_nationkey % 3 = 2
  union all select distinct c_nationkey, null, 'size', size::varchar from c where c_nationkey % 3 = 2)
select * from rows""",
    "boxes_disagreement": """
with recursive base as (select p_partkey % 40 as image, p_partkey as id, p_size / 60.0::double as cx, p_retailprice % 97 / 100 as cy, 0.2::double as w, 0.3::double as h from part),
moved as (select image, id, cx + (id % 7 - 3) / 40.0::double as cx, cy, w, h from base),
met as (
  select a.image, a.id as r, b.id as o, b.cx - a.cx as shift, greatest(least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2), 0) * greatest(least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2), 0) as both_, a.w * a.h + b.w * b.h as area
  from base a join moved b using (image)),
near as (select image, r, o, shift, both_ / (area - both_) as iou from met where both_ / (area - both_) >= 0.3),
queue as (select image, r, row_number() over (partition by image order by r) as k from (select distinct image, r from near)),
chosen as (
  select distinct image, 0::bigint as k, []::bigint[] as taken, null::struct(o bigint, iou double, shift double) as pick from queue
  union all
  select image, k, case when pick is null then taken else list_append(taken, pick.o) end, pick from (
    select c.image, q.k, c.taken, (select {'o': n.o, 'iou': n.iou, 'shift': n.shift} from near n where n.image = q.image and n.r = q.r and not list_contains(c.taken, n.o) order by n.iou desc, n.o limit 1) as pick
    from chosen c join queue q on q.image = c.image and q.k = c.k + 1)),
picks as (select image, pick.iou as iou, pick.shift as shift from chosen where pick is not null),
sizes as (select image, count(*) as n, (select count(*) from picks p where p.image = b.image and p.iou >= 0.8) as a, (select count(*) from picks p where p.image = b.image and p.iou < 0.8) as r from base b group by image)
select sum(n)::bigint as rule_boxes, sum(n)::bigint as owner_boxes, sum(a)::bigint as accepted, sum(r)::bigint as reshaped, sum(n - a - r)::bigint as deleted, sum(n - a - r)::bigint as added, round(sum(a) / sum(n), 4) as accept_rate, round(sum(n - a - r) / sum(n), 4) as delete_rate,
  case when sum(r) > 0 then 1.0 end as median_width_ratio, (select round(avg(shift), 4) from picks where iou < 0.8) as mean_x_shift, count(*) filter (a < n) as images_changed from sizes""",
    "rule_grid_segments": f"""{_BASE},
limits as (select f as fast_limit, u as full_limit from unnest({_FAST_LIMITS}::double[]) as a(f), unnest({_FULL_LIMITS}::double[]) as b(u)),
hits as (select symbol, (bar_i // {_WEEK})::int as week, bar_i, fast_limit, full_limit from enriched, limits where fast_spread <= fast_limit and full_spread <= full_limit),
marked as (select *, case when bar_i - lag(bar_i) over w > 4 then 1 else 0 end as new from hits window w as (partition by symbol, week, fast_limit, full_limit order by bar_i)),
counted as (select *, sum(new) over (partition by symbol, week, fast_limit, full_limit order by bar_i) as s from marked),
runs as (select symbol, week, fast_limit, full_limit, min(bar_i) as a, max(bar_i) as z, max(bar_i) - min(bar_i) + 1 as n from counted group by symbol, week, fast_limit, full_limit, s),
ahead as (
  {' union all '.join(f"select symbol, (bar_i // {_WEEK})::int as week, bar_i, {m} as m, avg(full_spread) over (partition by symbol, bar_i // {_WEEK} order by bar_i rows between current row and {m - 1} following) as mean from enriched" for m in _MAX_BARS)}),
best as (select r.symbol, r.week, r.a, r.z, m.m, arg_min(m.bar_i, (m.mean, m.bar_i)) as at from (select distinct symbol, week, a, z, n from runs) r join ahead m on m.symbol = r.symbol and m.week = r.week and r.n > m.m and m.bar_i >= r.a and m.bar_i + m.m - 1 <= r.z group by all)
select r.symbol, r.week, r.fast_limit, r.full_limit, x.min_bars, y.max_bars, coalesce(b.at, r.a) as start_i, coalesce(b.at + y.max_bars - 1, r.z) as end_i
from runs r join unnest({list(_MIN_BARS)}) as x(min_bars) on r.n >= x.min_bars cross join unnest({list(_MAX_BARS)}) as y(max_bars) left join best b on b.symbol = r.symbol and b.week = r.week and b.a = r.a and b.z = r.z and b.m = y.max_bars""",
}
