"""DuckDB SQL for the queries of ``plans.queries``, from shared common table expressions."""

from __future__ import annotations

_WALK = """
ticks as (
  select event_type as symbol, ts, event_id, cast(round(value * 100) as bigint) - 4963 as cents, time_bucket(interval '{width}', ts) as open_time
  from events where event_type is not null and ts is not null and event_id is not null and value is not null),
walk as (select *, 100.0::double + sum(cents) over (partition by symbol order by ts, event_id)::double / 20000.0::double as price from ticks),
bars as (
  select symbol, open_time, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close,
    count(*)::double as volume, row_number() over (partition by symbol order by open_time) - 1 as bar_i
  from walk group by symbol, open_time)"""
BARS = _WALK.format(width="1 hour")

_SPANS = (8, 13, 21, 34, 55, 144, 200)
_EMA_0 = ", ".join(f"close as ema{n}" for n in _SPANS)
_EMA_N = ", ".join(f"(2.0::double / {n + 1}) * b.close + (1.0::double - 2.0::double / {n + 1}) * e.ema{n} as ema{n}" for n in _SPANS)
AVERAGES = f"""
ranged as (
  select *, greatest(high - low, abs(high - lag(close) over (partition by symbol order by bar_i)), abs(low - lag(close) over (partition by symbol order by bar_i))) as tr from bars),
means as (
  select symbol, bar_i, {_EMA_0}, tr as atr14 from ranged where bar_i = 0
  union all
  select b.symbol, b.bar_i, {_EMA_N}, (1.0::double / 14) * b.tr + (1.0::double - 1.0::double / 14) * e.atr14
  from means e join ranged b on b.symbol = e.symbol and b.bar_i = e.bar_i + 1),
averaged as (select r.*, m.* exclude (symbol, bar_i), m.atr14 / nullif(r.close, 0) as atr_pct from ranged r join means m using (symbol, bar_i))"""


def _roll(f: str, x: str, n: int, least: int | None = None, shift: int = 0) -> str:
    frame = f"over (partition by symbol order by bar_i rows between {n - 1 + shift} preceding and {f'{shift} preceding' if shift else 'current row'})"
    return f"case when count({x}) {frame} >= {n if least is None else least} then {f}({x}) {frame} end"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over (partition by symbol order by bar_i)"


_FAST, _ALL = ", ".join(f"ema{n}" for n in _SPANS[:5]), ", ".join(f"ema{n}" for n in _SPANS)
INDICATORS = f"""
first_step as (
  select *, greatest({_FAST}) as cluster_max, least({_FAST}) as cluster_min, (greatest({_ALL}) - least({_ALL})) / nullif(close, 0) as full_spread,
    coalesce((volume - ({_roll('avg', 'volume', 96, 20)})) / nullif({_roll('stddev_samp', 'volume', 96, 20)}, 0), 0.0) as volume_z,
    coalesce(volume / nullif({_roll('avg', 'volume', 20, 5)}, 0), 0.0) as volume_ratio,
    (({_roll('max', 'high', 48)}) - ({_roll('min', 'low', 48)})) / nullif(close, 0) as pre_range48,
    (({_roll('max', 'high', 168)}) - ({_roll('min', 'low', 168)})) / nullif(close, 0) as pre_range168,
    ({_roll('max', 'high', 24)}) / nullif(close, 0) - 1 as drawdown24, close / nullif({_roll('min', 'low', 24)}, 0) - 1 as runup24,
    ema200 / nullif({_lag('ema200', 12)}, 0) - 1 as slow_slope_12, {_roll('avg', '(case when volume <= 0 then 1.0 else 0.0 end)', 96)} as zero_volume96
  from averaged),
second_step as (
  select *, (cluster_max - cluster_min) / nullif(close, 0) as fast_spread, abs((cluster_max + cluster_min) / 2 - (ema144 + ema200) / 2) / nullif(close, 0) as fast_slow_gap,
    full_spread / nullif({_roll('min', 'full_spread', 48, 24)}, 0) as full_ratio_min48, close / nullif(cluster_max, 0) - 1 as ext_up, cluster_min / nullif(close, 0) - 1 as ext_down,
    abs(slow_slope_12) as slow_slope_abs, (ema8 >= ema13)::int + (ema13 >= ema21)::int + (ema21 >= ema34)::int + (ema34 >= ema55)::int as order_score,
    (ema8 <= ema13)::int + (ema13 <= ema21)::int + (ema21 <= ema34)::int + (ema34 <= ema55)::int as down_order_score
  from first_step),
enriched as (
  select *, case when full_ratio_min48 is not null then greatest(0.0028 - fast_spread, 0) * 9000 + greatest(0.0055 - full_spread, 0) * 6500
    + greatest(0.0035 - fast_slow_gap, 0) * 5000 + greatest(1.45 - full_ratio_min48, 0) * 8 + least(volume_ratio, 4.0) end as shape_score
  from second_step)"""
_BASE = f"with recursive {BARS}, {AVERAGES}, {INDICATORS}"

# The flagship: dense bars, from left to right at least 18 apart, target 5 and stop 2 ATRs within 24 bars.
SIGNALS = """
last_bar as (select symbol, max(bar_i) as last_i from bars group by symbol),
dense as (
  select a.symbol, a.bar_i, a.close, a.atr14, a.atr_pct from averaged a join last_bar l using (symbol)
  where (greatest(ema8, ema21, ema55) - least(ema8, ema21, ema55)) / nullif(close, 0) <= 0.01 and bar_i >= 60 and bar_i + 25 <= last_i and atr_pct >= 0.0015),
picked as (
  select symbol, min(bar_i) as bar_i from dense group by symbol
  union all
  select p.symbol, (select min(d.bar_i) from dense d where d.symbol = p.symbol and d.bar_i >= p.bar_i + 18) as bar_i
  from picked p where p.bar_i is not null),
signals as (select d.* from dense d join picked p using (symbol, bar_i))"""


def _outcomes(side: str) -> str:
    up, down = ("f.open + 5 * s.atr14", "f.open - 2 * s.atr14") if side == "long" else ("f.open - 5 * s.atr14", "f.open + 2 * s.atr14")
    hit_up, hit_down = ("b.high >= g.up", "b.low <= g.down") if side == "long" else ("b.low <= g.up", "b.high >= g.down")
    ret = (lambda p: f"{p} / entry_price - 1") if side == "long" else (lambda p: f"entry_price / {p} - 1")
    return f"""
filled as (select s.*, f.open as entry_price, {up} as up, {down} as down from signals s join bars f on f.symbol = s.symbol and f.bar_i = s.bar_i + 1),
touched as (
  select g.symbol, g.bar_i, any_value(g.entry_price) as entry_price, any_value(g.up) as up, any_value(g.down) as down,
    min(case when {hit_up} then b.bar_i - g.bar_i end) as u, min(case when {hit_down} then b.bar_i - g.bar_i end) as d, arg_max(b.close, b.bar_i) as last_close
  from filled g join bars b on b.symbol = g.symbol and b.bar_i between g.bar_i + 1 and g.bar_i + 24 group by g.symbol, g.bar_i),
outcomes as (
  select symbol, bar_i, entry_price, case when u is not null and (d is null or u < d) then 'tp' when d is null then 'timeout' when u = d then 'sl_ambiguous' else 'sl' end as outcome,
    coalesce(least(u, d), 24) as exit_offset,
    case when u is not null and (d is null or u < d) then {ret('up')} when d is not null then {ret('down')} else {ret('last_close')} end as realized_ret
  from touched)"""


_TRADES = f"with recursive {BARS}, {AVERAGES}, {SIGNALS}, {_outcomes('long')}"
_POOL = f"""{_TRADES},
trades as (
  select o.*, 'long' as side, e.open_time as entry_time, e.open_time + exit_offset * interval '1 hour' as exit_time
  from outcomes o join bars e on e.symbol = o.symbol and e.bar_i = o.bar_i + 1)"""

_MONTH, _QUARTER = "strftime(o_orderdate, '%Y-%m')", "year(o_orderdate) || 'Q' || quarter(o_orderdate)"
_PERIODS = """with nets as (select {label} as period, (o_orderkey % 200 - 97) / 1000.0::double - 0.003 as net from orders),
periods as (
  select period, count(*) as n, round(sum(net), 6) as sum_net, round(case when sum(net) filter (net < 0) < 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net < 0) end, 6) as profit_factor from nets group by period)"""

_FACTORS = f"""{_BASE},
helped as (
  select *, close / nullif({_lag('close', 1)}, 0) - 1 as ret1, close - {_lag('close', 1)} as diff1, {_roll('avg', '((high - low) / nullif(close, 0))', 5)} as range5,
    sum(coalesce(sign(close - p1), 0) * volume) over (partition by symbol order by bar_i) as obv
  from (select *, {_lag('close', 1)} as p1 from enriched))
select symbol, bar_i, {{columns}} from helped"""
_C10 = "over (partition by symbol order by bar_i rows between 9 preceding and current row)"
_C20 = "over (partition by symbol order by bar_i rows between 19 preceding and current row)"
_FACTOR_SQL = {
    "rev5": f"-(close / nullif({_lag('close', 5)}, 0) - 1)",
    "mom20": f"close / nullif({_lag('close', 20)}, 0) - 1",
    "hl_pos": f"(close - ({_roll('min', 'low', 20)})) / nullif(({_roll('max', 'high', 20)}) - ({_roll('min', 'low', 20)}), 0)",
    "vol_share": f"volume / nullif({_roll('avg', 'volume', 20)}, 0)",
    "close_to_high": "(high - close) / nullif(high - low, 0)",
    "illiq": f"({_roll('avg', '(abs(ret1) / nullif(volume, 0))', 20)}) * 1e6",
    "updown_vol": f"({_roll('sum', '(sign(diff1) * volume)', 20)}) / nullif({_roll('sum', 'volume', 20)}, 0)",
    "ret_skew": f"case when count(ret1) {_C20} >= 20 then skewness(ret1) {_C20} end",
    "vol_of_vol": _roll("stddev_samp", "range5", 20),
    "ts_rank_close": f"case when count(close) {_C20} >= 20 then len(list_filter(list(close) {_C20}, lambda v: v <= close)) / 20.0 end",
    "boll_pos": f"(close - ({_roll('avg', 'close', 20)})) / nullif({_roll('stddev_samp', 'close', 20)}, 0)",
    "range_compress": f"(({_roll('max', 'high', 5)}) - ({_roll('min', 'low', 5)})) / nullif(({_roll('max', 'high', 20)}) - ({_roll('min', 'low', 20)}), 0)",
    "vwap_dev": f"close / nullif(({_roll('sum', '((high + low + close) / 3 * volume)', 20)}) / nullif({_roll('sum', 'volume', 20)}, 0), 0) - 1",
    "obv_slope": f"(obv - {_lag('obv', 20)}) / 20 / nullif({_roll('avg', 'abs(obv)', 20, 10)}, 0)",
    "taker_imbalance": f"({_roll('avg', '((close - low) / nullif(high - low, 0) * volume)', 20, 10)}) / nullif({_roll('avg', 'volume', 20, 10)}, 0)",
    "ma_order_score": "((ema8 >= ema13)::int + (ema13 >= ema21)::int + (ema21 >= ema34)::int + (ema34 >= ema55)::int + (ema55 >= ema144)::int)::double",
    "convergence_speed": f"(fast_spread - {_lag('fast_spread', 4)}) - ({_lag('fast_spread', 4)} - {_lag('fast_spread', 8)})",
    "ma_bandwidth_pct": "(greatest(ema8, ema13, ema21, ema34, ema55, ema144) - least(ema8, ema13, ema21, ema34, ema55, ema144)) / nullif(close, 0)",
    "vol_dryup": f"coalesce(({_roll('sum', '(volume * (fast_spread <= 0.0028)::int)', 8, 1)}) / nullif({_roll('sum', '(fast_spread <= 0.0028)::int', 8, 1)}, 0), {_roll('avg', 'volume', 8, 1)}) / nullif({_roll('avg', 'volume', 48, 24, 8)}, 0)",
}

_r = lambda e, name: f"round({e}, 6) + 0.0 as {name}"

ORACLE_SQL: dict[str, str] = {
    "bars_1h": f"with {BARS} select symbol, open_time, open, high, low, close, volume, bar_i from bars",
    "bars_4h_resampled": f"""with {BARS},
wide as (
  select symbol, time_bucket(interval '4 hours', open_time) as t, arg_min(open, open_time) as open, max(high) as high, min(low) as low, arg_max(close, open_time) as close, sum(volume) as volume
  from bars group by symbol, t)
select symbol, t as open_time, open, high, low, close, volume, row_number() over (partition by symbol order by t) - 1 as bar_i from wide""",
    "bars_audit": f"""with {BARS},
stepped as (
  select *, epoch(open_time) - epoch(lag(open_time) over w) as step, close / nullif(lag(close) over w, 0) - 1 as ret from bars window w as (partition by symbol order by open_time)),
found as (
  select symbol, count(*) as n_bars, min(open_time) as first_time, max(open_time) as last_time, count(*) filter (step > 1.5 * 3600) as n_gaps, coalesce(round(max(step) / 3600, 2), 0) as max_gap_hours,
    round(avg((coalesce(volume, 0) <= 0)::int::double), 4) as zero_vol_share, count(*) filter (abs(ret) > 0.25) as spike_bars,
    count(*) filter (high < low or high < open or high < close or low > open or low > close or least(open, high, low, close) <= 0) as ohlc_bad,
    round((epoch(timestamp '2024-02-01 12:00:00') - epoch(max(open_time))) / 3600, 1) as age_hours
  from stepped group by symbol),
flagged as (
  select *, concat_ws('|', case when n_gaps > 5 then 'gaps>5' end, case when zero_vol_share > 0.02 then 'zero_vol>0.02' end, case when spike_bars >= 3 then 'spikes>=3' end,
    case when ohlc_bad > 0 then 'ohlc_bad' end, case when age_hours > 48 then 'stale>48.0h' end) as reasons from found)
select *, reasons <> '' as flagged, ohlc_bad > 0 or n_gaps > 5 or zero_vol_share > 0.05 or spike_bars >= 8 as blacklist_candidate from flagged""",
    "shipments_keep_last": """
select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc) as k from lineitem)
where k = 1""",
    "averages": f"with recursive {BARS}, {AVERAGES} select symbol, bar_i, {', '.join(_r(f'ema{n}', f'ema{n}') for n in _SPANS)}, {_r('atr14', 'atr14')}, {_r('atr_pct', 'atr_pct')} from averaged",
    "indicators": f"{_BASE} select symbol, bar_i, {', '.join(_r(c, c) for c in ('volume_z', 'volume_ratio', 'fast_spread', 'full_spread', 'fast_slow_gap', 'full_ratio_min48', 'pre_range48', 'pre_range168', 'drawdown24', 'runup24', 'ext_up', 'ext_down', 'slow_slope_12', 'zero_volume96', 'shape_score'))}, order_score, down_order_score from enriched",
    "features": f"""{_BASE},
dense as (select *, max(case when not coalesce(fast_spread <= 0.0028, false) then bar_i end) over (partition by symbol order by bar_i) as broken from enriched)
select symbol, bar_i, {', '.join(_r(c, c) for c in ('full_spread', 'fast_slow_gap', 'full_ratio_min48', 'ext_up', 'slow_slope_12', 'volume_ratio', 'volume_z', 'atr_pct', 'pre_range48', 'pre_range168', 'drawdown24'))},
  {_r('fast_spread', 'ma_spread_pct')}, order_score, {_r(_roll('avg', 'fast_spread', 8), 'spread_mean8')}, {_r(_roll('avg', 'fast_spread', 24), 'spread_mean24')},
  {_r('fast_spread - ' + _lag('fast_spread', 8), 'spread_chg8')}, {_r('fast_spread - ' + _lag('fast_spread', 24), 'spread_chg24')},
  {_r('(fast_spread - (' + _roll('min', 'fast_spread', 96, 48) + ')) / nullif((' + _roll('max', 'fast_spread', 96, 48) + ') - (' + _roll('min', 'fast_spread', 96, 48) + '), 0)', 'spread_pos96')},
  (bar_i - coalesce(broken, -1))::int as dense_run_len, {_r(_roll('avg', '(case when fast_spread <= 0.0028 then 1.0 else 0.0 end)', 48, 24), 'dense_frac48')},
  {_r('close / nullif(ema55, 0) - 1', 'close_vs_ema55')}, {_r('close / nullif(ema200, 0) - 1', 'close_vs_ema200')}, {_r(_roll('avg', 'volume_ratio', 8), 'vol_ratio_mean8')},
  {_r('atr_pct / nullif(' + _roll('avg', 'atr_pct', 96, 48) + ', 0)', 'atr_pct_ratio96')}, {', '.join(_r(f'close / nullif({_lag("close", n)}, 0) - 1', f'ret_{n}') for n in (4, 12, 24, 48))}
from dense""",
    "factors": _FACTORS.format(columns=", ".join(_r(e, n) for n, e in _FACTOR_SQL.items())),
    "dense_signals": f"with recursive {BARS}, {AVERAGES}, {SIGNALS} select symbol, bar_i, round(close, 6) as close, round(atr14, 6) as atr14 from signals",
    "barrier_long": f"{_TRADES} select symbol, bar_i, outcome, exit_offset::int as exit_offset, round(entry_price, 6) as entry_price, round(realized_ret, 6) as realized_ret from outcomes",
    "barrier_short": f"with recursive {BARS}, {AVERAGES}, {SIGNALS}, {_outcomes('short')} select symbol, bar_i, outcome, exit_offset::int as exit_offset, round(entry_price, 6) as entry_price, round(realized_ret, 6) as realized_ret from outcomes where entry_price > 0",
    "barrier_metrics": f"""{_POOL},
run as (select *, realized_ret - 0.003 as net, 10 + sum(realized_ret - 0.003) over (partition by symbol order by exit_time, symbol, bar_i) as equity from trades),
peaks as (select *, greatest(10, max(equity) over (partition by symbol order by exit_time, symbol, bar_i)) as peak from run)
select symbol, count(*) as n_trades, round(sum(net), 4) as net_total, round(sum(net) / 10, 4) as net_on_capital, round(avg(net), 5) as mean_net, round(avg((net > 0)::int::double), 4) as win_rate,
  round(case when sum(net) filter (net < 0) < 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net < 0) else 'infinity'::double end, 3) as profit_factor, round(max((peak - equity) / peak), 4) as max_drawdown
from peaks group by symbol""",
    "factor_vp_corr": f"""with {BARS}
select symbol, bar_i, round(case when count(*) {_C10} = 10 then covar_samp(close, volume) {_C10} / nullif(stddev_samp(close) {_C10} * stddev_samp(volume) {_C10}, 0) end, 6) + 0.0 as vp_corr from bars""",
    "side_cost_grid": f"""with recursive {BARS}, {AVERAGES}, {SIGNALS},
{_outcomes('long').replace('filled', 'filled_l').replace('touched', 'touched_l').replace('outcomes as', 'outcomes_l as')},
{_outcomes('short').replace('filled', 'filled_s').replace('touched', 'touched_s').replace('outcomes as', 'outcomes_s as')},
both_sides as (select 'long' as side, realized_ret from outcomes_l union all select 'short', realized_ret from outcomes_s),
costed as (select side, cost_name, realized_ret - cost as net from both_sides, (values ('gross', 0.0), ('maker', 0.001), ('taker', 0.003)) c(cost_name, cost))
select coalesce(side, 'both') as side, cost_name, count(*) as n, round(avg((net > 0)::int::double), 6) as win_rate, round(avg(net), 6) as mean_net, round(sum(net), 6) as sum_net,
  round(case when sum(net) filter (net < 0) < 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net < 0) end, 6) as profit_factor
from costed group by grouping sets ((side, cost_name), (cost_name))""",
    "trades_by_month": f"""{_POOL}
select strftime(exit_time, '%Y-%m') as period, count(*) as n, round(sum(realized_ret - 0.003), 6) as sum_net,
  round(case when sum(realized_ret - 0.003) filter (realized_ret < 0.003) < 0 then coalesce(sum(realized_ret - 0.003) filter (realized_ret > 0.003), 0) / -sum(realized_ret - 0.003) filter (realized_ret < 0.003) end, 6) as profit_factor
from trades group by 1""",
    "signals_asof_trend": f"""{_POOL},
hours as (select symbol, open_time + interval '1 hour' as closed_at, close as hour_close from bars)
select t.symbol, t.bar_i, t.entry_time, h.hour_close from trades t asof left join hours h on t.symbol = h.symbol and t.entry_time >= h.closed_at""",
    "orders_in_trades": f"""{_POOL},
settled as (select o_orderdate as t, sum(round(o_totalprice)::bigint)::double as v from orders where o_orderdate is not null and o_totalprice is not null group by 1),
span as (select min(t) as a, max(t) as z from settled)
select t.symbol, t.bar_i, case when s.a <= t.exit_time and s.z >= t.entry_time then coalesce((select sum(v) from settled f where f.t > t.entry_time and f.t <= t.exit_time), 0) end as settled from trades t, span s""",
    "events_without_neighbour": """
with a as (select event_id, user_id, event_type, ts from events where coalesce(event_type in ('click', 'view'), false)), b as (select user_id, ts from events where not coalesce(event_type in ('click', 'view'), false))
select event_id, user_id, event_type, ts from a where not exists (select 1 from b where b.user_id = a.user_id and b.ts between a.ts - interval '1 hour' and a.ts + interval '1 hour')""",
    "value_deciles": """
with r as (select value, user_id, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as k, count(*) over () as n from events where value is not null)
select (floor(least(k / n * 10, 9.999)) + 1)::int as decile, count(*) as n, round(avg(user_id), 6) as mean_value, round(sum(user_id), 6)::bigint as sum_value from r group by 1""",
    "quality_ranking": """
with x as (select l.quality::bigint as y, d.n_chars::double as s from labels l join documents d using (doc_id) where l.quality is not null and d.n_chars is not null),
g as (select s, count(*) as n, sum(y) as p from x group by s),
r as (select *, coalesce(sum(n - p) over (order by s rows between unbounded preceding and 1 preceding), 0) as below, sum(n) over (order by s desc rows unbounded preceding) as nt, sum(p) over (order by s desc rows unbounded preceding) as pt from g)
select sum(n)::bigint as n, round(sum(p) / sum(n), 6) as positive_rate, round(sum(p * (below + (n - p) / 2.0)) / (sum(p) * sum(n - p)), 6) as roc_auc, round(sum(p * pt / nt) / sum(p), 6) as average_precision from r""",
    "dense_segments": f"""with recursive {BARS}, {AVERAGES},
hits as (select symbol, bar_i, bar_i - lag(bar_i) over (partition by symbol order by bar_i) as step from averaged where (greatest(ema8, ema21, ema55) - least(ema8, ema21, ema55)) / nullif(close, 0) <= 0.01),
grouped as (select *, sum((coalesce(step, 99) > 4)::int) over (partition by symbol order by bar_i) as g from hits)
select symbol, min(bar_i) as start_i, max(bar_i) as end_i, max(bar_i) - min(bar_i) + 1 as n_bars from grouped group by symbol, g having max(bar_i) - min(bar_i) + 1 >= 5""",
    "events_overlap": """
with a as (select event_id, user_id, ts from events where coalesce(event_type in ('click', 'view'), false)), b as (select event_id, user_id, ts from events where not coalesce(event_type in ('click', 'view'), false)),
na as (select a.event_id, min(abs(epoch_us(a.ts) - epoch_us(b.ts))) / 1e6 as s from a left join b using (user_id) group by a.event_id),
nb as (select b.event_id, min(abs(epoch_us(a.ts) - epoch_us(b.ts))) / 1e6 as s from b left join a using (user_id) group by b.event_id),
x as (select count(*) as n_a, count(*) filter (s <= 3600) as hit_a, quantile_cont(s, 0.5) filter (s <= 3600) as median_s from na),
y as (select count(*) as n_b, count(*) filter (s <= 3600) as hit_b from nb)
select *, hit_a / nullif(n_a, 0) as recall, hit_b / nullif(n_b, 0) as precision from x, y""",
    "orders_reconciled": """
with a as (select o_orderkey, o_totalprice as v from orders where o_orderkey % 7 <> 0),
b as (select o_orderkey, case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 5 <> 0)
select count(*) filter (a.o_orderkey is not null and b.o_orderkey is not null) as n_both, count(*) filter (b.o_orderkey is null) as only_a, count(*) filter (a.o_orderkey is null) as only_b,
  count(*) filter (abs(a.v - b.v) > 1e-9) as n_different from a full join b on a.o_orderkey = b.o_orderkey""",
    "quarter_metrics": f"{_PERIODS.format(label=_QUARTER)} select * from periods",
    "month_concentration": f"""{_PERIODS.format(label=_MONTH)},
kept as (select * from periods where n >= 20 or not exists (select 1 from periods where n >= 20)),
ranked as (select *, row_number() over (order by sum_net desc, period) as k from kept),
found as (
  select count(*) as n_periods, round(sum(sum_net) filter (k <= 1) / nullif(sum(sum_net), 0), 6) as top1, round(sum(sum_net) filter (k <= 2) / nullif(sum(sum_net), 0), 6) as top2, count(*) filter (profit_factor >= 1.3) as n_good from ranked)
select *, coalesce(top1 > 0.6, false) as fragile from found""",
    "equity_points": f"""{_POOL},
run as (select *, sum(realized_ret - 0.003) over (partition by symbol order by exit_time, symbol, bar_i) as equity from trades),
peaks as (select *, greatest(0, max(equity) over (partition by symbol order by exit_time, symbol, bar_i)) as peak from run)
select symbol, exit_time, round(arg_max(equity, bar_i), 6) + 0.0 as equity, round(arg_max(peak, bar_i) - arg_max(equity, bar_i), 6) + 0.0 as drawdown from peaks group by symbol, exit_time""",
    "trade_utilisation": f"""{_POOL}
select round(sum(epoch(exit_time) - epoch(entry_time)) / (max(epoch(exit_time)) - min(epoch(entry_time))), 6) as utilisation from trades""",
    "user_loss_runs": """
with r as (select user_id, sum(coalesce((value - 50 >= 0)::int, 1)) over (partition by user_id order by event_id desc) as b from events)
select user_id, count(*) filter (b = 0) as losses from r group by user_id""",
    "props_parsed": """
select event_type, count(props->>'$.k') as n, sum((props->>'$.k')::bigint)::bigint as total, max((props->>'$.k')::bigint) as most from events group by event_type""",
    "fresh_signals": """
select event_id, round(floor(epoch(ts) - epoch(date_trunc('hour', ts))) / 60.0, 6) as lag_min, floor(epoch(ts) - epoch(date_trunc('hour', ts))) / 60.0 between 0 and 30 as is_live from events""",
    "split_events": """
with o as (select ts, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events where ts is not null),
v as (select ts as start from o where i = floor(n * 0.8)),
s as (select ts, case when i >= floor(n * 0.8) then 'val' when ts < start - interval '3600 seconds' then 'train' else 'purged' end as split from o, v)
select split, count(*) as n, min(ts) as first, max(ts) as last from s group by split""",
    "segment_top_customers": """
select c_mktsegment, rank::int as rank, c_custkey, c_acctbal, (case when c_acctbal >= 9900 then 3 when c_acctbal >= 9000 then 2 when c_acctbal >= 0 then 1 else 0 end)::int as tier from (
  select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 5""",
    "rising_runs": f"""with {BARS},
u as (select *, coalesce(close > lag(close) over (partition by symbol order by bar_i), false) as up, case when volume > 3 then close end as x from bars)
select symbol, bar_i, (bar_i - coalesce(max(case when not up then bar_i end) over (partition by symbol order by bar_i), -1))::int as run,
  last_value(x ignore nulls) over (partition by symbol order by bar_i rows between 3 preceding and current row) as filled from u""",
    "hourly_trend": f"""with recursive {BARS},
wide as (select symbol, time_bucket(interval '4 hours', open_time) as t, arg_max(close, open_time) as close from bars group by symbol, t),
numbered as (select *, row_number() over (partition by symbol order by t) - 1 as bar_i from wide),
m as (
  select symbol, bar_i, close as m55, close as m144 from numbered where bar_i = 0
  union all
  select b.symbol, b.bar_i, (2.0::double / 56) * b.close + (1.0::double - 2.0::double / 56) * e.m55, (2.0::double / 145) * b.close + (1.0::double - 2.0::double / 145) * e.m144
  from m e join numbered b on b.symbol = e.symbol and b.bar_i = e.bar_i + 1)
select symbol, bar_i, round(m55, 6) + 0.0 as m55, round(m144, 6) + 0.0 as m144, round(m55 - lag(m55, 12) over (partition by symbol order by bar_i), 6) + 0.0 as slope from m""",
    "forward_merge": """
with keyed as (select event_type as symbol, date_trunc('minute', ts) as signal_time, event_id, value, user_id % 2 = 0 as closed from events),
held as (select * from keyed where event_id % 3 <> 0 qualify row_number() over (partition by symbol, signal_time order by event_id) = 1),
fresh as (select * from keyed where event_id % 3 <> 1 qualify row_number() over (partition by symbol, signal_time order by event_id) = 1)
select coalesce(h.symbol, f.symbol) as symbol, coalesce(h.signal_time, f.signal_time) as signal_time, case when h.symbol is null or (not h.closed and f.symbol is not null) then f.value else h.value end as value,
  case when h.symbol is null then f.closed when f.symbol is null then h.closed else h.closed or f.closed end as closed
from held h full join fresh f on h.symbol = f.symbol and h.signal_time = f.signal_time""",
}
