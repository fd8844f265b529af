"""DuckDB SQL for the queries of ``signal_queries``."""

from __future__ import annotations

from .oracles import _BASE, _POOL, _TRADES, AVERAGES, BARS, SIGNALS, _lag, _outcomes, _r, _roll
from .rich_oracles import _STEPS

_TIPS = f"""{_BASE},
runs as (select *, bar_i - coalesce(max(case when not coalesce(fast_spread <= 0.004, false) then bar_i end) over (partition by symbol order by bar_i), -1) as run from enriched)"""

_LAUNCHES = f"""{_TIPS},
sighted as (
  select *, {_roll('max', 'high', 20, None, 1)} as top, {_roll('min', 'low', 20, None, 1)} as bottom, {_roll('avg', 'volume', 20, None, 1)} as loud, {_roll('avg', 'close', 20)} as mean20, (cluster_max + cluster_min) / 2 as middle,
    max(case when run = 5 and bar_i >= 60 then bar_i end) over (partition by symbol order by bar_i) as arm_i, fast_spread - {_lag('fast_spread', 8)} as wider, {_lag('ema8', 1)} as p8, {_lag('ema21', 1)} as p21, {_lag('close', 1)} as pc
  from runs),
crossed as (select *, {_lag('mean20', 1)} as pm from sighted),
fired as (
  select symbol, bar_i, arm_i, case when close > top then 1 when close < bottom then -1 end as broken, loud > 0 and volume > loud * 1.5 as noisy,
    case when wider >= 0.00383 and middle > 0 then case when close >= middle then 1 else -1 end end as spread,
    coalesce(case when p8 <= p21 and ema8 > ema21 then 1 when p8 >= p21 and ema8 < ema21 then -1 end, case when pm is not null then case when pc <= pm and close > mean20 then 1 when pc >= pm and close < mean20 then -1 end end) as average
  from crossed where bar_i > arm_i and bar_i <= arm_i + 48),
kinds as (
  select symbol, bar_i, arm_i, 'range' as kind, broken as direction from fired union all select symbol, bar_i, arm_i, 'volume', case when noisy then broken end from fired
  union all select symbol, bar_i, arm_i, 'spread', spread from fired union all select symbol, bar_i, arm_i, 'average', average from fired),
firsts as (select symbol, kind, arm_i, min(bar_i) as bar_i, arg_min(direction, bar_i) as direction from kinds where direction is not null group by symbol, kind, arm_i),
apart as (
  select symbol, kind, min(bar_i) as bar_i from firsts group by symbol, kind
  union all
  select a.symbol, a.kind, (select min(f.bar_i) from firsts f where f.symbol = a.symbol and f.kind = a.kind and f.bar_i >= a.bar_i + 18) from apart a where a.bar_i is not null)
select f.symbol, f.kind, f.arm_i, f.bar_i, f.direction from firsts f join apart a on a.symbol = f.symbol and a.kind = f.kind and a.bar_i = f.bar_i"""

_SIX = f"""{_STEPS},
s1 as (
  select symbol, bar_i, close, volume, high, low, {', '.join(f"{_roll('avg', 'close', p)} as sma{p}" for p in (20, 60, 120))}, ema20, ema60, ema120, pre_range48, pre_range168, drawdown24, zero_volume96, volume_ratio from two),
s2 as (
  select *, greatest(sma20, ema20, sma60, ema60) as cmax, least(sma20, ema20, sma60, ema60) as cmin, (greatest(sma20, ema20, sma60, ema60, sma120, ema120) - least(sma20, ema20, sma60, ema60, sma120, ema120)) / nullif(close, 0) as full_spread,
    ema120 / nullif({_lag('ema120', 12)}, 0) - 1 as slow_slope_12, coalesce(sma20 >= sma60, false)::int + coalesce(ema20 >= ema60, false)::int + coalesce(sma60 >= sma120, false)::int + coalesce(ema60 >= ema120, false)::int as order_score,
    coalesce(sma20 <= sma60, false)::int + coalesce(ema20 <= ema60, false)::int + coalesce(sma60 <= sma120, false)::int + coalesce(ema60 <= ema120, false)::int as down_order_score
  from s1),
s3 as (
  select *, (cmax - cmin) / nullif(close, 0) as fast_spread, abs((cmax + cmin) / 2 - (sma120 + ema120) / 2) / nullif(close, 0) as fast_slow_gap, full_spread / nullif({_roll('min', 'full_spread', 48, 24)}, 0) as full_ratio_min48, close / nullif(cmax, 0) - 1 as ext_up
  from s2),
s4 as (select *, bar_i - coalesce(max(case when not coalesce(fast_spread <= 0.0028 * 1.6 and full_spread <= 0.0055 * 1.6, false) then bar_i end) over (partition by symbol order by bar_i), -1) as dense_run,
  case when full_ratio_min48 is not null and fast_spread is not null then greatest(0.0028 * 1.6 - fast_spread, 0) * 9000 + greatest(0.0055 * 1.6 - full_spread, 0) * 6500 + greatest(1.45 - full_ratio_min48, 0) * 8 + least(volume_ratio, 4.0) end as shape_score from s3)"""

_PATHS = f"""{_TRADES.split('filled as (')[0].rstrip().rstrip(',')},
ranges as (select symbol, bar_i, max(high) over w as top, min(low) over w as bottom from bars window w as (partition by symbol order by bar_i rows between 19 preceding and current row)),
walked as (
  select s.symbol, s.bar_i, s.atr14 as atr, top + 0.1 * s.atr14 as buy, bottom - 0.1 * s.atr14 as sell, f.open as e, b.bar_i - s.bar_i - 1 as j, b.open, b.high, b.low, b.close
  from signals s join ranges r using (symbol, bar_i) join bars f on f.symbol = s.symbol and f.bar_i = s.bar_i + 1 join bars b on b.symbol = s.symbol and b.bar_i between s.bar_i + 1 and s.bar_i + 24)"""


def _straddle(fade: bool) -> str:
    return f"""{_PATHS},
ends as (select symbol, bar_i, any_value(atr) as atr, any_value(buy) as buy, any_value(sell) as sell, arg_max(close, j) as last_close, min(j) filter (j < 12 and (high >= buy or low <= sell)) as k from walked group by symbol, bar_i),
opened as (
  select e.*, w.high >= e.buy as over_, w.low <= e.sell as under_, case when w.high >= e.buy then e.buy else e.sell end as entry, (w.high >= e.buy) <> {str(fade).lower()} as up
  from ends e left join walked w on w.symbol = e.symbol and w.bar_i = e.bar_i and w.j = e.k),
touched as (
  select o.symbol, o.bar_i, min(w.j) filter (case when up then w.high >= entry + 3 * o.atr else w.low <= entry - 3 * o.atr end) as u, min(w.j) filter (case when up then w.low <= entry - o.atr else w.high >= entry + o.atr end) as d
  from opened o join walked w on w.symbol = o.symbol and w.bar_i = o.bar_i and w.j >= o.k group by o.symbol, o.bar_i)
select o.symbol, o.bar_i, case when k is null then 'no_breakout' when over_ and under_ then 'ambiguous' else 'traded' end as state,
  case when k is not null and not (over_ and under_) then case when up then 1 else -1 end end as direction,
  round(case when k is null or (over_ and under_) then null when u is not null and (d is null or u <= d) then 3 * atr / entry when d is not null then -atr / entry when up then last_close / entry - 1 else entry / last_close - 1 end, 6) as gross
from opened o left join touched t using (symbol, bar_i)"""


_LOG = """logged as (
  select event_type as symbol, date_trunc('minute', ts) as signal_time, max(value / 100) as score, max(case when value < 50 then 'new' else 'open' end) as status from events where ts is not null and event_type is not null group by 1, 2)"""
_SUMMARY = "count(*) as n, count(distinct symbol) as symbols, min(entry_time) as first, max(entry_time) as last"
_RULE = ("fast_spread", "full_spread", "fast_slow_gap", "pre_range48", "pre_range168", "drawdown24", "runup24", "ext_up", "slow_slope_12", "volume_ratio")

SIGNAL_SQL: dict[str, str] = {
    "guarded_signals": f"""with recursive {_LOG},
known as (select symbol, signal_time from logged where signal_time < timestamp '2024-01-16'),
fresh as (select * from logged where signal_time >= timestamp '2024-01-15'),
held as (select f.* from fresh f semi join known k on k.symbol = f.symbol and k.signal_time = f.signal_time),
far as (
  select f.* from fresh f anti join known k on k.symbol = f.symbol and k.signal_time = f.signal_time
  where not exists (select 1 from known k where k.symbol = f.symbol and k.signal_time > f.signal_time - interval '4 hours' and k.signal_time < f.signal_time + interval '4 hours')),
apart as (
  select symbol, min(signal_time) as signal_time from far group by symbol
  union all
  select a.symbol, (select min(f.signal_time) from far f where f.symbol = a.symbol and f.signal_time >= a.signal_time + interval '4 hours') from apart a where a.signal_time is not null)
select * from held union all select f.* from far f semi join apart a on a.symbol = f.symbol and a.signal_time = f.signal_time""",
    "actionable_signals": f"with {_LOG} select * from logged where status = 'new' and score >= 0.2 and (epoch(timestamp '2024-01-20 12:00:00') - epoch(signal_time)) / 60 <= 1440",
    "expired_positions": f"with {_LOG} select symbol, count(*) filter ((epoch(timestamp '2024-01-20 12:00:00') - epoch(signal_time)) / 3600 >= 18) as expired, count(*) as n from logged where status = 'open' group by symbol",
    "base_rate_dense": f"""with recursive {BARS}, {AVERAGES}, {SIGNALS},
fit as (select a.symbol, a.bar_i, a.close, a.atr14, a.atr_pct from averaged a join last_bar l using (symbol) where bar_i >= 60 and bar_i + 25 <= last_i and atr_pct >= 0.0015),
drawn as (select *, row_number() over (partition by symbol order by md5(symbol || ':' || bar_i), bar_i) as k from fit),
control as (select d.symbol, d.bar_i, d.close, d.atr14, d.atr_pct from drawn d join (select symbol, count(*) as many from signals group by symbol) using (symbol) where k <= many),
{_outcomes('long').replace('filled', 'filled_a').replace('touched', 'touched_a').replace('outcomes as', 'outcomes_a as')},
{_outcomes('long').replace('filled', 'filled_b').replace('touched', 'touched_b').replace('outcomes as', 'outcomes_b as').replace('from signals s', 'from control s')},
nets as (select 'chosen' as pool, realized_ret - 0.0006 as net from outcomes_a union all select 'control', realized_ret - 0.0006 from outcomes_b),
stats as (
  select pool, count(*) as n, avg(net) as m, round(avg((net > 0)::int), 4) as win_rate, round(case when sum(net) filter (net < 0) < 0 then coalesce(sum(net) filter (net > 0), 0) / -sum(net) filter (net < 0) end, 3) as profit_factor from nets group by pool)
select pool, n, round(m, 5) as mean_net, win_rate, profit_factor, round(max(case when pool = 'chosen' then m end) over () - max(case when pool = 'control' then m end) over (), 5) as lift from stats""",
    "pool_summary": f"""{_POOL}, labelled as (select *, (outcome = 'tp')::int as label from trades)
select 'all' as "group", 'all' as value, {_SUMMARY} from labelled union all select 'outcome', outcome, {_SUMMARY} from labelled group by outcome union all select 'label', label::varchar, {_SUMMARY} from labelled group by label""",
    "causal_rule": f"""{_BASE},
ahead as (select *, lead(close, 24) over (partition by symbol order by bar_i) / close - 1 as ret from enriched),
sampled as (select ret > 0 as y, {', '.join(f'round({c}, 9) as {c}' for c in _RULE)} from ahead where ret is not null),
each as (unpivot sampled on {', '.join(_RULE)} into name feature value x),
stats as (
  select feature, quantile_cont(x, 0.5) filter (y) as p, quantile_cont(x, 0.5) filter (not y) as q, quantile_cont(x, 0.25) filter (y) as low, quantile_cont(x, 0.75) filter (y) as high, stddev_samp(x) as scale from each
  group by feature having count(*) filter (y) >= 30 and count(*) filter (not y) >= 30),
gapped as (select *, round(abs(p - q) / greatest(scale, 1e-12), 6) as gap from stats),
placed as (select *, row_number() over (order by gap desc, feature) as place from gapped)
select place, feature, case when p <= q then '<=' else '>=' end as op, round(case when p <= q then high else low end, 6) as threshold, gap, round(p, 6) as positive_median, round(q, 6) as negative_median from placed where place <= 5""",
    "dense_tips": f"{_TIPS} select symbol, bar_i from runs where run = 5",
    "launch_signals": _LAUNCHES,
    "direction_votes": f"""{_STEPS},
m as (select *, coalesce(close / nullif({_lag('close', 24)}, 0) - 1, 0) as m24, coalesce(close / nullif({_lag('close', 48)}, 0) - 1, 0) as m48, {_lag('ema55', 12)} as p55 from two)
select symbol, bar_i, case when close > ema200 then 1 else -1 end as ema200, case when close > ema120 then 1 else -1 end as ema120, case when ema55 - p55 > 0 then 1 else -1 end as slope55, case when m24 > 0 then 1 else -1 end as mom24,
  case when m48 > 0 then 1 else -1 end as mom48, case when close > ema200 and m24 > 0 then 1 when close < ema200 and m24 < 0 then -1 end as combo, 1 as long, -1 as short,
  case when close > greatest(ema8, ema21, ema55, ema200) then 1 when close < least(ema8, ema21, ema55, ema200) then -1 end as all_means
from m""",
    "segments_trimmed": f"""with recursive {BARS}, {AVERAGES},
measured as (select symbol, bar_i, round((greatest(ema8, ema21, ema55) - least(ema8, ema21, ema55)) / nullif(close, 0), 9) as spread from averaged),
hits as (select symbol, bar_i, bar_i - lag(bar_i) over (partition by symbol order by bar_i) as step from measured where spread <= 0.01),
grouped as (select *, sum((coalesce(step, 99) > 4)::int) over (partition by symbol order by bar_i) as g from hits),
found as (select symbol, min(bar_i) as a, max(bar_i) as z from grouped group by symbol, g having max(bar_i) - min(bar_i) + 1 >= 5),
twelve as (select symbol, bar_i, avg(spread) over w as m from measured window w as (partition by symbol order by bar_i rows between current row and 11 following)),
best as (select f.symbol, f.a, arg_min(m.bar_i, (m.m, m.bar_i)) as b from found f join twelve m on m.symbol = f.symbol and m.bar_i >= f.a and m.bar_i + 11 <= f.z where f.z - f.a + 1 > 12 group by f.symbol, f.a)
select symbol, coalesce(b, a) as start_i, coalesce(b + 11, z) as end_i, coalesce(b + 11, z) - coalesce(b, a) + 1 as n_bars from found left join best using (symbol, a)""",
    "top_signals": f"""with recursive {BARS}, {AVERAGES}, {SIGNALS},
placed as (select symbol, bar_i, round(atr_pct, 9) as atr_pct, row_number() over (partition by symbol order by round(atr_pct, 9) desc, bar_i) as k, count(*) over (partition by symbol) as n from signals)
select symbol, bar_i, atr_pct from placed where k <= greatest(ceil(n * 0.2), 1)""",
    "scan_windows": f"""with {BARS},
sizes as (select symbol, max(bar_i) + 1 as n from bars group by symbol having max(bar_i) + 1 >= 200)
select distinct symbol, unnest(list_append(range(0, n - 199, 50), n - 200)) as start_i, unnest(list_append(range(0, n - 199, 50), n - 200)) + 199 as end_i from sizes""",
    "maker_fills": f"{_POOL} select t.symbol, count(*) as n, count(*) filter (b.low < b.open) as filled from trades t join bars b on b.symbol = t.symbol and b.bar_i = t.bar_i + 1 group by t.symbol",
    "straddle_outcomes": _straddle(False),
    "fade_outcomes": _straddle(True),
    "oracle_sides": f"""{_PATHS},
hit as (
  select symbol, bar_i, any_value(e) as e, any_value(atr) as atr, arg_max(close, j) as c, min(j) filter (high >= e + 3 * atr) as lu, min(j) filter (low <= e - atr) as ld, min(j) filter (low <= e - 3 * atr) as su, min(j) filter (high >= e + atr) as sd
  from walked group by symbol, bar_i),
sides as (
  select symbol, bar_i, case when lu is not null and (ld is null or lu <= ld) then (e + 3 * atr) / e - 1 when ld is not null then (e - atr) / e - 1 else c / e - 1 end as long,
    case when su is not null and (sd is null or su <= sd) then e / (e - 3 * atr) - 1 when sd is not null then e / (e + atr) - 1 else e / c - 1 end as short
  from hit)
select symbol, bar_i, {_r('long', 'long')}, {_r('short', 'short')}, {_r('greatest(long, short)', 'oracle')} from sides""",
    "cool_down_trades": f"""with recursive {BARS}, {AVERAGES}, {SIGNALS.replace('signals as (select d.* from dense d join picked p using (symbol, bar_i))', 'signals as (select * from dense)')}, {_outcomes('long')},
taken as (
  select symbol, min(bar_i) as bar_i from outcomes group by symbol
  union all
  select t.symbol, (select min(n.bar_i) from outcomes n where n.symbol = t.symbol and n.bar_i >= (select o.bar_i + o.exit_offset + 4 from outcomes o where o.symbol = t.symbol and o.bar_i = t.bar_i)) from taken t where t.bar_i is not null)
select symbol, bar_i, bar_i + exit_offset as exit_i from outcomes join taken using (symbol, bar_i)""",
    "side_form_trades": f"""with recursive {BARS}, {AVERAGES}, {SIGNALS},
{_outcomes('long').replace('filled', 'filled_l').replace('touched', 'touched_l').replace('outcomes as', 'outcomes_l as')},
{_outcomes('short').replace('filled', 'filled_s').replace('touched', 'touched_s').replace('outcomes as', 'outcomes_s as')},
both_sides as (select *, 'long' as side from outcomes_l union all select *, 'short' from outcomes_s),
timed as (select o.symbol, o.bar_i, side, realized_ret, e.open_time as entry_time, e.open_time + exit_offset * interval '1 hour' as exit_time from both_sides o join bars e on e.symbol = o.symbol and e.bar_i = o.bar_i + 1)
select t.symbol, t.bar_i, t.side, round(case when count(p.side) >= 5 then avg(p.realized_ret) end, 6) as form
from timed t left join timed p on p.side = t.side and p.exit_time < t.entry_time and p.exit_time >= t.entry_time - interval '14 days' group by t.symbol, t.bar_i, t.side""",
    "regime_trades": f"""{_POOL},
lead_bars as (
  select *, case when count(*) over r >= 14 then avg((high - low) / nullif(close, 0)) over r end as range_pct, close / nullif(lag(close, 96) over o, 0) - 1 as ret
  from bars where symbol = 'view' window o as (order by bar_i), r as (order by bar_i rows between 13 preceding and current row)),
states as (select open_time, ret, case when count(range_pct) over m >= 100 then median(range_pct) over m end as mid, range_pct from lead_bars window m as (order by bar_i rows between 499 preceding and current row))
select t.symbol, t.bar_i, coalesce((s.range_pct > s.mid)::int::double, 0.0) as high_volatility, case when s.ret is null then 'unknown' when s.ret >= 0.03 then 'up' when s.ret <= -0.03 then 'down' else 'flat' end as bucket, round(realized_ret, 6) as realized_ret
from trades t join bars b on b.symbol = t.symbol and b.bar_i = t.bar_i left join states s on s.open_time = b.open_time""",
    "six_mean_candidates": f"""{_SIX}
select symbol, bar_i, order_score, down_order_score, greatest(order_score, down_order_score) as trend_order_score, dense_run::int as dense_run,
  coalesce(dense_run >= 5 and full_ratio_min48 <= 1.80 and pre_range48 <= 0.048 and pre_range168 <= 0.110 and drawdown24 <= 0.012 and ext_up between -0.003 and 0.012 and order_score >= 3 and abs(slow_slope_12) <= 0.0015 and zero_volume96 <= 0.02 and volume_ratio >= 0.5, false) as candidate,
  {', '.join(_r(c, c) for c in ('fast_spread', 'full_spread', 'fast_slow_gap', 'full_ratio_min48', 'slow_slope_12', 'ext_up', 'shape_score'))}
from s4""",
    "orders_checked": "select o_custkey, o_orderkey, coalesce(c_mktsegment, 'unknown') as c_mktsegment from orders left join (select c_custkey, c_mktsegment from customer where c_acctbal > 0) on c_custkey = o_custkey",
    "customers_flagged": "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 200000) as large from customer",
}
