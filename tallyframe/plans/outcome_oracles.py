"""DuckDB SQL for open outcomes, excursions, the forward log's decision and weighted metrics."""

from __future__ import annotations

from .oracles import _POOL, AVERAGES, BARS, SIGNALS

_OPEN = f"""with recursive {BARS}, {AVERAGES}, {SIGNALS.replace('and bar_i + 25 <= last_i ', '')},
walked as (
  select s.symbol, s.bar_i, s.close as signal_close, s.atr14 as atr, s.atr_pct, f.open as e, b.bar_i - s.bar_i - 1 as j, b.open_time, b.open, b.high, b.low, b.close
  from signals s left join bars f on f.symbol = s.symbol and f.bar_i = s.bar_i + 1 left join bars b on b.symbol = s.symbol and b.bar_i between s.bar_i + 1 and s.bar_i + 24),
seen as (
  select symbol, bar_i, any_value(signal_close) as signal_close, any_value(e) as e, any_value(atr) as atr, count(j) as n, min(j) filter (high >= e + 5 * atr) as u, min(j) filter (low <= e - 2 * atr) as d,
    arg_min(open, j) filter (low <= e - 2 * atr) as d_open, min(j) filter (high >= e + 2.5 * atr) as h, arg_max(close, j) as last_close, min(open_time) as entry_time, arg_min(low, j) as low0, arg_min(open, j) as open0
  from walked group by symbol, bar_i)"""

_NET = "(realized_ret - 0.0006)"
_LOG = """with logged as (
  select event_id, event_type as symbol, date_trunc('hour', ts) as signal_time, ts as detected_at, case when event_type = 'error' then 'open' else 'closed' end as status, case when event_type = 'view' then '' else event_type end as outcome,
    (value - 50) / 1000 as realized_ret, event_type <> 'signup' as maker_filled from events),
judged as (
  select *, coalesce(status = 'closed' and realized_ret is not null, false) as done, coalesce(status = 'closed' and realized_ret is not null and maker_filled and (epoch_us(detected_at) - epoch_us(signal_time)) / 6e7 <= 30, false) as ok from logged)"""
_TIGHT = [(a, s) for a in (1, 2, 3) for s in ("1", "1_5")]
_EXCURSIONS = f"""{_POOL.split('trades as (')[0].rstrip().rstrip(',')},
walked as (
  select s.symbol, s.bar_i, s.atr14 as atr, f.open as e, b.bar_i - s.bar_i - 1 as j, b.high, b.low, b.close
  from signals s join bars f on f.symbol = s.symbol and f.bar_i = s.bar_i + 1 join bars b on b.symbol = s.symbol and b.bar_i between s.bar_i + 1 and s.bar_i + 24),
gone as (
  select symbol, bar_i, {', '.join(f"any_value(close / e - 1) filter (j = {n}) as ret{n}" for n in (4, 8, 12, 24, 48))}, max(high) / any_value(e) - 1 as mfe, min(low) / any_value(e) - 1 as mae, any_value(e) as e, any_value(atr) as atr, arg_max(close, j) as last_close,
    {', '.join(f"min(j) filter (high >= e + {a} * atr) as u{a}" for a in (1, 2, 3))}, min(j) filter (low <= e - atr) as d1, min(j) filter (low <= e - 1.5 * atr) as d2
  from walked group by symbol, bar_i),
netted as (
  select *, {', '.join(f'''case when u{a} is not null and ({d} is null or u{a} <= {d}) then {a} * atr / e when {d} is not null then -{s.replace('_', '.')} * atr / e else last_close / e - 1 end - 0.0006 as net_tp{a}_sl{s}''' for a, s in _TIGHT for d in ('d1' if s == '1' else 'd2',))} from gone)"""


def _pf(x: str) -> str:
    return f"case when sum({x}) filter ({x} < 0) < 0 then coalesce(sum({x}) filter ({x} > 0), 0) / -sum({x}) filter ({x} < 0) end"


OUTCOME_SQL: dict[str, str] = {
    "open_outcomes": f"""{_OPEN}
select symbol, bar_i, case when (u is not null and (d is null or u < d)) or d is not null or n >= 24 then 'closed' else 'open' end as status,
  case when u is not null and (d is null or u < d) then 'tp' when u = d then 'sl_ambiguous' when d is not null then 'sl' when n >= 24 then 'timeout' else '' end as outcome,
  (case when u is not null and (d is null or u < d) then 1 when d is not null or n >= 24 then 0 else -1 end)::int as label,
  (case when u is not null and (d is null or u < d) then u + 1 when d is not null then d + 1 when n >= 24 then 24 else 0 end)::int as exit_offset,
  round(case when u is not null and (d is null or u < d) then 5 * atr / e when d is not null then -2 * atr / e when n >= 24 then last_close / e - 1 end, 6) as realized_ret,
  n = 0 as pending, round(case when n = 0 then signal_close else e end, 6) as entry_shown, (case when n > 0 then (low0 < open0)::int end)::int as maker_filled
from seen""",
    "open_scaled_outcomes": f"""{_OPEN},
ridden as (
  select w.*, s.h, greatest(greatest(w.e + 2.5 * w.atr, coalesce(max(w.high) over (partition by w.symbol, w.bar_i order by w.j rows between unbounded preceding and 1 preceding), 0)) - 3 * w.atr, w.e - 2 * w.atr) as level
  from walked w join seen s using (symbol, bar_i) where s.h is not null and (s.d is null or s.h < s.d) and w.j > s.h),
sold as (select symbol, bar_i, min(j) as k, arg_min(least(level, open), j) as price from ridden where low <= level group by symbol, bar_i),
judged as (
  select s.*, k, price, case when d is not null and (h is null or d <= h) then 'sl' when h is not null and k is not null then 'scaled' when n >= 24 and h is null then 'timeout' when n >= 24 then 'scaled_timeout' else '' end as outcome
  from seen s left join sold using (symbol, bar_i)),
paid as (
  select *, case outcome when 'sl' then least(e - 2 * atr, d_open) / e - 1 when 'scaled' then 0.5 * 2.5 * atr / e + 0.5 * (price / e - 1) when 'timeout' then last_close / e - 1 when 'scaled_timeout' then 0.5 * 2.5 * atr / e + 0.5 * (last_close / e - 1) end as ret from judged)
select symbol, bar_i, case when outcome = '' then 'open' else 'closed' end as status, outcome, (case outcome when '' then -1 when 'sl' then 0 else (ret > 0)::int end)::int as label,
  (case outcome when '' then 0 when 'sl' then d + 1 when 'scaled' then k + 1 else 24 end)::int as exit_offset, round(ret, 6) as realized_ret from paid""",
    "forward_decision": f"""{_LOG}
select count(*) as total_rows, count(*) filter (done) as closed_rows, count(*) filter (status is distinct from 'closed') as open_rows, count(*) filter (ok) as n_trades, greatest(100 - count(*) filter (ok), 0) as decision_remaining,
  round(least(count(*) filter (ok) / 100, 1.0), 4) as progress, count(*) filter (done and coalesce(maker_filled, false) and not ok) as hindsight_excluded,
  round(case when sum({_NET}) filter (ok and {_NET} < 0) < 0 then coalesce(sum({_NET}) filter (ok and {_NET} > 0), 0) / -sum({_NET}) filter (ok and {_NET} < 0) end, 3) as profit_factor,
  round(avg(({_NET} > 0)::int) filter (ok), 4) as win_rate, round(avg({_NET}) filter (ok), 5) as mean_net, round(sum({_NET}) filter (ok) / 10, 4) as net_on_capital, coalesce(round(sum({_NET}) filter (ok), 5), 0) as net_total
from judged""",
    "forward_outcomes": f"{_LOG} select coalesce(nullif(outcome, ''), 'open') as outcome, count(*) as n, round(sum({_NET} * 100), 4) as net_percent from judged where ok group by 1",
    "tracked_signals": f"""{_LOG},
found as (select distinct symbol, signal_time from logged where detected_at >= timestamp '2024-01-15'),
still as (select distinct symbol, signal_time from logged where status = 'open')
select coalesce(f.symbol, s.symbol) as symbol, coalesce(f.signal_time, s.signal_time) as signal_time, s.symbol is not null as tracked from found f full join still s on f.symbol = s.symbol and f.signal_time = s.signal_time""",
    "trade_excursions": f"{_EXCURSIONS} select symbol, bar_i, {', '.join(f'round({c}, 6) as {c}' for c in ('ret4', 'ret8', 'ret12', 'ret24', 'ret48', 'mfe', 'mae'))}, {', '.join(f'''round(net_tp{a}_sl{s}, 6) as net_tp{a}_sl{s}''' for a, s in _TIGHT)} from netted",
    "excursion_metrics": f"""{_EXCURSIONS}
select symbol, count(mfe) as n, {', '.join(f'round(avg(ret{n}) * 1e4, 1) as ret{n}_bps' for n in (4, 8, 12, 24, 48))}, round(avg(mfe), 4) as mfe_mean, round(avg(mae), 4) as mae_mean,
  {', '.join(f'''round(avg((x > 0)::int), 3) as net_tp{a}_sl{s}_win, round({_pf('x')}, 3) as net_tp{a}_sl{s}_pf, round(avg(x) * 1e4, 1) as net_tp{a}_sl{s}_bps'''.replace('x >', f'net_tp{a}_sl{s} >').replace('(x)', f'(net_tp{a}_sl{s})').replace('(x <', f'(net_tp{a}_sl{s} <') for a, s in _TIGHT)}
from netted group by symbol""",
    "weighted_trades": f"""{_POOL},
inside as (select *, 1 + (bar_i % 3) * 0.5::double as w from trades where entry_time >= timestamp '2024-01-05' and entry_time < timestamp '2024-01-25'),
run as (select *, w * (realized_ret - 0.001) as net, 10 + sum(w * (realized_ret - 0.001)) over (order by exit_time, symbol, bar_i rows unbounded preceding) as equity from inside),
peaks as (select *, greatest(10, max(equity) over (order by exit_time, symbol, bar_i rows unbounded preceding)) as peak from run)
select count(*) as n_trades, round(sum(net), 4) as net_total, round(sum(net) / 10, 4) as net_on_capital, round(avg(net), 5) as mean_net, round(avg((net > 0)::int), 4) as win_rate,
  round(coalesce({_pf('net')}, 'infinity'::double), 3) as profit_factor, round(max((peak - equity) / peak), 4) as max_drawdown, round(sum(w), 2) as turnover, round(sum(w) / 20, 3) as turnover_per_day, round(avg(w), 3) as mean_weight,
  round(round(sum(w * (epoch(least(exit_time, timestamp '2024-01-25')) - epoch(entry_time))) / (20 * 86400), 6) / 10, 4) as utilisation
from peaks having count(*) > 0""",
}
