"""DuckDB SQL for exits, greedy choices, replays and the factor screen."""

from __future__ import annotations

from .oracles import _BASE, _C10, _FACTOR_SQL, _FACTORS, _POOL, SIGNALS

# Every bar of every signal's path, with what came before it.
_WALKED = f"""{_BASE}, {SIGNALS},
walked as (
  select s.symbol, s.bar_i, s.atr14 as atr, s.atr_pct, f.open as e, b.bar_i - s.bar_i - 1 as j, b.open, b.high, b.low, b.close, b.ema21, (b.cluster_max + b.cluster_min) / 2 as middle, b.fast_spread,
    greatest(f.open, coalesce(max(b.high) over before, f.open)) - 3 * s.atr14 as trail, f.open - greatest(2 - 0.25 * floor((b.bar_i - s.bar_i - 1) / 12), 0) * s.atr14 as decayed
  from signals s join enriched f on f.symbol = s.symbol and f.bar_i = s.bar_i + 1 join enriched b on b.symbol = s.symbol and b.bar_i between s.bar_i + 1 and s.bar_i + 24
  window before as (partition by s.symbol, s.bar_i order by b.bar_i rows between unbounded preceding and 1 preceding)),
ends as (select symbol, bar_i, any_value(e) as e, any_value(atr) as atr, any_value(atr_pct) as atr_pct, arg_max(close, j) as last_close from walked group by symbol, bar_i)"""


def _touch(name: str, target: str, stop: str) -> str:
    """Target or stop, whichever comes first."""
    return f"""
{name}_hit as (
  select w.symbol, w.bar_i, any_value({target}) as t, any_value({stop}) as s, min(j) filter (w.high >= w.e + {target} * w.atr) as u, min(j) filter (w.low <= w.e - {stop} * w.atr) as d from walked w group by w.symbol, w.bar_i),
{name}_out as (
  select symbol, bar_i, '{name}' as exit, (u is not null and (d is null or u < d))::int as label,
    case when u is not null and (d is null or u < d) then 'tp' when d is null then 'timeout' when u = d then 'sl_ambiguous' else 'sl' end as outcome, coalesce(least(u, d) + 1, 24) as exit_offset,
    case when u is not null and (d is null or u < d) then (e + t * atr) / e - 1 when d is not null then (e - s * atr) / e - 1 else last_close / e - 1 end as ret
  from {name}_hit join ends using (symbol, bar_i))"""


def _leave(name: str, outcome: str, when: str, price: str) -> str:
    """The first bar of which a condition holds, at a price of that bar; else the last close."""
    return f"""
{name}_hit as (select symbol, bar_i, min(j) as k, arg_min({price}, j) as price from walked where {when} group by symbol, bar_i),
{name}_out as (
  select symbol, bar_i, '{name}' as exit, (coalesce(price, last_close) / e - 1 > 0)::int as label, case when k is null then 'timeout' else '{outcome}' end as outcome, coalesce(k + 1, 24) as exit_offset,
    coalesce(price, last_close) / e - 1 as ret
  from ends left join {name}_hit using (symbol, bar_i))"""


_SCALED = """
banked as (
  select symbol, bar_i, min(j) filter (low <= e - 2 * atr) as s, arg_min(open, j) filter (low <= e - 2 * atr) as s_open, min(j) filter (high >= e + 2.5 * atr) as h from walked group by symbol, bar_i),
ridden as (
  select w.*, greatest(greatest(w.e + 2.5 * w.atr, coalesce(max(w.high) over (partition by w.symbol, w.bar_i order by w.j rows between unbounded preceding and 1 preceding), 0)) - 3 * w.atr, w.e - 2 * w.atr) as level
  from walked w join banked b using (symbol, bar_i) where b.h is not null and (b.s is null or b.h < b.s) and w.j > b.h),
sold as (select symbol, bar_i, min(j) as k, arg_min(least(level, open), j) as price from ridden where low <= level group by symbol, bar_i),
scaled_out as (
  select symbol, bar_i, 'scaled' as exit,
    case when s is not null and (h is null or s <= h) then 0 when h is not null then (0.5 * 2.5 * atr / e + 0.5 * (coalesce(price, last_close) / e - 1) > 0)::int else (last_close / e - 1 > 0)::int end as label,
    case when s is not null and (h is null or s <= h) then 'sl' when h is null then 'timeout' when k is null then 'scaled_timeout' else 'scaled' end as outcome,
    case when s is not null and (h is null or s <= h) then s + 1 when h is null then 24 else coalesce(k + 1, 24) end as exit_offset,
    case when s is not null and (h is null or s <= h) then least(e - 2 * atr, s_open) / e - 1 when h is null then last_close / e - 1 else 0.5 * ((e + 2.5 * atr) / e - 1) + 0.5 * (coalesce(price, last_close) / e - 1) end as ret
  from ends join banked using (symbol, bar_i) left join sold using (symbol, bar_i))"""

_BREAKEVEN = """
armed as (
  select symbol, bar_i, min(j) filter (high >= e + 1.5 * atr) as t, min(j) filter (low <= e - 2 * atr) as s, arg_min(open, j) filter (low <= e - 2 * atr) as s_open, min(j) filter (high >= e + 5 * atr) as w
  from walked group by symbol, bar_i),
guarded as (select w.symbol, w.bar_i, min(j) as k, arg_min(w.open, j) as k_open from walked w join armed a using (symbol, bar_i) where w.j > a.t and w.low <= w.e group by w.symbol, w.bar_i),
judged as (
  select *, case when s is not null and (t is null or s <= t) then 'sl' when t is null then 'timeout' when w = t then 'tp' when k is not null and (w is null or k <= w) then 'be' when w is not null then 'tp' else 'timeout' end as outcome
  from ends join armed using (symbol, bar_i) left join guarded using (symbol, bar_i)),
breakeven_out as (
  select symbol, bar_i, 'breakeven' as exit, (outcome = 'tp' or outcome = 'timeout' and last_close > e)::int as label, outcome,
    case outcome when 'sl' then s + 1 when 'tp' then w + 1 when 'be' then k + 1 else 24 end as exit_offset,
    case outcome when 'sl' then least(e - 2 * atr, s_open) / e - 1 when 'tp' then (e + 5 * atr) / e - 1 when 'be' then least(e, k_open) / e - 1 else last_close / e - 1 end as ret
  from judged)"""

_DECAY = """
decay_hit as (
  select symbol, bar_i, min(j) filter (low <= decayed) as d, arg_min(least(decayed, open), j) filter (low <= decayed) as price, min(j) filter (high >= e + 5 * atr) as u from walked group by symbol, bar_i),
time_decay_out as (
  select symbol, bar_i, 'time_decay' as exit,
    case when d is not null and (u is null or d <= u) then (price > e)::int when u is not null then 1 else (last_close > e)::int end as label,
    case when d is not null and (u is null or d <= u) then 'sl_decay' when u is not null then 'tp' else 'timeout' end as outcome, coalesce(least(d, u) + 1, 24) as exit_offset,
    case when d is not null and (u is null or d <= u) then price / e - 1 when u is not null then (e + 5 * atr) / e - 1 else last_close / e - 1 end as ret
  from decay_hit join ends using (symbol, bar_i))"""

_T, _S = "case when w.atr_pct <= 0.004 then 3.0 when w.atr_pct > 0.008 then 6.0 else 5.0 end", "case when w.atr_pct <= 0.004 then 1.5 when w.atr_pct > 0.008 then 2.5 else 2.0 end"
_PARTS = [
    _touch("triple", "5.0", "2.0"), _touch("vol_adaptive", f"({_T})", f"({_S})"), _leave("trailing", "trail", "low <= trail", "least(trail, open)"), _SCALED, _BREAKEVEN, _DECAY,
    _leave("ma_exit", "ma_exit", "close < ema21", "close"), _leave("structure", "structure", "close < middle or fast_spread <= 0.0028", "close"), _leave("time_stop", "time_stop", "j = 11", "close"),
    _leave("stop_only", "sl", "low <= e - 2 * atr", "least(e - 2 * atr, open)"),
]
_NAMES = ("triple", "trailing", "scaled", "breakeven", "ma_exit", "structure", "time_stop", "stop_only", "time_decay", "vol_adaptive")
_EXITS = f"{_WALKED}, {', '.join(_PARTS)}, all_exits as ({' union all '.join(f'select * from {n}_out' for n in _NAMES)})"

_LONG = {"pullback": "drawdown24", "ext": "ext_up", "order": "order_score"}
_SHORT = {"pullback": "runup24", "ext": "ext_down", "order": "down_order_score"}
_STRICT = dict(fast=0.0028, full=0.0055, gap=0.0035, ratio=1.45, r48=0.032, r168=0.075, pull=0.007, low=-0.0015, high=0.0075, order=3, slope=0.0009, zero=0.02, volume=0.7)
_EXPANDED = dict(fast=0.0045, full=0.0088, gap=0.0056, ratio=1.80, r48=0.048, r168=0.110, pull=0.012, low=-0.0030, high=0.0120, order=3, slope=0.0015, zero=0.02, volume=0.5)
_WIDE = {k: v * 12 for k, v in _EXPANDED.items()} | dict(low=-0.05, high=0.05, order=2, volume=0.5)


def _mask(g: dict, side: dict) -> str:
    return f"""coalesce(fast_spread <= {g['fast']} and full_spread <= {g['full']} and fast_slow_gap <= {g['gap']} and full_ratio_min48 <= {g['ratio']} and pre_range48 <= {g['r48']} and pre_range168 <= {g['r168']}
    and {side['pullback']} <= {g['pull']} and {side['ext']} between {g['low']} and {g['high']} and {side['order']} >= {g['order']} and slow_slope_abs <= {g['slope']} and zero_volume96 <= {g['zero']} and volume_ratio >= {g['volume']}, false)"""


_VP_CORR = f"case when count(*) {_C10} = 10 then covar_samp(close, volume) {_C10} / nullif(stddev_samp(close) {_C10} * stddev_samp(volume) {_C10}, 0) end"
_ALL_FACTORS = {**_FACTOR_SQL, "vp_corr": _VP_CORR}
_RANKED = """
ranked as (
  select {keys}, rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0 as rx, rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0 as ry from stacked)"""
_IC = "covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0)"

EXIT_SQL: dict[str, str] = {
    "exit_variants": f"{_EXITS} select symbol, bar_i, exit, label, outcome, exit_offset::int as exit_offset, round(e, 6) as entry_price, round(ret, 6) as realized_ret from all_exits join (select symbol, bar_i, e from ends) using (symbol, bar_i)",
    "exit_metrics": f"""{_EXITS}
select exit, count(*) as n, round(avg(label), 6) as positive, round(avg(ret - 0.0006), 6) as mean_net,
  round(case when sum(ret - 0.0006) filter (ret < 0.0006) < 0 then coalesce(sum(ret - 0.0006) filter (ret > 0.0006), 0) / -sum(ret - 0.0006) filter (ret < 0.0006) end, 6) as profit_factor
from all_exits group by exit""",
    "candidate_gates": f"{_BASE} select symbol, bar_i, {_mask(_STRICT, _LONG)} as strict_long, {_mask(_STRICT, _SHORT)} as strict_short, {_mask(_EXPANDED, _LONG)} as expanded_long, {_mask(_EXPANDED, _SHORT)} as expanded_short from enriched",
    "strict_candidates": f"""{_BASE},
last_bar as (select symbol, max(bar_i) as last_i from bars group by symbol),
open_gates as (select symbol, bar_i, round(shape_score, 6) as shape_score from enriched join last_bar using (symbol) where bar_i >= 168 and bar_i + 25 <= last_i and {_mask(_WIDE, _LONG)}),
placed as (select *, row_number() over (partition by symbol order by shape_score desc nulls last, bar_i) as k from open_gates),
chosen as (
  select distinct symbol, 0::bigint as k, []::bigint[] as kept from placed
  union all
  select c.symbol, p.k, case when len(list_filter(c.kept, lambda x: abs(x - p.bar_i) < 18)) = 0 then list_append(c.kept, p.bar_i) else c.kept end from chosen c join placed p on p.symbol = c.symbol and p.k = c.k + 1),
whole as (select symbol, arg_max(kept, k) as kept from chosen group by symbol)
select p.symbol, p.bar_i, p.shape_score from placed p join whole w on w.symbol = p.symbol and list_contains(w.kept, p.bar_i)""",
    "portfolio_replay": f"""{_POOL.replace('with recursive', 'with recursive', 1)},
scored as (select t.symbol, t.bar_i, t.entry_time, t.exit_time, t.realized_ret, row_number() over (order by t.entry_time, round(s.atr_pct, 9) desc, t.symbol) as k from trades t join signals s using (symbol, bar_i) where s.atr_pct >= 0),
book as (
  select 0::bigint as k, false as taken, []::struct(symbol varchar, until timestamp)[] as held
  union all
  select r.k, len(o) < 3 and len(list_filter(o, lambda x: x.symbol = r.symbol)) = 0,
    case when len(o) < 3 and len(list_filter(o, lambda x: x.symbol = r.symbol)) = 0 then list_append(o, {{'symbol': r.symbol, 'until': r.exit_time}}) else o end
  from (select s.*, list_filter(b.held, lambda x: x.until > s.entry_time) as o from book b join scored s on s.k = b.k + 1) r)
select s.symbol, s.bar_i, s.entry_time, s.exit_time, round(s.realized_ret, 6) as realized_ret from scored s join book b using (k) where b.taken""",
    "factor_screen": f"""{_FACTORS.format(columns='x').rsplit('select symbol, bar_i, x', 1)[0]},
factored as (select strftime(open_time, '%Y-%m') as month, lead(close, 4) over (partition by symbol order by bar_i) / close - 1 as y, {', '.join(f'round(({e})::double, 9) as {n}' for n, e in _ALL_FACTORS.items())} from helped),
stacked as (select * from (unpivot factored on {', '.join(_ALL_FACTORS)} into name factor value x) where y is not null and not isnan(x)),
{_RANKED.format(keys='factor')},
whole as (select factor, count(*) as n, {_IC} as ic from ranked group by factor),
{_RANKED.format(keys='factor, month').replace('ranked as', 'by_month as')},
monthly as (select factor, month, {_IC} as m, count(*) as k from by_month group by factor, month having count(*) >= 30),
months as (select factor, avg(m) as mean_ic, stddev_pop(m) as std_ic, count(*) as n_months, avg((m > 0)::int) as up from monthly where m is not null group by factor)
select factor, n, round(ic, 6) as ic, round(mean_ic, 6) as mean_ic, round(mean_ic / nullif(std_ic, 0), 6) as ir, coalesce(n_months, 0) as n_months, round(greatest(up, 1 - up), 6) as stability,
  case when coalesce(greatest(up, 1 - up) < 0.7, true) then 'dead' when mean_ic > 0 then 'alive' else 'reversed' end as verdict
from whole left join months using (factor)""",
}
