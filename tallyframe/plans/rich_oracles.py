"""DuckDB SQL for the rich feature pack."""

from __future__ import annotations

from .oracles import _BASE, _lag, _r, _roll

_SPANS = (5, 10, 20, 60, 120)
_W = "over (partition by symbol order by bar_i)"
_HALF = "over (partition by symbol order by bar_i rows between 23 preceding and current row)"
_P24 = "over (partition by symbol order by bar_i rows between 23 preceding and current row)"
_more = ", ".join(f"(2.0::double / {p + 1}) * b.close + (1.0::double - 2.0::double / {p + 1}) * m.ema{p} as ema{p}" for p in _SPANS)

_STEPS = f"""{_BASE},
more as (
  select symbol, bar_i, {', '.join(f'close as ema{p}' for p in _SPANS)}, tr as atr7, tr as atr28 from ranged where bar_i = 0
  union all
  select b.symbol, b.bar_i, {_more}, (1.0::double / 7) * b.tr + (1.0::double - 1.0::double / 7) * m.atr7, (1.0::double / 28) * b.tr + (1.0::double - 1.0::double / 28) * m.atr28
  from more m join ranged b on b.symbol = m.symbol and b.bar_i = m.bar_i + 1),
one as (
  select e.*, m.* exclude (symbol, bar_i), {', '.join(f"{_roll('avg', 'close', p, max(3, p // 2))} as sma{p}" for p in _SPANS)},
    {', '.join(f"{_roll('max', 'high', n, n // 2)} as hh{n}, {_roll('min', 'low', n, n // 2)} as ll{n}" for n in (24, 48, 96))},
    close / nullif({_lag('close', 1)}, 0) - 1 as ret1, volume / nullif({_lag('volume', 1)}, 0) - 1 as dvol, abs(close - open) / nullif(high - low, 0) as body,
    {_roll('max', 'high', 24)} as hh_half, {_roll('min', 'low', 24)} as ll_half, {_roll('avg', 'volume', 20, 5)} as vol20, {_roll('avg', 'volume', 96, 20)} as vol96,
    fast_spread > {_lag('fast_spread', 1)} as widens, fast_spread < {_lag('fast_spread', 1)} as narrows, fast_spread <= 0.0028 as is_dense, fast_spread - {_lag('fast_spread', 8)} as spread_chg8
  from enriched e join more m using (symbol, bar_i)),
two as (
  select *, coalesce(sign(hh_half - {_lag('hh_half', 24)}), 0.0) as high_tag, coalesce(sign(ll_half - {_lag('ll_half', 24)}), 0.0) as low_tag,
    case when close >= {_lag('hh24', 1)} then volume / nullif(vol20, 0) end as loud,
    {', '.join(f"bar_i - coalesce(max(case when not coalesce({c}, false) then bar_i end) {_W}, -1) as {n}" for c, n in (('widens', 'up_run'), ('narrows', 'down_run'), ('is_dense', 'dense_run')))},
    case when ret1 is not null and dvol is not null then ret1 end as pr, case when ret1 is not null and dvol is not null then dvol end as pv
  from one)"""

_PI2 = "6.283185307179586"
COLUMNS: dict[str, str] = {
    **{f"close_vs_{k}{p}": f"close / nullif({k}{p}, 0) - 1" for k in ("sma", "ema") for p in _SPANS},
    **{f"gap_{k}{a}_{b}": f"({k}{a} - {k}{b}) / nullif(close, 0)" for k, a, b in (("ema", 8, 21), ("ema", 21, 55), ("ema", 55, 200), ("sma", 20, 60), ("sma", 60, 120))},
    **{f"{x}_slope{n}": f"{x} / nullif({_lag(x, n)}, 0) - 1" for x, n in (("ema8", 8), ("ema21", 12), ("ema55", 24), ("ema200", 24), ("sma60", 12))},
    **{f"cross_ema{a}_{b}": f"(ema{a} > ema{b})::int::double" for a, b in ((8, 21), (21, 55), (55, 200))},
    "ma_entangle": "1 / (1 + greatest(fast_spread, 0) * 200)",
    "ma_bandwidth": "(cluster_max - cluster_min) / nullif((cluster_max + cluster_min) / 2, 0)",
    "bb_width20": f"2 * ({_roll('stddev_samp', 'close', 20, 10)}) / nullif(sma20, 0)",
    **{f"{x}_chg{n}": f"{x} - {_lag(x, n)}" for x, n in (("fast_spread", 4), ("fast_spread", 16), ("full_spread", 8), ("full_spread", 24))},
    **{f"{x}_rank96": f"({x} - ({_roll('min', x, 96, 48)})) / nullif(({_roll('max', x, 96, 48)}) - ({_roll('min', x, 96, 48)}), 0)" for x in ("fast_spread", "full_spread")},
    "spread_expand_run": "up_run", "spread_contract_run": "down_run", "dense_run_len_fast": "dense_run",
    "exit_dense_expand": f"coalesce({_lag('dense_run', 1)} >= 5 and spread_chg8 > 0, false)::int::double",
    **{f"ret_{n}": f"close / nullif({_lag('close', n)}, 0) - 1" for n in (2, 8, 16, 64, 96)},
    **{f"roc_{n}": f"(close - {_lag('close', n)}) / nullif({_lag('close', n)}, 0)" for n in (12, 48)},
    **{f"dist_high_{n}": f"close / nullif(hh{n}, 0) - 1" for n in (24, 48, 96)}, **{f"dist_low_{n}": f"close / nullif(ll{n}, 0) - 1" for n in (24, 48, 96)},
    **{f"break_up_{n}": f"close / nullif({_lag(f'hh{n}', 1)}, 0) - 1" for n in (24, 48, 96)}, **{f"break_dn_{n}": f"close / nullif({_lag(f'll{n}', 1)}, 0) - 1" for n in (24, 48, 96)},
    **{f"range_pos_{n}": f"(close - ll{n}) / nullif(hh{n} - ll{n}, 0)" for n in (24, 48, 96)},
    "atr7_pct": "atr7 / nullif(close, 0)", "atr28_pct": "atr28 / nullif(close, 0)", "atr_ratio_7_28": "atr7 / nullif(atr28, 0)",
    "rvol_24": _roll("stddev_samp", "ret1", 24, 12), "rvol_96": _roll("stddev_samp", "ret1", 96, 48), "rvol_ratio_24_96": f"({_roll('stddev_samp', 'ret1', 24, 12)}) / nullif({_roll('stddev_samp', 'ret1', 96, 48)}, 0)",
    "body_ratio": "body", "wick_up_ratio": "greatest(high - greatest(open, close), 0) / nullif(high - low, 0)", "wick_dn_ratio": "greatest(least(open, close) - low, 0) / nullif(high - low, 0)",
    "body_ratio_mean8": _roll("avg", "body", 8, 4), "atr_chg24": f"atr_pct - {_lag('atr_pct', 24)}", "vol_ratio_20": "volume / nullif(vol20, 0)", "vol_ratio_96": "volume / nullif(vol96, 0)",
    "vol_z_24": f"(volume - ({_roll('avg', 'volume', 24, 10)})) / nullif({_roll('stddev_samp', 'volume', 24, 10)}, 0)",
    "pv_corr_24": f"case when count(pr) {_P24} >= 12 then covar_samp(pr, pv) {_P24} / nullif(stddev_samp(pr) {_P24} * stddev_samp(pv) {_P24}, 0) end",
    "breakout_vol_ratio": "coalesce(last_value(loud ignore nulls) over (partition by symbol order by bar_i rows between 3 preceding and current row), volume / nullif(vol20, 0))",
    "up_vol_share_24": f"({_roll('sum', '(volume * (close > open)::int)', 24, 12)}) / nullif({_roll('sum', 'volume', 24, 12)}, 0)",
    "struct_hh": "(high_tag > 0)::int::double", "struct_hl": "(low_tag > 0)::int::double", "struct_lh": "(high_tag < 0)::int::double", "struct_ll": "(low_tag < 0)::int::double", "struct_bias": "high_tag + low_tag",
    "dist_prior_high_96": f"close / nullif({_roll('max', 'high', 96, 48, 1)}, 0) - 1", "dist_prior_low_96": f"close / nullif({_roll('min', 'low', 96, 48, 1)}, 0) - 1",
    "hour_sin": f"sin({_PI2} * hour(open_time) / 24)", "hour_cos": f"cos({_PI2} * hour(open_time) / 24)", "dow": "(isodow(open_time) - 1)::double",
    "dow_sin": f"sin({_PI2} * (isodow(open_time) - 1) / 7)", "dow_cos": f"cos({_PI2} * (isodow(open_time) - 1) / 7)",
}

_BUNDLE = [f"{k}{p}" for k in ("sma", "ema") for p in (20, 60, 120)]


def _quality(short: bool) -> str:
    s, near, far, top, bottom, edge, less = (1, "high", "low", "max", "min", "least", "<") if short else (-1, "low", "high", "min", "max", "greatest", ">")
    some = lambda f, x, n: f"{f}({x}) over (partition by symbol order by bar_i rows between {n - 1} preceding and current row)"
    return f"""
{'short' if short else 'long'}_rows as (
  select symbol, bar_i, '{'short' if short else 'long'}' as side, {s} * ({edge}({', '.join(_BUNDLE)}) - close) / nullif(atr14, 0) as bd_depth, {s} * (open - close) / nullif(atr14, 0) as bd_force, (high - low) / nullif(atr14, 0) as bd_range,
    coalesce(volume / nullif({some('avg', 'volume', 20)}, 0), 1.0) as vol_break, {s} * coalesce((center - coalesce({_lag('center', 12)}, center)) / nullif(12 * close, 0), 0.0) as ma_roll,
    coalesce({some('avg', f'step_{near}', 19)}, 0.0) as steps20, {s} * ({some(top, near, 20)} - close) / nullif(atr14, 0) as from_extreme20, {s} * (close - {some(bottom, far, 48)}) / nullif(atr14, 0) as room48,
    {s} * (close / nullif({some(top, near, 20)}, 0) - 1) as fall20
  from bundled)"""


_QUALITY = ("bd_depth", "bd_force", "bd_range", "vol_break", "ma_roll", "steps20", "from_extreme20", "room48", "fall20")
RICH_SQL: dict[str, str] = {
    "rich_features": f"{_STEPS} select symbol, bar_i, {', '.join(_r(e, n) for n, e in COLUMNS.items())} from two",
    "break_quality": f"""{_STEPS},
bundled as (
  select *, ({' + '.join(_BUNDLE)}) / 6 as center, case when {_lag('high', 1)} is not null then (high < {_lag('high', 1)})::int end as step_high, case when {_lag('low', 1)} is not null then (low > {_lag('low', 1)})::int end as step_low
  from two where sma120 is not null),
{_quality(True)}, {_quality(False)}
select symbol, bar_i, side, {', '.join(_r(c, c) for c in _QUALITY)} from (select * from short_rows union all select * from long_rows)""",
}
