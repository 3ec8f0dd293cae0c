"""DuckDB statements equivalent to the queries of market.py."""

from __future__ import annotations

from tidemark.functions.duration import parse_duration
from tidemark.functions.monoids import DECAYS
from tidemark.queries.engine_sql import _E, _r
from tidemark.queries.preparation_sql import _SECONDS

_SHIFT = 1.234e-8
_THREE = 3 * 86_400_000


def _two(agg: str, key: str, order: str, w: int) -> tuple[str, str]:
    return f"{agg} over (partition by {key} order by t range between {w} preceding and 1 preceding)", f"{agg} over (partition by {key}, t order by {order} rows unbounded preceding)"


def _tick(agg: str) -> tuple[str, str]:
    return _two(agg, "symbol", "tick_id", 300_000)


_EDGE = "(partition by symbol order by t, tick_id)"
_STATS = ", ".join(
    [
        _r("avg(a)", "trade_mean"), _r("stddev_pop(a)", "trade_std"), _r("max(a)", "trade_max"), _r("avg(p)", "profit_mean"), _r("stddev_pop(p)", "profit_std"),
        _r("min(p)", "profit_min"), _r("avg(p) / avg(a)", "mean_return"), _r("(avg(p) - 2 * stddev_pop(p)) / avg(a)", "two_sigma_return"),
    ]
)

_TICK_CANDLES = f"""e as (select *, timestamp_ms t, price_micro_dollars p from stock_ticks where price_micro_dollars is not null and volume is not null and symbol is not null),
c as (select symbol, tick_id, t, lag(t) over {_EDGE} was, p "close", coalesce({_tick('sum(volume)')[0]}, 0) + coalesce({_tick('sum(volume)')[1]}, 0) total,
  coalesce({_tick('sum(p::double * volume)')[0]}, 0) + coalesce({_tick('sum(p::double * volume)')[1]}, 0) paid from e),
k as (select * from c where was is null or was // 300000 <> t // 300000)"""
_LENGTHS = {x: parse_duration(x).ms for x in DECAYS}
_PIVOT = ", ".join(
    [_r(f"max(case when l = {ms} then {n}m end)", f"{n}_{x}_mean") for n in ("lin", "log") for x, ms in _LENGTHS.items()]
    + [_r(f"max(case when l = {ms} then case when sqrt({n}v) < 1e-3 * abs({n}m) then 0 else ({n}x - {n}m) / sqrt({n}v) end end)", f"{n}_z_{x}") for n in ("lin", "log") for x, ms in _LENGTHS.items()]
)
_NAMES = ", ".join(f"{n}_{x}_mean, {n}_z_{x}" for n in ("lin", "log") for x in DECAYS)


def _ten(x: str) -> str:
    a, b = _two(f"sum({x})", "symbol", "candle_id", 600_000)
    return f"coalesce({a}, 0) + coalesce({b}, 0)"


SQL = {
    "ticks_targets": f"""with {_TICK_CANDLES},
w as (select *, {_two('sum(total)', 'symbol', 'tick_id', 600_000)[0]} t0, {_two('sum(total)', 'symbol', 'tick_id', 600_000)[1]} t1,
  {_two('count(*)', 'symbol', 'tick_id', 600_000)[0]} + {_two('count(*)', 'symbol', 'tick_id', 600_000)[1]} candles_10 from k),
l as (select symbol, t, arg_max(struct_pack(c := "close", v := total), tick_id) x from k group by all),
f as (select w.*, l.x.c c15, l.x.v v15 from w asof join l on w.symbol = l.symbol and w.t + 900000 >= l.t)
select tick_id, cast(length(cast("close" as varchar)) as int) digits, cast(coalesce(t0, 0) + t1 as bigint) total_10, candles_10, cast(v15 as bigint) v15, cast(l.x.v as bigint) v30,
{_r('round(paid / nullif(total, 0), 3)', 'vwap')}, c15, l.x.c c30 from f asof join l on f.symbol = l.symbol and f.t + 1800000 >= l.t""",
    "candle_targets": f"""with r as (select upper(trim(base_currency)) code, timestamp_epoch_millis t, arg_max(one_quote_in_base, rate_id) rate from exchange_rates
  where base_currency is not null and one_quote_in_base is not null group by all),
c as (select candle_id, symbol, upper(trim(currency)) code, "close", volume, candle_end_epoch_millis t from stock_candles),
e as (select c.*, ln("close" + 1e-6) lc, case when c.code = 'USD' then "close" * volume else "close" * volume / rate end usd from c asof left join r on c.code = r.code and c.t >= r.t),
le as (select unnest([{', '.join(map(str, _LENGTHS.values()))}]) l),
p as (select a.candle_id i, l, b."close" x, b.lc y, exp(-(a.t - b.t) / l::double) w from e a join e b on a.symbol = b.symbol and (b.t < a.t or b.t = a.t and b.candle_id <= a.candle_id), le where b."close" is not null),
m as (select i, l, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my from p where w > 0 group by all),
q as (select p.i, p.l, any_value(mx) linm, any_value(my) logm, sum(w * (x - mx) * (x - mx)) / sum(w) linv, sum(w * (y - my) * (y - my)) / sum(w) logv from p join m on p.i = m.i and p.l = m.l where w > 0 group by all),
z as (select e.candle_id, {_PIVOT} from (select candle_id, "close" linx, lc logx from e) e left join q on candle_id = i group by all),
w as (select *, {_ten('usd')} u, {_ten('volume')} v from e),
o as (select symbol, t, arg_max(struct_pack(u := u, v := v), candle_id) x, arg_max(struct_pack(c := "close", v := volume), candle_id) y from w group by all),
f1 as (select w.candle_id, w.symbol, w.t, w."close", o.x.u entry_usd, o.x.v entry_vol from w asof join o on w.symbol = o.symbol and w.t + 600000 >= o.t),
f2 as (select f1.*, o.y.c c15, o.y.v v15 from f1 asof join o on f1.symbol = o.symbol and f1.t + 900000 >= o.t),
f3 as (select f2.*, o.y.c c30, o.y.v v30 from f2 asof join o on f2.symbol = o.symbol and f2.t + 1800000 >= o.t),
f4 as (select f3.*, o.x.u exit15_usd, o.x.v exit15_vol from f3 asof join o on f3.symbol = o.symbol and f3.t + 1500000 >= o.t),
f5 as (select f4.*, o.x.u exit30_usd, o.x.v exit30_vol from f4 asof join o on f4.symbol = o.symbol and f4.t + 2400000 >= o.t)
select candle_id, t % 86400000 // 60000 "minute", t % 604800000 // 86400000 weekday, entry_vol, c15, v15, c30, v30, exit15_vol, exit30_vol,
round(entry_usd + 1.234e-5, 2) entry_usd, round(exit15_usd + 1.234e-5, 2) exit15_usd, round(exit30_usd + 1.234e-5, 2) exit30_usd,
{_r('c15 / nullif("close", 0) - 1', 'gain15')}, {_r('c30 / nullif("close", 0) - 1', 'gain30')}, {_NAMES} from f5 join z using (candle_id)""",
    "ticks_candles": f"""with e as (select *, timestamp_ms t, price_micro_dollars p from stock_ticks where price_micro_dollars is not null and volume is not null and symbol is not null),
c as (select symbol, tick_id, t, lag(t) over {_EDGE} was, p "close",
coalesce({_tick('arg_min(p, struct_pack(t := t, i := tick_id))')[0]}, first_value(p) over (partition by symbol, t order by tick_id)) "open",
greatest({_tick('max(p)')[0]}, {_tick('max(p)')[1]}) high, least({_tick('min(p)')[0]}, {_tick('min(p)')[1]}) low,
coalesce({_tick('sum(volume)')[0]}, 0) + coalesce({_tick('sum(volume)')[1]}, 0) total, {_tick('count(*)')[0]} + {_tick('count(*)')[1]} ticks from e)
select symbol, tick_id, t "time", "open", high, low, "close", cast(total as bigint) total, ticks from c where was is null or was // 300000 <> t // 300000""",
    "candles_usd": f"""with r as (select upper(trim(base_currency)) code, timestamp_epoch_millis t, arg_max(one_quote_in_base, rate_id) rate from exchange_rates
  where base_currency is not null and one_quote_in_base is not null group by all),
c as (select candle_id, symbol, upper(trim(currency)) code, "close", volume, candle_end_epoch_millis t from stock_candles),
e as (select c.*, r.rate, case when c.code = 'USD' then "close" * volume else "close" * volume / rate end usd from c asof left join r on c.code = r.code and c.t >= r.t),
l as (select symbol, t, arg_max("close", candle_id) next_close from e where "close" is not null group by all),
w as (select candle_id, symbol, t, rate, "close", coalesce({_two('sum(usd)', 'symbol', 'candle_id', _THREE)[0]}, 0) + coalesce({_two('sum(usd)', 'symbol', 'candle_id', _THREE)[1]}, 0) usd_3d,
{_two('count(*)', 'symbol', 'candle_id', _THREE)[0]} + {_two('count(*)', 'symbol', 'candle_id', _THREE)[1]} n_3d,
lag("close") over (partition by symbol order by t, candle_id) last_close from e)
select candle_id, rate, round(usd_3d + 1.234e-5, 2) usd_3d, n_3d, last_close, round(next_close / nullif("close", 0) - 1 + {_SHIFT}, 6) + 0.0 gain
from w asof left join l on w.symbol = l.symbol and w.t + 86400000 >= l.t""",
    "bar_history": f"""with b as (select *, {_SECONDS} * 1000 t, ln("close") lc from finnhub_bar where symbol is not null and resolution is not null and "close" > 0),
e as (select * from b where t is not null),
m as (select bar_id, symbol, resolution, t, count(lc) over w m_n, avg(lc) over w a, stddev_pop(lc) over w s, lc from e window w as (partition by symbol, resolution order by t, bar_id rows unbounded preceding)),
l as (select symbol, resolution, t, arg_max("close", bar_id) c from e group by all),
d as (select x.bar_id, sum(y.lc * exp(-(x.t - y.t) / 86400000.0)) / sum(exp(-(x.t - y.t) / 86400000.0)) v from e x join e y
  on x.symbol = y.symbol and x.resolution = y.resolution and (y.t < x.t or y.t = x.t and y.bar_id <= x.bar_id) group by x.bar_id),
f as (select m.*, l.c c15 from m asof left join l on m.symbol = l.symbol and m.resolution = l.resolution and m.t + 900000 >= l.t)
select f.bar_id, m_n, {_r('f.a', 'm_mean')}, {_r('d.v', 'd_mean')}, {_r('case when abs(lc - f.a) <= 1e-13 * abs(f.a) then 0 else (lc - f.a) / nullif(f.s, 0) end', 'z')}, c15, l.c c30 from f join d using (bar_id)
asof left join l on f.symbol = l.symbol and f.resolution = l.resolution and f.t + 1800000 >= l.t""",
    "dense_bars": r"""with s as (select *, strptime(bar_start_utc, '%Y-%m-%d %H:%M:%S UTC') ts from hk_stocks where symbol is not null and "close" is not null
  and regexp_full_match(bar_start_utc, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} UTC')),
e as (select symbol, hk_id, cast("close" as double) c, volume, epoch_ms(ts) + case when hour(ts) = 1 then 1800000 else 3600000 end b from s),
one as (select symbol, b, arg_max(struct_pack(c := c, v := volume), hk_id) x from e group by all),
grid as (select f.symbol, bars.b bar from (select symbol, min(b) a from e group by symbol) f join (select distinct b from e) bars on bars.b >= f.a)
select grid.symbol, bar, one.x.c "close", case when one.b = bar then one.x.v else 0 end volume from grid asof join one on grid.symbol = one.symbol and grid.bar >= one.b""",
    "threshold_stats": f"""{_E}, x as (select t, k / 100.0 score, value * 100 a, value - 40 p from e), th as (select unnest([0.0, 0.25, 0.5, 0.75, 0.9]) threshold)
select cast(threshold as double) threshold, min(t) min_ts, max(t) max_ts, count(*) trades, {_STATS} from x join th on x.score >= threshold group by threshold""",
    "balance_sim": f"""with recursive e as (select *, epoch_us(ts) // 1000 t, cast(json_extract_string(props, '$.k') as int) k from events),
x as (select event_type, t, value * 100 a, value - 40 p, row_number() over (partition by event_type order by t, event_id) n from e where k / 100.0 >= 0.25 and value is not null),
s as (select event_type, cast(0 as bigint) n, 25000.0::double cash, 25000.0::double high, 25000.0::double low, cast(-1 as bigint) clock,
    cast([] as struct(d bigint, b double, i bigint)[]) pend, cast(0 as bigint) entered from (select distinct event_type from x)
  union all select event_type, n, c, greatest(high, c), least(low, c), clock,
    case when enters then list_append(kept, struct_pack(d := t + 900000, b := stake + case when a = 0 then 0 else stake / a end * p, i := entered + 1)) else kept end, entered + cast(enters as bigint)
  from (select *, list_filter(pend, lambda z: z.d > clock) kept, c1 + coalesce(list_sum(list_transform(list_filter(pend, lambda z: z.d <= clock), lambda z: z.b)), 0) c
    from (select s.event_type, x.n, x.t, x.a, x.p, s.high, s.low, s.pend, s.entered, least(x.a, s.cash) stake, not least(x.a, s.cash) < 50 enters,
      s.cash - case when least(x.a, s.cash) < 50 then 0 else least(x.a, s.cash) end c1, case when least(x.a, s.cash) < 50 then s.clock else x.t end clock
      from s join x on x.event_type = s.event_type and x.n = s.n + 1))),
z as (select s.* from s join (select event_type, max(n) n from s group by all) using (event_type, n)),
u as (select event_type, unnest(pend) q from z),
c as (select u.event_type, z.cash + sum(q.b) over (partition by u.event_type order by q.d, q.b, q.i rows unbounded preceding) c from u join z using (event_type)),
m as (select event_type, max(c) hi, min(c) lo from c group by all), v as (select event_type, sum(q.b) b from u group by all)
select z.event_type, {_r('cash + coalesce(b, 0)', 'last')}, {_r('greatest(high, coalesce(hi, high))', 'high')}, {_r('least(low, coalesce(lo, low))', 'low')}, entered
from z left join m using (event_type) left join v using (event_type)""",
    "sort_inputs": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as position from orders",
    "diff_rows": """select row_number() over (order by s_suppkey) - 1 as position, 's_nationkey' "column", cast(s_nationkey as varchar) "left", '20' "right" from supplier qualify s_nationkey > 20""",
    "top_values": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
}
