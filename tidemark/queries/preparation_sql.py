"""DuckDB statements equivalent to the queries of preparation.py."""

from __future__ import annotations

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
_NUMBER = "-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?"
_LINES = f"""
with a as (select raw_id, case when suffix(line_text, chr(13)) then left(line_text, -1) else line_text end l from raw_lines),
b as (select raw_id, l, regexp_full_match(l, '(?s){_FIELD}(?:,{_FIELD})*') quoted,
  list_transform(regexp_extract_all(',' || l, '(?s),({_FIELD})', 1), lambda x:
    case when left(x, 1) = '"' then replace(x[2:-2], '""', '"') else x end) f from a),
c as (select raw_id, f, case when l is null then 'column_count' when not quoted then 'quoting' when len(f) <> 6 then 'column_count'
  when not regexp_full_match(f[1], '{_DATE}') or try_cast(f[1] as timestamp) is null or f[1][18:19] >= '60' or f[1][12:13] >= '24' then 'date_time'
  when not (regexp_full_match(f[2], '{_NUMBER}') and regexp_full_match(f[3], '{_NUMBER}') and regexp_full_match(f[4], '{_NUMBER}') and regexp_full_match(f[5], '{_NUMBER}')) then 'price'
  when not regexp_full_match(f[6], '[0-9]+') or try_cast(f[6] as bigint) is null then 'volume' end reason from b)
"""

_DAILY = """
with last as (select symbol, candle_start_epoch_millis s, arg_max(struct_pack(v := volume, c := close), candle_id) p from stock_candles
  where symbol is not null and candle_start_epoch_millis is not null group by all),
daily as (select symbol, cast(floor(s / 86400000) as int) d, sum(coalesce(p.v, 0)) v, sum(p.c) c, count(p.c) n from last group by all),
days as (select symbol, cast(unnest(generate_series(min(d), max(d))) as int) d from daily group by symbol),
t as (select days.symbol, days.d,
  coalesce(sum(daily.v) filter (where daily.d > days.d - 7), 0) volume_7, coalesce(sum(daily.v), 0) volume_30,
  cast(coalesce(sum(daily.n) filter (where daily.d > days.d - 7), 0) as bigint) close_n_7, cast(coalesce(sum(daily.n), 0) as bigint) close_n_30,
  sum(daily.c) filter (where daily.d > days.d - 7) / nullif(sum(daily.n) filter (where daily.d > days.d - 7), 0) close_avg_7,
  sum(daily.c) / nullif(sum(daily.n), 0) close_avg_30
  from days left join daily on daily.symbol = days.symbol and daily.d between days.d - 29 and days.d group by all)
"""

_SECONDS = (
    "case "
    + " ".join(
        f"when timestamp_seconds between {631152000 * u} and {1893456000 * u - 1} then timestamp_seconds // {u}" for u in (1, 10**3, 10**6, 10**9)
    )
    + " end"
)
_SLOTS = f"""
with b as (select symbol, resolution, {_SECONDS} s from finnhub_bar where symbol is not null and resolution > 0),
h as (select distinct symbol, resolution, s - s % (resolution * 60) slot from b where s is not null),
r as (select symbol, resolution, slot // 86400 d, min(slot) a, max(slot) z from h group by all),
g as (select symbol, resolution, unnest(generate_series(a, z, resolution * 60)) slot from r)
"""

_CODE = "upper(trim({}))"

# readings, one per instant; level and run; measure
_READINGS = """one as (select f, s, t, arg_min(x, rec) x from r where s is not null and t is not null and x is not null group by all),
lv as (select *, median(x) over (partition by f, s order by t rows between 10 preceding and 10 following) l,
  row_number() over (partition by f, s order by t) - row_number() over (partition by f, s, x order by t) g from one),
m as (select f, s, t, x, t // 3600000 % 24 h, count(*) over (partition by f, s, x, g) run,
  case when f = 'volume' then x when l = 0 then case when x = 0 then 0 else 'inf'::double end else abs(x - l) / abs(l) end m from lv)"""

_SHIFT_MS = "(epoch_ms(l {0} interval 1 day) - epoch_ms(timezone(zone, l {0} interval 1 day)))"
_PLAIN_FORMS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%Y%m%d %H%M%S', '%Y%m%dT%H%M%S', '%d %b %Y %H:%M', '%d %b %Y %H:%M:%S', '%b %d, %Y %I:%M:%S %p']"
_SLASH = "['%{0}/%Y %H:%M:%S', '%{0}/%Y %I:%M:%S %p', '%{0}/%Y %H:%M']"
# text, place and zone of stamps: body, fraction and zone suffix apart; local time; both offsets that may hold, of which one must give it back
_STAMPS = f"""
t as (select 'first_rate_input' src, input_id rec_id, date_time x, exch_code, null z from first_rate_input
  union all select 'hk_stocks', hk_id, bar_start_utc, 'QHK', 'UTC' from hk_stocks where bar_start_utc is null or not regexp_full_match(bar_start_utc, '{_DATE} UTC')),
u as (select src, rec_id, upper(trim(regexp_replace(x, '\\s+', ' ', 'g'))) x, coalesce(t.z, e.zone) zone, day_first from t left join exchanges e using (exch_code)),
v as (select *, regexp_extract(x, '(Z| ?[+-][0-9]{{2}}:?[0-9]{{2}}| [A-Z]{{3,4}})$', 1) w from u where x is not null and not regexp_full_match(x, '[0-9]+(\\.[0-9]+)?') and x like '%:%' or regexp_matches(x, '[0-9]{{8}}[T ][0-9]{{6}}')),
b as (select *, trim(left(x, length(x) - length(w))) y from v),
f as (select *, regexp_extract(y, ':[0-9]{{2}}\\.([0-9]+)$', 1) fr from b),
g as (select *, case when fr <> '' then left(y, length(y) - length(fr) - 1) else y end body, trim(w) zw from f),
lo as (select *, case when body like '%/%' then case when regexp_matches(body, '/[0-9]{{2}} ') and not regexp_matches(body, '/[0-9]{{4}} ')
      then case when day_first then try_strptime(body, '%d/%m/%y %H:%M') else try_strptime(body, '%m/%d/%y %H:%M') end
    when day_first then try_strptime(body, {_SLASH.format('d/%m')}) else try_strptime(body, {_SLASH.format('m/%d')}) end
  else try_strptime(body, {_PLAIN_FORMS}) end l from g),
ab as (select upper(std_abbr) a, least(w1, s1) o from (select *, epoch_ms(timestamp '2020-01-01') - epoch_ms(timezone(zone, timestamp '2020-01-01')) w1,
    epoch_ms(timestamp '2020-07-01') - epoch_ms(timezone(zone, timestamp '2020-07-01')) s1 from exchanges) where std_abbr is not null
  union select upper(dst_abbr), greatest(w1, s1) from (select *, epoch_ms(timestamp '2020-01-01') - epoch_ms(timezone(zone, timestamp '2020-01-01')) w1,
    epoch_ms(timestamp '2020-07-01') - epoch_ms(timezone(zone, timestamp '2020-07-01')) s1 from exchanges) where dst_abbr is not null
  union select unnest(['Z', 'UTC', 'GMT']), 0),
o as (select lo.*, case when zw = '' then null when regexp_matches(zw, '^[+-]') then (case when zw[1] = '-' then -1 else 1 end) * (cast(zw[2:3] as bigint) * 60 + cast(right(zw, 2) as bigint)) * 60000
  else ab.o end off from lo left join ab on zw = ab.a),
p as (select *, epoch_ms(l) ms, {_SHIFT_MS.format('-')} o1, {_SHIFT_MS.format('+')} o2 from o where l is not null),
q as (select src, rec_id, coalesce(cast(left(fr || '000', 3) as bigint), 0) cut, case when zw <> '' then ms - off else least(
  case when timezone(zone, make_timestamptz((ms - o1) * 1000)) = l then ms - o1 end, case when timezone(zone, make_timestamptz((ms - o2) * 1000)) = l then ms - o2 end) end utc from p),
n as (select src, rec_id, case when regexp_full_match(x, '[0-9]{{13}}') then cast(x as bigint) else cast(split_part(x, '.', 1) as bigint) * 1000
  + coalesce(try_cast(left(split_part(x, '.', 2) || '000', 3) as bigint), 0) end utc from u where regexp_full_match(x, '[0-9]{{13}}|[0-9]{{9,10}}(\\.[0-9]+)?'))"""

SQL = {
    "p1_found": f"{_LINES} select raw_id, reason from c where reason is not null",
    "p1_records": f"""{_LINES} select raw_id, epoch_ms(cast(f[1] as timestamp)) ts_ms, cast(f[2] as double) "open", cast(f[3] as double) high,
  cast(f[4] as double) low, cast(f[5] as double) "close", cast(f[6] as bigint) volume from c where reason is null""",
    "p2_found": f"""
with b as (select bar_id, symbol || '|' || resolution s, {_SECONDS} * 1000 t, "close" x from finnhub_bar),
r as (select 'price_micro_dollars' f, symbol s, timestamp_ms t, tick_id rec, cast(price_micro_dollars as double) x from stock_ticks
  union all select 'volume', symbol, timestamp_ms, tick_id, cast(volume as double) from stock_ticks union all select 'close', s, t, bar_id, x from b),
{_READINGS}, q as (select f, s, median(m) q from m group by all)
select case when f = 'close' then 'finnhub_bar' else 'stock_ticks' end src, rec rec_id, f field from m join q using (f, s) join r using (f, s, t)
where r.x is not null and (m.x < 0 or (f <> 'volume' and m.x = 0) or run >= 12 or m > q * case when f = 'volume' then 20 else 15 end)""",
    "p2_hourly": f"""
with r as (select 'price' f, symbol s, timestamp_ms t, tick_id rec, cast(price_micro_dollars as double) x from stock_ticks),
{_READINGS}, o as (select s, h, m, row_number() over (partition by s, h order by m) - 1 i, count(*) over (partition by s, h) n from m),
q as (select s, h, (max(case when i = floor((n - 1) * 0.25) then m end) + max(case when i = ceil((n - 1) * 0.25) then m end)) / 2 a,
  (max(case when i = floor((n - 1) * 0.75) then m end) + max(case when i = ceil((n - 1) * 0.75) then m end)) / 2 b from o group by all)
select rec tick_id from m join q using (s, h) join r using (f, s, t) where r.x is not null and (m.x <= 0 or run >= 12 or m > b + (b - a) * 8)""",
    "p3_found": f"{_SLOTS} select symbol, resolution, slot slot_seconds from g anti join h using (symbol, resolution, slot)",
    "p3_states": f"""
with b as (select symbol, resolution, {_SECONDS} s, "close" c, bar_id from finnhub_bar where symbol is not null and resolution > 0),
h as (select symbol, resolution, s - s % (resolution * 60) slot, arg_max(c, case when c is not null then struct_pack(s := s, i := bar_id) end) c from b where s is not null group by all),
r as (select symbol, resolution, slot // 86400 d, min(slot) a, max(slot) z, count(*) filter (where c > 0 and isfinite(c)) n from h group by all),
k as (select h.resolution, slot, count(*) n from h join r on h.symbol = r.symbol and h.resolution = r.resolution and slot // 86400 = d where c > 0 and isfinite(c) and r.n >= 2 group by all),
g as (select symbol, resolution, n, unnest(generate_series(a, z, resolution * 60)) slot from r)
select g.symbol, g.resolution, g.slot slot_seconds, h.c "value",
  case when h.slot is not null then 'observed' when g.n >= 2 and k.n >= 2 then 'filled' else 'unsupported' end state
from g left join h on g.symbol = h.symbol and g.resolution = h.resolution and g.slot = h.slot left join k on k.resolution = g.resolution and k.slot = g.slot""",
    "p4_found": f"""{_DAILY} select symbol, strftime(date '1970-01-01' + d, '%Y-%m-%d') "day" from t
  where volume_7 / 7 > 2 * volume_30 / 30 and close_avg_7 < 0.995 * close_avg_30""",
    "p5_found": f"""with {_STAMPS}
select src, rec_id, utc + cut utc_ms from q where utc is not null union all select src, rec_id, utc from n
union all select 'finnhub_bar', bar_id, case {" ".join(f"when timestamp_seconds between {631152000 * u} and {1893456000 * u - 1} then timestamp_seconds // {u // 1000}" for u in (10**3, 10**6, 10**9))} end
from finnhub_bar where {" or ".join(f"timestamp_seconds between {631152000 * u} and {1893456000 * u - 1}" for u in (10**3, 10**6, 10**9))}""",
    "p7_found": f"""
with r as (select {_CODE.format("base_currency")} k, timestamp_epoch_millis v, received_epoch_millis w, rate_id,
  greatest(timestamp_epoch_millis, received_epoch_millis) s from exchange_rates
  where base_currency is not null and one_quote_in_base is not null and timestamp_epoch_millis is not null and received_epoch_millis is not null),
best as (select k, s, max(struct_pack(v := v, w := w, i := rate_id)) over (partition by k order by s range unbounded preceding) b from r),
one as (select k, s, any_value(b) b from best group by all)
select candle_id, one.b.i rate_id from stock_candles asof join one on {_CODE.format("currency")} = one.k and candle_end_epoch_millis >= one.s""",
}
