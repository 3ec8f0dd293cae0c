"""DuckDB statements equivalent to the queries of engine.py."""

from __future__ import annotations

from tidemark.functions.duration import parse_duration
from tidemark.functions.monoids import DECAYS

_E = "with e as (select *, epoch_us(ts) // 1000 t, cast(json_extract_string(props, '$.k') as int) k from events)"
_USER = "(partition by user_id order by t, event_id rows unbounded preceding)"
_USER_BEFORE = "(partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding)"
_DAY, _HOUR = 86_400_000, 3_600_000


def _r(x: str, name: str) -> str:
    return f"round(cast({x} as double) + 1.234e-8, 6) + 0.0 {name}"


def _trailing(agg: str, key: str, w: int) -> tuple[str, str]:
    """The same aggregate over earlier milliseconds of the window and over the same one so far."""
    return (
        f"{agg} over (partition by {key} order by t range between {w} preceding and 1 preceding)",
        f"{agg} over (partition by {key}, t order by event_id rows unbounded preceding)",
    )


def _sum_trailing(x: str, key: str, w: int) -> str:
    a, b = _trailing(f"sum({x})", key, w)
    return f"coalesce({a}, 0) + coalesce({b}, 0)"


def _both(agg: str, pick: str, key: str, w: int) -> str:
    a, b = _trailing(agg, key, w)
    return f"{pick}({a}, {b})"


def _decayed(key: str, h: int, strictly: bool, ahead: int = 0, weight: str = "b.value") -> str:
    before = "(b.t < a.t or b.t = a.t and b.event_id < a.event_id)" if strictly else f"(b.t < a.t + {ahead} or b.t = a.t + {ahead} and (b.event_id <= a.event_id or {ahead} > 0))"
    return f"coalesce(sum({weight} * exp(-(a.t - b.t) / {h}.0)) filter (where {before}), 0)"


_SIX = ", ".join(_r(_decayed("user_id", parse_duration(x).ms, True), f"d_{x}") for x in DECAYS)
_PURCHASES = "p as (select * from e where event_type = 'purchase')"

SQL = {
    "running_count": f"{_E} select event_type, event_id, count(*) over (partition by event_type order by t, event_id rows unbounded preceding) n from e",
    "pre_sum": f"{_E} select event_id, {_r(f'coalesce(sum(value) over {_USER_BEFORE}, 0)', 'total')} from e",
    "latest_prev": f"{_E} select event_id, lag(value) over (partition by user_id order by t, event_id) previous from e",
    "running_max_min": f"{_E} select event_id, max(value) over {_USER} high, min(value) over {_USER} low from e",
    "best_event": f"{_E} select event_id, (max(struct_pack(k := k, t := t, i := event_id)) over {_USER}).i best from e",
    "map_filter_chain": f"select event_id, {_r('value * 2 + 1', 'x')} from events where value * 2 + 1 > 50",
    "concat_map": """select p_partkey, cast(generate_subscripts(string_split(p_name, ' '), 1) - 1 as int) "at", unnest(string_split(p_name, ' ')) word from part""",
    "running_words": """with w as (select p_partkey, cast(generate_subscripts(string_split(p_name, ' '), 1) - 1 as int) pos, unnest(string_split(p_name, ' ')) word from part),
n as (select word, p_partkey, count(*) c from w group by all),
s as (select word, p_partkey, coalesce(sum(c) over (partition by word order by p_partkey rows between unbounded preceding and 1 preceding), 0) before from n)
select word, p_partkey, pos "at", cast(before as bigint) before from w join s using (word, p_partkey)""",
    "concat_events": f"""{_E}, u as (select epoch_us(o_orderdate) // 1000 ts_ms, 'orders' s, o_orderkey id, o_custkey who, o_totalprice amount from orders
union all select t, 'events', event_id, user_id, value from e)
select ts_ms, id, who, {_r('sum(amount) over w', 'total')}, count(*) over w n from u window w as (partition by who order by ts_ms, s, id rows unbounded preceding)""",
    "with_time_calendar": f"""{_E} select event_id, t % {7 * _DAY} // {_DAY} day_of_week, t % {_DAY} // {_HOUR} "hour", t % {_DAY} // 60000 "minute",
t // 300000 bucket_5m, t % 300000 rest_5m, cast(dayofweek(ts) + 1 as int) calendar_day from e""",
    "dedup_first": f"{_E} select event_id, user_id, event_type from e qualify row_number() over (partition by user_id, event_type order by t, event_id) = 1",
    "cross_source_lookup": f"""{_E}, {_PURCHASES}, u as (select o_custkey user_id, epoch_us(o_orderdate) // 1000 t, 'orders' s, o_orderkey i, null v from orders
union all select user_id, t, 'events', event_id, value from p)
select user_id, i o_orderkey, {_r('coalesce(sum(v) over w, 0)', 'spent')}, count(v) over w n, last_value(v ignore nulls) over w last_value from u
window w as (partition by user_id order by t, s, i rows unbounded preceding) qualify s = 'orders'""",
    "purchases_before_event": f"""{_E} select event_id, {_r(f"coalesce(sum(case when event_type = 'purchase' then value end) over {_USER_BEFORE}, 0)", 'spent')},
count(case when event_type = 'purchase' then 1 end) over {_USER_BEFORE} n from e""",
    "cross_key_lookup": f"""with o as (select o_orderkey, c_nationkey nation, o_totalprice v, epoch_us(o_orderdate) // 1000 t from orders left join customer on c_custkey = o_custkey)
select o_orderkey, nation, {_r('coalesce(sum(v) over w, 0)', 'total')}, count(*) over w n from o
window w as (partition by nation order by t, o_orderkey rows between unbounded preceding and 1 preceding)""",
    "changes_max": f"""{_E}, c as (select t ts_ms, user_id, max(value) over {_USER_BEFORE} was_high, max(value) over {_USER} is_high from e)
select * from c where was_high is distinct from is_high""",
    "zip_features": f"{_E} select event_id, count(*) over {_USER} n, {_r(f'sum(value) over {_USER}', 'total')}, max(value) over {_USER} high from e",
    "const_fn_feature": f"{_E} select event_id, cast(1 as int) one, user_id % 2 parity, (t // 1000) % 60 as second from e",
    "window_sum_1d": f"{_E} select event_id, {_r(_sum_trailing('value', 'user_id', _DAY), 'total')} from e",
    "window_max_1d": f"{_E} select event_id, {_both('max(value)', 'greatest', 'user_id', _DAY)} high, {_both('min(value)', 'least', 'user_id', _DAY)} low from e",
    "window_count_1h": f"""{_E} select event_id, cast({_sum_trailing('1', 'event_type', _HOUR)} as bigint) n, coalesce({_trailing('min(t)', 'event_type', _HOUR)[0]}, t) time_min,
t time_max, cast({_sum_trailing('1', 'event_type', _HOUR)} as bigint) size from e""",
    "window_read_by_others": f"""{_E}, {_PURCHASES}, w as (select event_id, {_sum_trailing('value', 'user_id', _DAY)} v, {_sum_trailing('1', 'user_id', _DAY)} c from p)
select event_id, {_r(f'coalesce(last_value(w.v ignore nulls) over {_USER}, 0)', 'spent')}, cast(coalesce(last_value(w.c ignore nulls) over {_USER}, 0) as bigint) n
from e left join w using (event_id)""",
    "label_latest_1h": f"{_E} select event_id, last_value(value) over (partition by user_id order by t range between unbounded preceding and {_HOUR} following) future from e",
    "label_sum_1d": f"{_E} select event_id, {_r(f'sum(value) over (partition by user_id order by t range between unbounded preceding and {_DAY} following)', 'total')} from e",
    "label_zip_15_30": f"""{_E} select event_id, count(*) over (partition by user_id order by t range between unbounded preceding and 900000 following) n15,
count(*) over (partition by user_id order by t range between unbounded preceding and 1800000 following) n30 from e""",
    "label_nested": f"""{_E}, c as (select event_id, count(*) over (partition by user_id order by t range between unbounded preceding and 1500000 following) n from e)
select * from c where n > 1""",
    "sum_forward_1h": f"""{_E}, w as (select event_type, t, event_id, {_sum_trailing('value', 'event_type', _HOUR)} v from e),
one as (select event_type, t, arg_max(v, event_id) v from w group by all)
select e.event_id, {_r('one.v', 'total')} from e asof join one on e.event_type = one.event_type and e.t + {_HOUR} >= one.t""",
    "moments_running": f"""{_E} select event_id, count(value) over {_USER} value_m_n, {_r(f'avg(value) over {_USER}', 'value_m_mean')},
{_r(f'stddev_pop(value) over {_USER}', 'value_m_std')} from e""",
    "zscore": f"""{_E}, m as (select event_id, value, avg(value) over {_USER} a, stddev_pop(value) over {_USER} s from e)
select event_id, {_r('case when value = a then 0 else (value - a) / nullif(s, 0) end', 'z')} from m""",
    "corr_running": f"""{_E}, m as (select event_id, covar_pop(k, value) over {_USER} c, var_pop(k) over {_USER} x, var_pop(value) over {_USER} y from e)
select event_id, {_r('c', 'c_cov')}, {_r('case when x > 0 and y > 0 then c / sqrt(x * y) end', 'c_corr')} from m""",
    "least_squares": f"""{_E}, m as (select event_id, covar_pop(k, value) over {_USER} c, var_pop(k) over {_USER} x, avg(k) over {_USER} mx, avg(value) over {_USER} my from e)
select event_id, {_r('case when x > 0 then c / x end', 'c_slope')}, {_r('case when x > 0 then my - c / x * mx end', 'c_intercept')} from m""",
    "corr_forms": f"""{_E}, m as (select event_id, covar_pop(k, value) over {_USER} c, var_pop(k) over {_USER} x, var_pop(value) over {_USER} y from e),
n as (select *, case when x > 0 and y > 0 then c / sqrt(x * y) end r from m)
select event_id, {_r('r', 'c_corr')}, {_r('case when y > 0 then c / y end', 's_slope')}, {_r('-r', 'n_corr')}, {_r('c * 1.5', 't_cov')},
{_r('case when x > 0 then c / x / 6 end', 't_slope')}, {_r('sqrt(greatest(0, (1 - r) / 2))', 'distance')} from n""",
    "decayed_corr": f"""{_E}, p as (select a.event_id i, b.k x, b.value y, exp(-(a.t - b.t) / {_DAY}.0) w from e a join e b on a.event_type = b.event_type
  and (b.t < a.t or b.t = a.t and b.event_id <= a.event_id) where b.k is not null and b.value is not null),
m as (select i, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my from p group by i),
q as (select p.i, any_value(mx) mx, any_value(my) my, sum(w * (x - mx) * (x - mx)) / sum(w) xx, sum(w * (y - my) * (y - my)) / sum(w) yy, sum(w * (x - mx) * (y - my)) / sum(w) xy
  from p join m on p.i = m.i group by p.i)
select event_id, {_r('xy', 'c_cov')}, {_r('case when xx > 1e-12 and yy > 1e-12 then xy / sqrt(xx * yy) end', 'c_corr')}, {_r('case when xx > 1e-12 then xy / xx end', 'c_slope')},
{_r('case when xx > 1e-12 then my - xy / xx * mx end', 'c_intercept')}, {_r('xx', 'c_var_x')}, {_r('yy', 'c_var_y')} from e left join q on event_id = i""",
    "least_event": f"{_E} select event_id, (min(struct_pack(k := k, t := -t, i := -event_id)) over {_USER}).i * -1 least from e",
    "timed_values": f"{_E} select event_id, t at_ms, {_r('value + 1', 'x')} from e where t % 2 = 1",
    "triggers_merged": f"{_E} select t ts_ms, user_id who from e union all select epoch_us(o_orderdate) // 1000, o_custkey from orders",
    "moments_split": f"""{_E}, m as (select event_id, t, count(value) over w m_n, avg(value) over w a, stddev_pop(value) over w s, covar_pop(k, value) over w c, var_pop(k) over w x, var_pop(value) over w y,
  count(distinct k) over w kinds from e window w as (partition by event_type order by t, event_id rows unbounded preceding)),
g as (select event_id, count(value) over w a_n, avg(value) over w a_mean, first_value(event_id) over w "first", last_value(event_id) over w "last"
  from e window w as (order by t, event_id rows between unbounded preceding and 1 preceding))
select event_id, m_n, {_r('a', 'm_mean')}, {_r('s', 'm_std')}, {_r('case when x > 0 and y > 0 then c / sqrt(x * y) end', 'c_corr')}, cast(kinds as int) kinds,
a_n, {_r('a_mean', 'a_mean')}, "first", "last" from m join g using (event_id)""",
    "windows_split": f"""{_E}, w as (select event_id, {_sum_trailing('value', 'event_type', _DAY)} total, {_both('max(value)', 'greatest', 'event_type', _DAY)} high,
  {_trailing('sum(value * value)', 'event_type', _DAY)[0]} s0, {_trailing('sum(value * value)', 'event_type', _DAY)[1]} s1, {_sum_trailing('1', 'event_type', _DAY)} n,
  sum(value) over (partition by event_type order by t range between unbounded preceding and {6 * _HOUR} following) later from e),
h as (select a.event_id, {_decayed('event_type', _HOUR, False)} heat from e a join e b on a.event_type = b.event_type and b.t <= a.t group by a.event_id, a.t)
select event_id, {_r('total', 'total')}, high, {_r('sqrt(greatest(0, (coalesce(s0, 0) + s1) / n - (total / n) * (total / n)))', 'm_std')}, {_r('heat', 'heat')}, {_r('later', 'later')} from w join h using (event_id)""",
    "decay_1h": f"{_E} select a.event_id, {_r(_decayed('event_type', _HOUR, False), 'heat')} from e a join e b on a.event_type = b.event_type and b.t <= a.t group by a.event_id, a.t",
    "decays_6": f"{_E} select a.event_id, {_SIX} from e a join e b on a.user_id = b.user_id and b.t <= a.t group by a.event_id, a.t",
    "decayed_moments": f"""{_E}, p as (select a.event_id i, b.value x, exp(-(a.t - b.t) / {_DAY}.0) w from e a join e b on a.user_id = b.user_id
  and (b.t < a.t or b.t = a.t and b.event_id <= a.event_id)),
m as (select i, sum(w) w, sum(w * x) / sum(w) a from p group by i),
q as (select p.i, any_value(m.w) w, any_value(a) a, sum(p.w * (x - a) * (x - a)) / any_value(m.w) v from p join m on p.i = m.i group by p.i)
select i event_id, {_r('w', 'm_w')}, {_r('a', 'm_mean')}, {_r('v', 'm_var')}, {_r('sqrt(v)', 'm_std')} from q""",
    "decayed_label": f"{_E} select a.event_id, {_r(_decayed('user_id', _DAY, False, _HOUR), 'heat')} from e a join e b on a.user_id = b.user_id and b.t <= a.t + {_HOUR} group by a.event_id, a.t",
    "set_union_running": f"{_E} select event_id, array_to_string(list_sort(list_distinct(list(event_type) over {_USER})), ',') types from e",
    "any_refund": f"{_E} select event_id, coalesce(max(value > 90) over {_USER_BEFORE}, false) had from e",
    "fold_custom": f"{_E} select event_id, first_value(event_type) over {_USER} || '>' || event_type ends from e",
    "latest_within": f"""{_E}, l as (select event_id, t, lag(value) over (partition by user_id order by t, event_id) v, lag(t) over (partition by user_id order by t, event_id) b from e)
select event_id, case when t - b <= {6 * _HOUR} then v end near, v usual from l""",
    "time_bounds_limit": f"""{_E}, c as (select t ts_ms, user_id, event_id, count(*) over {_USER} n from e where t < 1705708800000)
select * from c where ts_ms >= 1704844800000 order by ts_ms, event_id limit 500""",
    "flagship_labeled": f"""{_E}, d as (select a.event_id, {_SIX} from e a join e b on a.user_id = b.user_id and b.t <= a.t group by a.event_id, a.t),
ty as (select event_id, count(*) over w type_n, max(value) over w type_high from e window w as (partition by event_type order by t, event_id rows between unbounded preceding and 1 preceding)),
day as (select event_id, user_id, t, {_sum_trailing('value', 'user_id', _DAY)} v, {_sum_trailing('1', 'user_id', _DAY)} c from e),
h as (select event_id, lag(v) over w day_total, cast(lag(c) over w as bigint) day_n from day window w as (partition by user_id order by t, event_id)),
m as (select event_id, user_id, t, count(*) over {_USER_BEFORE} m_n, avg(value) over {_USER_BEFORE} a, stddev_pop(value) over {_USER_BEFORE} s,
  lag(value) over (partition by user_id order by t, event_id) last_value,
  sum(value) over (partition by user_id order by t range between unbounded preceding and {_DAY} following) total,
  last_value(value) over (partition by user_id order by t range between unbounded preceding and {_HOUR} following) next_value from e)
select m.event_id, user_id, type_n, type_high, m_n, day_n, last_value, t % {_DAY} // {_HOUR} "hour", next_value, {_r('a', 'm_mean')}, {_r('s', 'm_std')},
{_r('day_total', 'day_total')}, {_r('total', 'total')}, d.* exclude (event_id) from m join ty using (event_id) join h using (event_id) join d using (event_id) where m_n > 0""",
}
