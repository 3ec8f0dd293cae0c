"""Queries of the point-in-time engine over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import duration as D
from tidemark.functions import monoids as M
from tidemark.plans.graph import Constant, Event, Label, Source
from tidemark.plans.graph import lookups_of as node_lookups
from tidemark.plans.lower import Engine, TimeBound
from tidemark.session import table

EVENTS = Source("events", "unix_millis(cast(ts as timestamp))", "event_id")
ORDERS = Source("orders", "unix_millis(cast(o_orderdate as timestamp))", "o_orderkey")
CUSTOMERS = Source("customer", "cast(0 as long)", "c_custkey")
BY_USER = EVENTS.map("event_id", "event_type", "user_id", "value", k="cast(get_json_object(props, '$.k') as int)").key_by("user_id")
PURCHASES = EVENTS.filter("event_type = 'purchase'").map("user_id", "value").key_by("user_id")

#: Keys with more rows are cut into spans of time. Results do not depend on it.
HOT_ROWS = 1_000_000


def engine(spark: SparkSession, d: str, *names: str, bound: TimeBound | None = None, hot_rows: int = HOT_ROWS) -> Engine:
    return Engine(spark, {n: table(spark, d, n) for n in names or ("events",)}, bound, hot_rows)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places for comparing. The small shift keeps exact halves, which means over
    32 or 64 prices often are, from falling to either side."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(1.234e-8), 6) + F.lit(0.0) for n in names})


def running_count(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "event_type").key_by("event_type")
    return engine(spark, d).run(keys.post_lookup(keys.count("n")))


def pre_sum(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    out = engine(spark, d).run(keys.pre_lookup(keys.sum(total=M.Sum("value"))).values("event_id", "total"))
    return rounded(out, "total")


def latest_prev(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    last = keys.latest("value").map(previous="value")
    return engine(spark, d).run(keys.pre_lookup(last).values("event_id", "previous"))


def running_max_min(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    return engine(spark, d).run(keys.post_lookup(keys.sum(high=M.Max("value"), low=M.Min("value"))).values("event_id", "high", "low"))


def best_event(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "k", top="event_id")
    return engine(spark, d).run(keys.post_lookup(keys.max("top", "k").map(best="top")).values("event_id", "best"))


def map_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = EVENTS.map("event_id", x="value * 2").map("event_id", x="x + 1").filter("x > 50")
    return rounded(engine(spark, d).run(chain), "x")


def concat_map(spark: SparkSession, d: str) -> DataFrame:
    parts = Source("part", "cast(0 as long)", "p_partkey")
    words = parts.map("p_partkey", name="p_name").concat_map("split(name, ' ')", "word", "at").map("p_partkey", "at", "word")
    return engine(spark, d, "part").run(words)


def running_words(spark: SparkSession, d: str) -> DataFrame:
    """Words seen before the row, which all outputs of the row share."""
    parts = Source("part", "cast(0 as long)", "p_partkey")
    words = parts.map("p_partkey", name="p_name").concat_map("split(name, ' ')", "word", "at").map("p_partkey", "at", "word").key_by("word")
    return engine(spark, d, "part").run(words.pre_lookup(words.count("before")))


def _both() -> Event:
    left = ORDERS.map(id="o_orderkey", who="o_custkey", amount="o_totalprice")
    return left + EVENTS.map(id="event_id", who="user_id", amount="value")


def concat_events(spark: SparkSession, d: str) -> DataFrame:
    keys = _both().key_by("who")
    out = engine(spark, d, "orders", "events").run(keys.post_lookup(keys.sum(total=M.Sum("amount"), n=M.Count())), time="ts_ms")
    return rounded(out.select("ts_ms", "id", "who", "total", "n"), "total")


def with_time_calendar(spark: SparkSession, d: str) -> DataFrame:
    t = "time"
    out = EVENTS.with_time(t).map(
        "event_id",
        day_of_week=lambda: D.unix_day_of_week(F.col(t)),
        hour=lambda: D.unix_hour_of_day(F.col(t)),
        minute=lambda: D.unix_minute_of_day(F.col(t)),
        bucket_5m=lambda: D.bucket(F.col(t), "5min"),
        rest_5m=lambda: D.remainder(F.col(t), "5min"),
        calendar_day="dayofweek(timestamp_millis(time))",
    )
    return engine(spark, d).run(out)


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "user_id", "event_type").key_by("user_id", "event_type")
    first = keys.pre_lookup(keys.count("seen")).filter("seen = 0")
    return engine(spark, d).run(first.values("event_id", "user_id", "event_type"))


def cross_source_lookup(spark: SparkSession, d: str) -> DataFrame:
    probes = ORDERS.map("o_orderkey", user_id="o_custkey").key_by("user_id")
    bought = PURCHASES.sum(spent=M.Sum("value"), n=M.Count()).zip(PURCHASES.latest("value").map(last_value="value"))
    out = engine(spark, d, "orders", "events").run(probes.pre_lookup(bought))
    return rounded(out, "spent")


def purchases_before_event(spark: SparkSession, d: str) -> DataFrame:
    bought = PURCHASES.sum(spent=M.Sum("value"), n=M.Count())
    out = engine(spark, d).run(BY_USER.map_values("event_id").pre_lookup(bought).values("event_id", "spent", "n"))
    return rounded(out, "spent")


def cross_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's nation, then with the nation's orders so far: two keys in turn."""
    nation = CUSTOMERS.map("c_custkey", "c_nationkey").key_by(o_custkey="c_custkey").latest("c_nationkey").map(nation="c_nationkey")
    orders = ORDERS.map("o_orderkey", "o_custkey", "o_totalprice").key_by("o_custkey").post_lookup(nation)
    by_nation = orders.map("o_orderkey", "nation", "o_totalprice").key_by("nation")
    out = engine(spark, d, "orders", "customer").run(by_nation.pre_lookup(by_nation.sum(total=M.Sum("o_totalprice"), n=M.Count())))
    return rounded(out.select("o_orderkey", "nation", "total", "n"), "total")


def changes_max(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("user_id", "value").key_by("user_id")
    changed = keys.sum(high=M.Max("value")).changes("was_", "is_").filter("not (was_high <=> is_high)")
    return engine(spark, d).run(changed, time="ts_ms")


def zip_features(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    both = keys.count("n").zip(keys.sum(total=M.Sum("value"))).zip(keys.sum(high=M.Max("value")))
    return rounded(engine(spark, d).run(keys.post_lookup(both).values("event_id", "n", "total", "high")), "total")


def const_fn_feature(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id")
    fn = Constant.of(one="1", parity="user_id % 2", second="(_ts div 1000) % 60")
    return engine(spark, d).run(keys.post_lookup(fn).values("event_id", "one", "parity", "second"))


def window_sum_1d(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    out = engine(spark, d).run(keys.post_lookup(keys.window_sum("1d", total=M.Sum("value"))).values("event_id", "total"))
    return rounded(out, "total")


def window_max_1d(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    return engine(spark, d).run(keys.post_lookup(keys.window_sum("1d", high=M.Max("value"), low=M.Min("value"))).values("event_id", "high", "low"))


def window_count_1h(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "event_type").key_by("event_type")
    return engine(spark, d).run(keys.post_lookup(keys.window("1h", n=M.Count())).values("event_id", "n", "time_min", "time_max", "size"))


def window_read_by_others(spark: SparkSession, d: str) -> DataFrame:
    """The purchases of the day up to the user's last purchase, read at every event of the user."""
    week = PURCHASES.window_sum("1d", spent=M.Sum("value"), n=M.Count())
    out = engine(spark, d).run(BY_USER.map_values("event_id").post_lookup(week).values("event_id", "spent", "n"))
    return rounded(out, "spent")


def _label(label: Label):
    return BY_USER.map_values("event_id").labeled(label)


def label_latest_1h(spark: SparkSession, d: str) -> DataFrame:
    label = Label.of(BY_USER.latest("value")).look_forward("1h").map(future="value")
    return engine(spark, d).run(_label(label).map("event_id", "future"))


def label_sum_1d(spark: SparkSession, d: str) -> DataFrame:
    label = Label.of(BY_USER.sum(total=M.Sum("value"))).look_forward("1d")
    return rounded(engine(spark, d).run(_label(label).map("event_id", "total")), "total")


def label_zip_15_30(spark: SparkSession, d: str) -> DataFrame:
    n = BY_USER.count("n")
    label = Label.of(n).look_forward("15min").map(n15="n").zip(Label.of(n).look_forward("30min").map(n30="n"))
    return engine(spark, d).run(_label(label).map("event_id", "n15", "n30"))


def label_nested(spark: SparkSession, d: str) -> DataFrame:
    label = Label.of(BY_USER.count("n")).look_forward("10min").look_forward("15min")
    return engine(spark, d).run(_label(label).map("event_id", "n").filter("n > 1"))


def sum_forward_1h(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "event_type", "value").key_by("event_type")
    out = keys.labeled(keys.sum_forward("1h", total=M.Sum("value"))).map("event_id", "total")
    return rounded(engine(spark, d).run(out), "total")


def moments_running(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    out = engine(spark, d).run(keys.post_lookup(keys.sum(value_m=M.Moments("value"))).values("event_id", "value_m_n", "value_m_mean", "value_m_std"))
    return rounded(out, "value_m_mean", "value_m_std")


def zscore(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    z = keys.post_lookup(keys.sum(m=M.Moments("value"))).map("event_id", z=lambda: M.zscore(F.col("value"), F.col("m_mean"), F.col("m_std")))
    return rounded(engine(spark, d).run(z), "z")


def corr_running(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value", "k")
    out = engine(spark, d).run(keys.post_lookup(keys.sum(c=M.Correlation("k", "value"))).values("event_id", "c_cov", "c_corr"))
    return rounded(out, "c_cov", "c_corr")


def least_squares(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value", "k")
    out = engine(spark, d).run(keys.post_lookup(keys.sum(c=M.Correlation("k", "value"))).values("event_id", "c_slope", "c_intercept"))
    return rounded(out, "c_slope", "c_intercept")


def decay_1h(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "event_type", "value").key_by("event_type")
    out = engine(spark, d).run(keys.post_lookup(keys.sum(heat=M.Decay.of("value", "1h"))).values("event_id", "heat"))
    return rounded(out, "heat")


def decays_6(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    six = keys.sum(**{f"d_{x}": M.Decay.of("value", x) for x in M.DECAYS})
    out = engine(spark, d).run(keys.pre_lookup(six).values("event_id", *(f"d_{x}" for x in M.DECAYS)))
    return rounded(out, *(f"d_{x}" for x in M.DECAYS))


def decayed_moments(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    m = keys.sum(m=M.DecayedMoments.of("value", "1d"))
    out = engine(spark, d).run(keys.post_lookup(m).values("event_id", "m_w", "m_mean", "m_var", "m_std"))
    return rounded(out, "m_w", "m_mean", "m_var", "m_std")


def decayed_label(spark: SparkSession, d: str) -> DataFrame:
    """A decayed feature under a label is read at the event's own time, not at the later one."""
    label = Label.of(BY_USER.sum(heat=M.Decay.of("value", "1d"))).look_forward("1h")
    return rounded(engine(spark, d).run(_label(label).map("event_id", "heat")), "heat")


def decayed_corr(spark: SparkSession, d: str) -> DataFrame:
    keys = EVENTS.map("event_id", "event_type", "value", k="cast(get_json_object(props, '$.k') as int)").key_by("event_type")
    names = ("c_cov", "c_corr", "c_slope", "c_intercept", "c_var_x", "c_var_y")
    out = engine(spark, d).run(keys.post_lookup(keys.sum(c=M.DecayedCorrelation.of("k", "value", "1d"))).values("event_id", *names))
    return rounded(out, *names)


def corr_forms(spark: SparkSession, d: str) -> DataFrame:
    """A correlation with its sides swapped, one negated and both scaled, and as a distance."""
    keys = BY_USER.map_values("event_id", "value", "k")
    c = M.Correlation("k", "value")
    forms = keys.sum(c=c, s=c.swap(), n=c.negate(), t=c.scaled(3.0, 0.5)).map(
        "c_corr", "s_slope", "n_corr", "t_cov", "t_slope", distance=lambda: M.distance_metric(F.col("c_corr"))
    )
    names = ("c_corr", "s_slope", "n_corr", "t_cov", "t_slope", "distance")
    return rounded(engine(spark, d).run(keys.post_lookup(forms).values("event_id", *names)), *names)


def least_event(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "k", top="event_id")
    return engine(spark, d).run(keys.post_lookup(keys.min("top", "k").map(least="top")).values("event_id", "least"))


def timed_values(spark: SparkSession, d: str) -> DataFrame:
    """Values with their time, through a pipe of steps."""
    late = lambda e: e.filter("at_ms % 2 = 1").map("event_id", "at_ms", x="value + 1")
    out = BY_USER.map_values("event_id", "value").value_with_time("at_ms").through(late)
    return rounded(engine(spark, d).run(out), "x")


def triggers_merged(spark: SparkSession, d: str) -> DataFrame:
    """When a merge of two logs, each with a lookup, can say something about a key."""
    events = BY_USER.pre_lookup(BY_USER.count("n")).map(who="user_id", id="event_id", x="n").key_by("who")
    orders = ORDERS.map(who="o_custkey", id="o_orderkey", x="cast(0 as long)").key_by("who")
    both = (events + orders).key_by("who")
    node = both.triggers()
    assert not node_lookups(node)
    return engine(spark, d, "events", "orders").run(node, time="ts_ms")


#: Rows of a key from which the queries `*_split` cut it, so that small tables are cut too.
SPLIT_ROWS = 200


def moments_split(spark: SparkSession, d: str) -> DataFrame:
    """Moments and correlation of keys that are cut into spans, and of all rows without a key."""
    keys = EVENTS.map("event_id", "event_type", "value", k="cast(get_json_object(props, '$.k') as int)").key_by("event_type")
    every = keys.map("event_id", "event_type", "value", "k").key_by()
    by_type = keys.sum(m=M.Moments("value"), c=M.Correlation("k", "value"), types=M.SetUnion("k")).map("m_n", "m_mean", "m_std", "c_corr", kinds="size(types)")
    rows = keys.post_lookup(by_type).map("event_id", "value", "m_n", "m_mean", "m_std", "c_corr", "kinds").key_by()
    out = rows.pre_lookup(every.sum(a=M.Moments("value"), f=M.First("event_id"), l=M.Last("event_id")).map("a_n", "a_mean", first="f", last="l"))
    out = engine(spark, d, hot_rows=SPLIT_ROWS).run(out)
    return rounded(out.drop("value"), "m_mean", "m_std", "c_corr", "a_mean")


def windows_split(spark: SparkSession, d: str) -> DataFrame:
    """Trailing windows, decayed sums and a label of keys that are cut into spans."""
    keys = EVENTS.map("event_id", "event_type", "value").key_by("event_type")
    day = keys.window_sum("1d", total=M.Sum("value"), high=M.Max("value"), m=M.Moments("value")).map("total", "high", "m_std")
    label = Label.of(keys.sum(later=M.Sum("value"))).look_forward("6h")
    node = keys.post_lookup(day, keys.sum(heat=M.Decay.of("value", "1h"))).labeled(label).map("event_id", "total", "high", "m_std", "heat", "later")
    return rounded(engine(spark, d, hot_rows=SPLIT_ROWS).run(node), "total", "m_std", "heat", "later")


def set_union_running(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "event_type")
    types = keys.sum(types=M.SetUnion("event_type")).map(types="array_join(types, ',')")
    return engine(spark, d).run(keys.post_lookup(types).values("event_id", "types"))


def any_refund(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", big="value > 90")
    return engine(spark, d).run(keys.pre_lookup(keys.sum(had=M.AnyTrue("big"))).values("event_id", "had"))


def fold_custom(spark: SparkSession, d: str) -> DataFrame:
    """A monoid of unknown form: the text of the first and the last event type, not commutative."""
    keys = BY_USER.map_values("event_id", "event_type")
    ends = M.Fold("concat(event_type, '>', event_type)", "", _ends, "string")
    return engine(spark, d).run(keys.post_lookup(keys.sum(ends=ends)).values("event_id", "ends"))


def _ends(old: str, new: str) -> str:
    return f"{old.split('>')[0]}>{new.split('>')[1]}"


def latest_within(spark: SparkSession, d: str) -> DataFrame:
    keys = BY_USER.map_values("event_id", "value")
    near = keys.latest_within("6h", "value", enforce=True).map(near="value")
    usual = keys.latest_within("6h", "value").map(usual="value")
    return engine(spark, d).run(keys.pre_lookup(near, usual).values("event_id", "near", "usual"))


def time_bounds_limit(spark: SparkSession, d: str) -> DataFrame:
    bound = TimeBound(1_704_844_800_000, 1_705_708_800_000)
    keys = BY_USER.map_values("event_id")
    return engine(spark, d, bound=bound).run(keys.post_lookup(keys.count("n")), limit=500, time="ts_ms")


def flagship_labeled(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: history, a trailing window, six decays and moments of the user, the type's
    heat, and what the user spends within the next day."""
    keys = BY_USER.map_values("event_id", "event_type", "value")
    six = keys.sum(**{f"d_{x}": M.Decay.of("value", x) for x in M.DECAYS}, m=M.Moments("value"))
    day = keys.window_sum("1d", day_total=M.Sum("value"), day_n=M.Count())
    last = keys.latest("value").map(last_value="value", hour=lambda: D.unix_hour_of_day(F.col("_ts")))
    history = six.zip(day).zip(last)
    by_type = EVENTS.map("event_type", "value").key_by("event_type").sum(type_n=M.Count(), type_high=M.Max("value"))
    typed = keys.map("event_id", "user_id", "event_type", "value").key_by("event_type").pre_lookup(by_type)
    rows = typed.map("event_id", "user_id", "value", "type_n", "type_high").key_by("user_id").pre_lookup(history)
    spent = Label.of(keys.sum(total=M.Sum("value"))).look_forward("1d").zip(Label.of(keys.latest("value").map(next_value="value")).look_forward("1h"))
    numbers = ("m_mean", "m_std", "day_total", "total", *(f"d_{x}" for x in M.DECAYS))
    out = rows.labeled(spent).filter("m_n > 0").map("event_id", "user_id", "type_n", "type_high", "m_n", "day_n", "last_value", "hour", "next_value", *numbers)
    return rounded(engine(spark, d).run(out), *numbers)


QUERIES = {
    f.__name__: f
    for f in (
        running_count, pre_sum, latest_prev, running_max_min, best_event, map_filter_chain, concat_map, running_words, concat_events,
        with_time_calendar, dedup_first, cross_source_lookup, purchases_before_event, cross_key_lookup, changes_max, zip_features, const_fn_feature,
        window_sum_1d, window_max_1d, window_count_1h, window_read_by_others, label_latest_1h, label_sum_1d, label_zip_15_30, label_nested,
        sum_forward_1h, moments_running, zscore, corr_running, least_squares, decay_1h, decays_6, decayed_moments, decayed_label,
        decayed_corr, corr_forms, least_event, timed_values, triggers_merged, moments_split, windows_split,
        set_union_running, any_refund, fold_custom, latest_within, time_bounds_limit, flagship_labeled,
    )
}
