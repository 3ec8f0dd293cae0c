from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.interpreter import Point, run
from tidemark.functions import monoids as M
from tidemark.plans import graph as G
from tidemark.plans.graph import Constant, Empty, Label, Source
from tidemark.plans.lower import Engine, PlanError, TimeBound

NUM = Source("num", "ts", "ts")
K = NUM.map("i", k="i % 2").key_by("k")


def rows(spark, data, node, **kw):
    df = spark.createDataFrame(data, "ts long, i int")
    return [tuple(r) for r in Engine(spark, {"num": df}).run(node, ordered=True, **kw).collect()]


def test_map(spark):
    assert rows(spark, [(0, 42), (1, 43), (2, 44)], NUM.map(x="cast(i as string)")) == [("42",), ("43",), ("44",)]


DATA = [(0, 42), (1, 43), (2, 44), (3, 45)]
SIX = [(i, i + 1) for i in range(6)]


def test_pre_and_post(spark):
    s = K.sum(s=M.Sum("i"))
    assert rows(spark, DATA, K.pre_lookup(s).values("k", "s")) == [(0, 0), (1, 0), (0, 42), (1, 43)]
    assert rows(spark, DATA, K.post_lookup(s).values("k", "s")) == [(0, 42), (1, 43), (0, 86), (1, 88)]


def test_labels(spark):
    label = Label.of(K.sum(s=M.Sum("i")))
    assert rows(spark, SIX, K.labeled(label.look_forward(3)).map("k", "s")) == [(1, 4), (0, 6), (1, 9), (0, 12), (1, 9), (0, 12)]
    both = label.look_forward(2).map(a="s").zip(label.look_forward(4).map(b="s"))
    assert rows(spark, SIX, K.labeled(both).map("k", "a", "b")) == [(1, 4, 9), (0, 6, 12), (1, 9, 9), (0, 12, 12), (1, 9, 9), (0, 12, 12)]


def test_infinite_look_forward_reads_the_end(spark):
    label = Label.of(K.sum(s=M.Sum("i"))).look_forward("infinite")
    assert rows(spark, SIX, K.labeled(label).map("k", "s")) == [(k, 9 if k else 12) for k in (1, 0, 1, 0, 1, 0)]


def test_nested_look_forwards_add(spark):
    label = Label.of(K.count("n"))
    a = rows(spark, SIX, K.labeled(label.look_forward(1).look_forward(2)).map("n"))
    assert a == rows(spark, SIX, K.labeled(label.look_forward(3)).map("n"))


def test_label_over_a_feature_with_a_lookup(spark):
    inner = K.post_lookup(K.sum(s=M.Sum("i")))
    label = Label.of(inner.latest("s")).look_forward(3)
    assert rows(spark, SIX, K.labeled(label).map("k", "s")) == [(1, 4), (0, 6), (1, 9), (0, 12), (1, 9), (0, 12)]


def test_inclusive_window(spark):
    one = NUM.map("i", k="1").key_by("k")
    got = rows(spark, [(0, 1), (1000, 1), (2000, 1)], one.post_lookup(one.window("1s", n=M.Sum("i"))).values("n", "time_min", "time_max", "size"))
    assert got == [(1, 0, 0, 1), (2, 0, 1000, 2), (2, 1000, 2000, 2)]


def test_zero_and_infinite_windows(spark):
    one = NUM.map("i", k="1").key_by("k")
    both = one.window_sum(0, z=M.Sum("i")).zip(one.window_sum("infinite", a=M.Sum("i")))
    assert rows(spark, [(0, 1), (1, 2), (2, 3)], one.post_lookup(both).values("z", "a")) == [(1, 1), (2, 3), (3, 6)]


def test_concat_gives_left_outputs_first(spark):
    both = NUM.map("i", side="'l'") + NUM.map("i", side="'r'")
    assert rows(spark, [(0, 1), (1, 2)], both) == [(1, "l"), (1, "r"), (2, "l"), (2, "r")]


def test_outputs_of_one_point_share_states(spark):
    many = NUM.concat_map("array(i, i * 10)", "x").map("x", k="1").key_by("k")
    got = rows(spark, [(0, 1), (1, 2)], many.pre_lookup(many.sum(b=M.Sum("x"))).post_lookup(many.sum(a=M.Sum("x"))).values("x", "b", "a"))
    assert got == [(1, 0, 11), (10, 0, 11), (2, 11, 33), (20, 11, 33)]


def test_changes_fire_when_nothing_changes(spark):
    got = rows(spark, [(0, 2), (1, 2), (2, 4)], K.sum(h=M.Max("i")).changes())
    assert got == [(0, None, 2), (0, 2, 2), (0, 2, 4)]


def test_latest_keeps_null_payloads(spark):
    k = NUM.map(x="nullif(i, 44)", k="i % 2").key_by("k")
    assert rows(spark, DATA, k.post_lookup(k.latest("x").map(last="x")).values("x", "last")) == [(42, 42), (43, 43), (None, None), (45, 45)]


def test_latest_within_is_applied_only_on_request(spark):
    k = NUM.map("i", k="1").key_by("k")
    got = rows(spark, [(0, 1), (5, 2), (100, 3)], k.pre_lookup(k.latest_within(10, "i").map(a="i"), k.latest_within(10, "i", enforce=True).map(b="i")).values("a", "b"))
    assert got == [(None, None), (1, 1), (2, None)]


def test_read_time_is_the_events_own(spark):
    label = Label.of(K.sum(s=M.Sum("i")).map(t="_ts")).look_forward(3)
    assert rows(spark, SIX, K.labeled(label).map("t")) == [(i,) for i in range(6)]


def test_constant_features_and_empty(spark):
    assert rows(spark, DATA, K.post_lookup(Constant.of(c="k + 1", t="_ts")).values("c", "t")) == [(1, 0), (2, 1), (1, 2), (2, 3)]
    assert rows(spark, DATA, Empty("i int") + NUM.map("i")) == [(42,), (43,), (44,), (45,)]
    k = (Empty("i int, k int")).key_by("k")
    assert rows(spark, DATA, K.pre_lookup(k.sum(s=M.Sum("i")))) == [(0, 42, 0), (1, 43, 0), (0, 44, 0), (1, 45, 0)]


def test_constants_alone_where_keys_are_hot(spark):
    """Constants keep no state: no key is cut for them, and rows are not moved."""
    df = spark.createDataFrame(SIX, "ts long, i int")
    fn = Constant.of(c="k + 1", t="_ts")
    for node in (K.post_lookup(fn).values("c", "t"), K.pre_lookup(fn).values("c", "t"), K.labeled(Label.of(fn).look_forward(2)).map("c", "t")):
        got = Engine(spark, {"num": df}, hot_rows=2).run(node)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 3), (1, 5), (2, 0), (2, 2), (2, 4)]


def test_unit_key(spark):
    all_of = NUM.map("i").key_by()
    assert rows(spark, DATA, all_of.post_lookup(all_of.count("n")).values("n")) == [(1,), (2,), (3,), (4,)]


def test_bounds(spark):
    df = spark.createDataFrame(SIX, "ts long, i int")
    engine = Engine(spark, {"num": df}, TimeBound(2, 5))
    label = Label.of(K.sum(s=M.Sum("i"))).look_forward(3)
    assert [tuple(r) for r in engine.run(K.labeled(label).map("k", "s"), ordered=True, limit=2).collect()] == [(1, 9), (0, 6)]
    with pytest.raises(ValueError):
        TimeBound(5, 5)


def test_validation(spark):
    df = spark.createDataFrame(SIX, "ts long, i int")
    other = Source("num", "ts + 1", "ts")
    with pytest.raises(PlanError, match="one name"):
        Engine(spark, {"num": df}).run(NUM.map("i") + other.map("i"))
    with pytest.raises(PlanError, match="no input"):
        Engine(spark, {}).run(NUM)
    Engine(spark, {"num": df, "unused": df}).run(NUM).count()


def test_introspection():
    label = Label.of(K.count("n")).look_forward(3)
    node = K.pre_lookup(K.sum(s=M.Sum("i"))).labeled(label)
    sources, offsets = G.sources_and_offsets_of(node)["num"]
    assert sources == {NUM} and sorted(d.ms for d in offsets) == [0, 3]
    assert len(G.lookups_of(node)) == 1
    assert NUM.map("i").filter("true").amplification == G.MAYBE
    assert (NUM + NUM).amplification == G.Amplification(2, 2)
    assert NUM.concat_map("array(1)").amplification == G.MANY
    assert Empty("i int").amplification == G.NONE
    assert K.pre_lookup(K.count("n")).triggers() == K.triggers()
    assert NUM.map("i") == Source("num", "ts", "ts").map("i")


AGGS = dict(
    s=M.Sum("v"), n=M.Count(), hi=M.Max("v"), lo=M.Min("v"), f=M.First("v"), la=M.Last("v"), t=M.AnyTrue("v > 5"), m=M.Moments("v"), c=M.Correlation("v", "w"), e=M.Extremum("v", "w")
)


def _random_frames(spark, seed: int):
    r = random.Random(seed)
    points = []
    for src in ("a", "b"):
        ts = sorted(r.randint(0, 40) for _ in range(60))
        points += [Point(src, t, i, r.choice((0, 0, 0, 1, 2)), r.randint(0, 9), r.randint(0, 2)) for i, t in enumerate(ts)]
    frames = {s: spark.createDataFrame([(p.ts, p.ord, p.key, p.value, p.fan) for p in points if p.src == s], "ts long, ord long, key int, value int, fan int") for s in ("a", "b")}
    return points, frames


@pytest.mark.parametrize("hot_rows", [None, 7])
@pytest.mark.parametrize("probe,update,offset", [("a", "b", 0), ("b", "a", 5), ("a", "a", 11), ("b", "b", 0)])
def test_against_interpreter(spark, probe, update, offset, hot_rows):
    points, frames = _random_frames(spark, hash((probe, update, offset)) % 1000)
    src = {s: Source(s, "ts", "ord") for s in ("a", "b")}
    outs = src[probe].concat_map("filter(array(0, 1), x -> x < fan)", "out").map("ord", "out", "key").key_by("key")
    ups = src[update].concat_map("filter(array(0, 1, 2), x -> x < value % 3)", "i").map("key", v="value + i").key_by("key")
    state = ups.sum(s=M.Sum("v")).zip(ups.latest("v"))
    window = ups.window_sum(9, w=M.Sum("v"))
    node = outs.pre_lookup(state.map(bs="s", bv="v").zip(window.map(bw="w"))).post_lookup(state.map(as_="s", av="v").zip(window.map(aw="w")))
    node = node.labeled(Label.of(state).look_forward(offset).map(ls="s", lv="v")).map("ord", "out", "key", "bs", "bv", "as_", "av", "ls", "lv", "bw", "aw")
    got = [tuple(r) for r in Engine(spark, frames, hot_rows=hot_rows).run(node).collect()]
    assert sorted(got, key=repr) == sorted(run(points, probe, update, offset, 9), key=repr)


def _same(x, y, tolerance):
    for name in x.asDict():
        u, v = x[name], y[name]
        near = isinstance(u, float) and isinstance(v, float) and abs(u - v) <= tolerance * max(1, abs(u))
        assert near or u == v, (name, u, v)


@pytest.mark.parametrize("mean", [0, 10**8])
@pytest.mark.parametrize("offset", [0, 6])
def test_hot_keys_give_the_same(spark, offset, mean):
    _, frames = _random_frames(spark, 3)
    src = {s: Source(s, "ts", "ord") for s in ("a", "b")}
    k = {s: src[s].map("ord", "key", v=f"value + {mean}", w=f"(value * 7) % 5 + {mean}").key_by("key") for s in src}
    decays = dict(d=M.Decay.of("v", "5ms"), dm=M.DecayedMoments.of("v", "3ms"), dc=M.DecayedCorrelation.of("v", "w", "9ms"))
    trailing = {f"t_{n}": a for n, a in AGGS.items()}
    sets = dict(u=M.SetUnion("v"))
    feature = k["b"].sum(**AGGS, **decays, **sets).zip(k["b"].window(8, **trailing)).zip(k["b"].latest_within(6, "v", enforce=True).map(near="v"))
    node = k["a"].labeled(Label.of(feature).look_forward(offset)) if offset else k["a"].pre_lookup(feature)
    plain = Engine(spark, frames).run(node).orderBy("ord").collect()
    for hot_rows in (5,):
        split = Engine(spark, frames, hot_rows=hot_rows).run(node).orderBy("ord").collect()
        assert len(plain) == len(split) == 60
        for x, y in zip(plain, split, strict=True):
            _same(x, y, 1e-9)


def _exact(pairs):
    """Population moments and correlation in exact arithmetic."""
    n = len(pairs)
    mx, my = (Fraction(sum(p[i] for p in pairs), n) for i in (0, 1))
    xx, yy, xy = (sum((p[i] - (mx, my)[i]) * (p[j] - (mx, my)[j]) for p in pairs) / n for i, j in ((0, 0), (1, 1), (0, 1)))
    return float(mx), math.sqrt(xx), float(xy) / math.sqrt(xx * yy) if xx and yy else None


@pytest.mark.parametrize("hot_rows", [None, 40, 333])
def test_large_means_keep_their_digits(spark, hot_rows):
    """Running, trailing, keyless and decayed moments of values around 1e8, against exact sums."""
    data = [(i, 10**8 + i * 7919 % 7, 10**8 + i * 104729 % 5) for i in range(1000)]
    df = spark.createDataFrame(data, "ts long, x long, y long")
    num = Source("num", "ts", "ts").map("ts", "x", "y").key_by()
    run = num.sum(m=M.Moments("x"), c=M.Correlation("x", "y"), dm=M.DecayedMoments.of("x", "50ms"), dc=M.DecayedCorrelation.of("x", "y", "50ms"))
    node = num.post_lookup(run.zip(num.window_sum("100ms", w=M.Moments("x"), wc=M.Correlation("x", "y"))))
    for r in Engine(spark, {"num": df}, hot_rows=hot_rows).run(node).collect():
        i = r.ts
        for pairs, m, c in ((data[: i + 1], "m", "c"), (data[max(0, i - 100) : i + 1], "w", "wc")):
            mean, std, corr = _exact([p[1:] for p in pairs])
            assert r[f"{m}_n"] == len(pairs) and abs(r[f"{m}_mean"] / mean - 1) < 1e-15
            assert abs(r[f"{m}_std"] - std) < 1e-9 and (r[f"{c}_corr"] is None) == (corr is None) and (corr is None or abs(r[f"{c}_corr"] - corr) < 1e-9)
        weights = [math.exp((t - i) / 50) for t, _, _ in data[: i + 1]]
        w = sum(weights)
        x, y = ([p[j] - 10**8 for p in data[: i + 1]] for j in (1, 2))
        mx, my = (sum(a * b for a, b in zip(weights, v, strict=True)) / w for v in (x, y))
        var = sum(a * (b - mx) ** 2 for a, b in zip(weights, x, strict=True)) / w
        cov = sum(a * (b - mx) * (c - my) for a, b, c in zip(weights, x, y, strict=True)) / w
        assert abs(r.dm_w - w) < 1e-9 * w and abs(r.dm_mean - 10**8 - mx) < 1e-6 and abs(r.dm_var - var) < 1e-7 and abs(r.dc_cov - cov) < 1e-7


def test_a_hot_key_with_an_outlying_time_is_cut_into_even_spans(spark):
    """Cuts lie at quantiles, so that one time far away does not leave all rows in one span."""
    df = spark.range(20_000).selectExpr("if(id = 0, 4102444800000, id) as ts", "id", "1 as i")
    one = Source("num", "ts", "id").map("i", "id", k="1").key_by("k")
    out = Engine(spark, {"num": df}, hot_rows=100).run(one.post_lookup(one.count("n")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.agg(F.sum("n")).first()[0] == 20_000 * 20_001 // 2
    assert len(parts) >= 3 and max(parts) < 12_000


def test_fold_keeps_order(spark):
    k = NUM.map(t="cast(i as string)", k="1").key_by("k")
    fold = M.Fold("t", "", lambda a, b: a + b, "string")
    assert rows(spark, DATA, k.post_lookup(k.sum(f=fold)).values("f")) == [("42",), ("4243",), ("424344",), ("42434445",)]
    assert rows(spark, DATA, k.pre_lookup(k.sum(f=fold)).values("f"))[:2] == [("",), ("42",)]


def test_shuffles_are_shared(spark):
    """Features of one key, at any offset, cost one exchange; a self lookup none beside it."""
    df = spark.createDataFrame(SIX, "ts long, i int")
    feature = K.sum(s=M.Sum("i"), h=M.Max("i")).zip(K.window_sum(3, w=M.Sum("i"))).zip(K.latest("i").map(x="i"))
    plan = Engine(spark, {"num": df}).run(K.pre_lookup(feature))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
    label = Label.of(feature).look_forward(2)
    plan = Engine(spark, {"num": df}).run(K.labeled(label))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shuffled_input_gives_the_same(spark):
    mixed = [SIX[i] for i in (3, 1, 5, 0, 4, 2)]
    s = K.sum(s=M.Sum("i"))
    assert rows(spark, mixed, K.post_lookup(s)) == rows(spark, SIX, K.post_lookup(s))
