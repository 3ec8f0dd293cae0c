"""The data-preparation operators of the core, on small cases against brute force."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stamps import Place, StampParser
from tidemark.functions.zones import ZoneTable
from tidemark.operators import bad_rows, known_at, normalise_time, regular_grid, spikes, tables, trailing
from tidemark.queries import market

GOOD = "2021-05-06 14:39:00,1.5,2,-3e2,4.25,76"


# --- rows that fail to parse --------------------------------------------------------------


@pytest.mark.parametrize(
    "line,reason",
    [
        (GOOD, None),
        (GOOD + "\r", None),
        (GOOD + "\r\r", "volume"),
        ('"2021-05-06 14:39:00","1.5",2,3,4,"76"', None),
        ('"2021-05-06 14:39:00"x,1,2,3,4,5', "quoting"),
        ('2021-05-06 14:39:00,1,2,3,4,"5', "quoting"),
        ('2021-05-06 14:39:00,1,2,3,4,5"', "quoting"),
        ('2021-05-06 14:39:00,1,2,3,4,"1""2"', "volume"),
        ('2021-05-06 14:39:00,1,2,3,4,"1,2"', "volume"),
        ("2021-05-06 14:39:00,1,2,3,4,1,2", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ("2021-02-29 14:39:00,1,2,3,4,5", "date_time"),
        ("2021-05-06 24:00:00,1,2,3,4,5", "date_time"),
        ("2021-05-06 23:59:60,1,2,3,4,5", "date_time"),
        ("2021-05-06T14:39:00,1,2,3,4,5", "date_time"),
        ("0000-05-06 14:39:00,1,2,3,4,5", "date_time"),
        (" 2021-05-06 14:39:00,1,2,3,4,5", "date_time"),
        ("x,1,2,3,y,z", "date_time"),
        ("2021-05-06 14:39:00,1,.5,3,4,5", "price"),
        ("2021-05-06 14:39:00,1,5.,3,4,5", "price"),
        ("2021-05-06 14:39:00,+1,5,3,4,5", "price"),
        ("2021-05-06 14:39:00,nan,5,3,4,5", "price"),
        ("2021-05-06 14:39:00,1,2,3,4,9223372036854775807", None),
        ("2021-05-06 14:39:00,1,2,3,4,0009223372036854775807", None),
        ("2021-05-06 14:39:00,1,2,3,4,9223372036854775808", "volume"),
        ("2021-05-06 14:39:00,1,2,3,4,-5", "volume"),
        ("2021-05-06 14:39:00,1,2,3,4,２３", "volume"),
        ("2021-05-06 14:39:00,1e999,2,3,4,5", None),
    ],
)
def test_line(line, reason):
    assert bad_rows.parse_line(line)[-1] == reason
    assert bad_rows.parse_lines(pa.array([line], pa.string())).column("reason").to_pylist() == [reason]


def test_blocks_agree_with_lines():
    r = random.Random(1)
    lines = [GOOD if r.random() < 0.8 else r.choice([GOOD + ",", GOOD[:-2] + "x", None, '"' + GOOD, GOOD.replace("05-06", "13-06"), "a" * 5000, GOOD.replace("1.5", "1e999"), '"' + GOOD[:19] + '"' + GOOD[19:]]) for _ in range(700)]
    for leaf in (1, 8):
        got = bad_rows.parse_lines(pa.array(lines, pa.string()), leaf).to_pylist()
        assert [tuple(x.values()) for x in got] == [bad_rows.parse_line(x) for x in lines]


def test_records_keep_other_columns(spark):
    df = spark.createDataFrame([(1, GOOD, "a"), (2, "x", "b"), (2, "x", None)], "id long, line string, Volume string")
    out = bad_rows.parse_records(df, "line")
    assert out.columns == ["id", "line", "Volume_in", "date_time", "open", "high", "low", "close", "volume", "reason"]
    got = [tuple(r) for r in out.orderBy("id").collect()]
    assert got[0] == (1, GOOD, "a", datetime(2021, 5, 6, 14, 39), 1.5, 2.0, -300.0, 4.25, 76, None)
    assert [g[-1] for g in got[1:]] == ["column_count"] * 2
    assert bad_rows.records(df, "line").count() == 1 and bad_rows.rejects(df, "line").count() == 2
    assert bad_rows.parse_records(df.limit(0), "line").count() == 0


# --- spikes -------------------------------------------------------------------------------

RULES = (spikes.Rule(0, True, True, 14, None, 0.5, False), spikes.Rule(0, False, False, 19, None, 0.5, False))
HOURLY = (spikes.Rule(0, True, True, 6), spikes.Rule(0, False, False, 1.5, 0.25, 0.75, True, True))


def brute_fence(rule: spikes.Rule, m: np.ndarray) -> tuple[float, float]:
    s = np.sort(m)
    q = [(s[int(np.floor((len(s) - 1) * p))] + s[int(np.ceil((len(s) - 1) * p))]) / 2 for p in rule.quantiles]
    low = q[0] if len(q) > 1 else 0.0
    return low - rule.expand * (q[-1] - low), q[-1] + rule.expand * (q[-1] - low)


def brute_spikes(rows: list[tuple], rules=RULES) -> set[tuple]:
    out = set()
    for f, rule in enumerate(rules):
        for source in {r[0] for r in rows if r[0] is not None}:
            own = sorted(r for r in rows if r[0] == source and r[1] is not None and r[3 + f] is not None)
            times = sorted({r[1] for r in own})
            x = np.array([next(r[3 + f] for r in own if r[1] == t) for t in times])
            if not len(x):
                continue
            level = np.array([np.median(x[max(0, i - 10) : i + 11]) for i in range(len(x))])
            m = np.abs(x - level) / np.abs(level) if rule.relative else x
            hour = np.array(times) // 3_600_000 % 24 if rule.by_hour else np.zeros(len(x))
            case = np.zeros(len(x), bool)
            for h in set(hour):
                low, high = brute_fence(rule, m[hour == h])
                case |= (hour == h) & ((m > high) | (rule.both_sides & (m < low)))
            case |= (x < rule.least) | (rule.barred & (x == rule.least))
            run = 0
            for i in range(1, len(x) + 1):
                if i == len(x) or x[i] != x[run]:
                    if i - run >= 12:
                        case[run:i] = True
                    run = i
            flagged = {t for t, c in zip(times, case, strict=True) if c}
            out |= {(source, f, r[2]) for r in own if r[1] in flagged}
    return out


@pytest.mark.parametrize("rules", [RULES, HOURLY])
@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_spikes(spark, partitions, rules):
    r = random.Random(4)
    rows, n = [], 0
    for source, size in (("hot", 1500), ("b", 90), ("c", 13), ("d", 1), ("e", 25), (None, 5)):
        price = 100.0
        for t in range(size):
            price *= 1 + r.uniform(-0.002, 0.002)
            p = price * (3 if r.random() < 0.01 else 1) if r.random() > 0.02 else r.choice([None, 0.0, -1.0])
            v = float(r.randint(1, 9) * (500 if r.random() < 0.01 else 1)) if r.random() > 0.02 else r.choice([None, -3.0])
            if source in ("hot", "b") and 40 <= t < 58:
                p = 77.0
            for _ in range(r.choice((1, 1, 1, 2))):
                rows.append((source, t * 700_000, n, p, v))
                n += 1
    df = spark.createDataFrame(rows, "source string, t long, rec_id long, price double, volume double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.source, x.field, x.rec_id) for x in spikes.implausible(df, rules).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_spikes(rows, rules)
    assert spikes.implausible(df.limit(0), RULES).count() == 0


def test_small_blocks_change_nothing(monkeypatch, spark):
    monkeypatch.setattr(spikes, "BLOCK_ROWS", 50)
    r = random.Random(9)
    source, t, x, rec = [], [], [], []
    for name in ("a", "b", "c"):
        for i in range({"a": 400, "b": 5, "c": 33}[name]):
            source.append(name)
            t.append(i // 2 if name == "a" else i)
            x.append(5.0 if 60 < i < 110 else r.gauss(100, 1) if name != "a" or i % 2 == 0 else x[-1])
            rec.append(len(rec))

    def scan(size: int) -> list:
        batches = [
            pa.record_batch([pa.array(source[a : a + size]), pa.array(t[a : a + size]), pa.array(rec[a : a + size]), pa.array(x[a : a + size])], names=["source", "t", "rec_id", "v"])
            for a in range(0, len(t), size)
        ]
        return sorted((tuple(d.values()) for b in spikes._scan(RULES[:1])(iter(batches)) for d in b.to_pylist()), key=repr)

    assert scan(7) == scan(50) == scan(10_000)


# --- a regular grid -----------------------------------------------------------------------


def test_grid(spark):
    r = random.Random(2)
    rows = []
    for s in range(6):
        for day in range(3):
            for i in range(0, 60):
                if r.random() < 0.75 or i in (0, 59):
                    rows.append((len(rows), f"s{s}", 5, day * 86_400 + 36_000 + i * 300 + r.randint(0, 299), (50 + 10 * s) * (1 + 0.002 * i)))
    rows += [(9001, "s0", None, 5, 1.0), (9002, None, 5, 5, 1.0), (9003, "s0", 0, 5, 1.0), (9004, "s0", 5, None, 1.0)]
    rows += [(9005, "lone", 5, 36_000, 7.0), (9006, "lone", 5, 36_600, None), (9007, "lone", 5, 37_200, None)]
    rows += [(9008, "odd", 7, 86_390, 3.0), (9009, "odd", 7, 86_400 + 700, 4.0), (9010, "odd", 7, 86_400 + 3000, 4.0)]
    df = spark.createDataFrame(rows, "id long, sym string, res int, s long, close double")
    args = dict(source=F.col("sym"), resolution=F.col("res"), seconds=F.col("s"), value=F.col("close"), tie=F.col("id"))
    got = {(x.source, x.resolution, x.slot_seconds): (x.value, x.state) for x in regular_grid.regular_grid(df, **args).collect()}
    held: dict[tuple, float | None] = {}
    for _, sym, res, s, close in sorted(rows, key=lambda x: (x[3] or 0, x[0])):
        if sym and res and s is not None:
            k = (sym, res, s - s % (res * 60))
            held[k] = close if close is not None else held.get(k)
    slots = set()
    for sym, res in {k[:2] for k in held}:
        for day in {k[2] // 86_400 for k in held if k[:2] == (sym, res)}:
            own = [k[2] for k in held if k[:2] == (sym, res) and k[2] // 86_400 == day]
            slots |= {(sym, res, s) for s in range(min(own), max(own) + 1, res * 60)}
    assert set(got) == slots
    for k, (value, state) in got.items():
        if k in held:
            assert state == "observed" and value == held[k]
        elif k[0].startswith("s"):
            truth = (50 + 10 * int(k[0][1])) * (1 + 0.002 * (k[2] % 86_400 - 36_000) / 300)
            others = sum(x[1:] == k[1:] for x in held)
            assert state == ("filled" if others >= regular_grid.SUPPORT else "unsupported")
            assert value is None if others < regular_grid.SUPPORT else abs(value / truth - 1) < 0.02
        else:
            assert state == "unsupported" and value is None
    gaps = {(x.source, x.resolution, x.slot_seconds) for x in regular_grid.regular_grid(df, **args, only_gaps=True).collect()}
    assert gaps == slots - set(held)
    assert regular_grid.regular_grid(df.limit(0), **args).count() == 0


@pytest.mark.parametrize("rows_max", [4096, 12])
def test_grid_learns_from_the_other_sources(spark, rows_max):
    """Values are a source's level times a jumpy factor of the instant that all sources share: a missing cell is
    told by the others at that instant, and not by a line through the source's own day."""
    r = np.random.default_rng(8)
    sources, days, n = 40, 2, 48
    level = r.uniform(20, 300, sources)
    factor = np.exp(np.cumsum(r.normal(0, 0.05, (days, n)), axis=1))
    seen = r.random((days, sources, n)) < 0.6
    seen[:, :, [0, -1]] = True
    truth = level[None, :, None] * factor[:, None, :] * (1 + r.normal(0, 0.001, seen.shape))
    rows = [(f"s{s}", d * 86_400 + i * 1800, float(truth[d, s, i]), i) for d, s, i in np.argwhere(seen).tolist()]
    df = spark.createDataFrame(rows, "sym string, s long, close double, id long")
    args = dict(source=F.col("sym"), resolution=F.lit(30), seconds=F.col("s"), value=F.col("close"), tie=F.col("id"), rows_max=rows_max)
    ours, line = [], []
    for x in regular_grid.regular_grid(df, **args).where("state <> 'observed'").collect():
        d, s, i = x.slot_seconds // 86_400, int(x.source[1:]), x.slot_seconds % 86_400 // 1800
        if x.state == "filled":
            at = np.flatnonzero(seen[d, s])
            ours.append(abs(x.value / truth[d, s, i] - 1))
            line.append(abs(np.polyval(np.polyfit(at, truth[d, s, at], 1), i) / truth[d, s, i] - 1))
    assert len(ours) > 0.95 * (~seen).sum()
    assert np.median(ours) < 0.01 and np.mean(ours) < 0.3 * np.mean(line)


# --- trailing totals ----------------------------------------------------------------------


def test_trailing(spark):
    r = random.Random(3)
    day = 86_400_000
    rows = []
    for s in ("a", "b", None):
        for _ in range(150):
            d = r.choice([*range(0, 40), *range(90, 200)])
            start = (d - 20) * day + r.randint(0, 2) * 3_600_000
            rows.append((s, start, len(rows), r.choice([None, 1.0, 2.5, 10.0]), r.choice([None, 5.0, 6.0])))
    rows.append(("a", None, 999, 1.0, 1.0))
    df = spark.createDataFrame(rows, "sym string, start long, id long, volume double, close double").withColumn("entity", F.lit("clash"))
    got = {(x["sym"], x["day"]): x for x in trailing.trailing_totals(df, "sym", "start", "id", "volume", "close").collect()}
    last = {}
    for s, start, i, v, c in rows:
        if s and start is not None and i >= last.get((s, start), (-1,))[0]:
            last[s, start] = (i, v or 0.0, c)
    days = set()
    for s in ("a", "b"):
        own = [k[1] // day for k in last if k[0] == s]
        for d in range(min(own), max(own) + 1):
            date = datetime.fromtimestamp(d * 86_400, UTC).date()
            days.add((s, date))
            for n in (7, 30):
                inside = [v for k, v in last.items() if k[0] == s and d - n < k[1] // day <= d]
                closes = [c for _, _, c in inside if c is not None]
                x = got[s, date]
                assert x[f"volume_{n}"] == pytest.approx(sum(v for _, v, _ in inside))
                assert x[f"close_n_{n}"] == len(closes)
                assert x[f"close_avg_{n}"] == (pytest.approx(sum(closes) / len(closes)) if closes else None)
    assert set(got) == days
    assert trailing.trailing_totals(df.limit(0), "sym", "start", "id", "volume", "close").count() == 0


# --- timestamps ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def book() -> StampParser:
    ny, berlin = ZoneTable.build("America/New_York"), ZoneTable.build("Europe/Berlin")
    return StampParser({"NY": Place(ny, False), "BE": Place(berlin, True), "NO": Place(None, None)}, {"EST": -18000, "EDT": -14400, "CET": 3600, "CEST": 7200, "HKT": 28800})


@pytest.mark.parametrize(
    "text,code,expected",
    [
        ("2021-07-01 12:00:00", "NY", "2021-07-01T16:00:00"),
        ("2021-01-01 12:00", "NY", "2021-01-01T17:00:00"),
        ("2021-07-01T12:00:00Z", "NO", "2021-07-01T12:00:00"),
        ("2021-07-01T12:00:00.123999Z", None, "2021-07-01T12:00:00.123"),
        ("2021-07-01 12:00:00.9+0530", "NY", "2021-07-01T06:30:00.900"),
        ("2021-07-01  12:00:00 -05:00", "NY", "2021-07-01T17:00:00"),
        ("2021-07-01 12:00:00 EST", "BE", "2021-07-01T17:00:00"),
        ("2021-07-01 12:00:00 utc", "BE", "2021-07-01T12:00:00"),
        ("3/4/2021 1:05 PM", "NY", "2021-03-04T18:05:00"),
        ("3/4/2021 1:05 PM", "BE", "2021-04-03T11:05:00"),
        ("12/31/20 12:30:00 AM", "NY", "2020-12-31T05:30:00"),
        ("12/31/20 12:30:00 AM", "BE", None),
        ("01.02.2021 03:04:05", "NY", "2021-02-01T08:04:05"),
        ("20210704T120000Z", "NY", "2021-07-04T12:00:00"),
        ("20210704 120000", "BE", "2021-07-04T10:00:00"),
        ("4 Jul 2021 12:00 HKT", "NY", "2021-07-04T04:00:00"),
        ("4 July 2021 12:00", "BE", "2021-07-04T10:00:00"),
        ("Jul 4, 2021 9:30:00 PM", "BE", "2021-07-04T19:30:00"),
        ("1625140800", "NO", "2021-07-01T12:00:00"),
        ("1625140800123", "NO", "2021-07-01T12:00:00.123"),
        ("1625140800.9876", "NO", "2021-07-01T12:00:00.987"),
        # clocks go forward: the hour does not exist; back: the earlier instant counts
        ("2021-03-14 02:30:00", "NY", None),
        ("2021-11-07 01:30:00", "NY", "2021-11-07T05:30:00"),
        ("2021-10-31 02:30:00", "BE", "2021-10-31T00:30:00"),
        ("2021-11-07 01:30:00 EST", "NY", "2021-11-07T06:30:00"),
        ("2021-06-31 10:00:00", "NY", None),
        ("2021-02-29 10:00:00", "NY", None),
        ("2021-13-01 10:00:00", "NY", None),
        ("2021-01-01 24:00:00", "NY", None),
        ("13:45:00", "NY", None),
        ("2020-11", "NY", None),
        ("2020-11-05", "NY", None),
        ("13:05:00 PM", "NY", None),
        ("1/2/2021 13:05:00 PM", "NY", None),
        ("2021-07-01 12:00:00 XYZ", "NY", None),
        ("2021-07-01x12:00:00", "NY", None),
        ("2021-07-01 12:00:00", "NO", None),
        ("2021-07-01 12:00:00", None, None),
        ("pending", "NY", None),
        ("", "NY", None),
        (None, "NY", None),
        ("9" * 200_000, "NY", None),
    ],
)
def test_stamp(book, text, code, expected):
    got = book(pa.array([text], pa.string()), pa.array([code], pa.string())).to_pylist()[0]
    want = None if expected is None else int(np.datetime64(expected, "ms").astype(np.int64))
    assert got == want


def test_zone_tables_follow_the_database():
    from zoneinfo import ZoneInfo

    for name in ("America/New_York", "Australia/Sydney", "Asia/Kolkata", "Asia/Tokyo"):
        z, info = ZoneTable.build(name), ZoneInfo(name)
        times = np.arange(0, 2_000_000_000, 7_654_321)
        want = [int(datetime.fromtimestamp(int(t), info).utcoffset().total_seconds()) for t in times]
        assert z.offset_at(times).tolist() == want
        assert z.version not in ("", "unknown")


def test_epoch_units(spark):
    v = [1_704_067_200, 1_704_067_200_125, 1_704_067_200_125_999, 1_704_067_200_125_999_999, 0, None, -5, 12]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    c = F.col("v")
    got = df.select(normalise_time.epoch_unit(c), normalise_time.epoch_seconds(c), normalise_time.epoch_millis(c)).collect()
    ms = 1_704_067_200_125
    assert [tuple(r) for r in got] == [(1, ms // 1000, ms // 1000 * 1000), (1000, ms // 1000, ms), (10**6, ms // 1000, ms), (10**9, ms // 1000, ms), *[(None,) * 3] * 4]


# --- attributes as known at event time ----------------------------------------------------


@pytest.mark.parametrize("bucket,rows", [(10, 7), (1000, 40), (60_000, 100_000)])
def test_known_at(spark, bucket, rows):
    r = random.Random(6)
    events = [(i, r.choice(["usd", " USD", "EUR", None, "GBP", ""]), r.choice([None, *range(100)])) for i in range(200)]
    versions = [(i, r.choice(["USD", "eur ", None, ""]), r.choice([None, *range(90)]), r.choice([None, *range(120)]), r.choice([None, 1.0, 2.0])) for i in range(150)]
    e = spark.createDataFrame(events, "id long, k string, at long").withColumn("key", F.lit("clash")).withColumn("value", F.lit(1))
    v = spark.createDataFrame(versions, "vid long, k string, valid long, known long, x double").withColumn("span", F.lit(0))
    args = dict(event_id="id", event_key="k", event_ms="at", version_id="vid", version_key="k", valid_ms="valid", known_ms="known", value="x", bucket_ms=bucket, span_rows=rows)
    got = {(x.id, x.vid, x.x) for x in known_at.known_at(e, v, **args).collect()}
    code = lambda s: s.strip().upper()
    want = set()
    for i, k, at in events:
        fit = [(a, b, n, x) for n, kk, a, b, x in versions if None not in (k, kk, a, b, x, at) and code(k) == code(kk) and a <= at and b <= at]
        if fit:
            want.add((i, *max(fit)[2:]))
    assert got == want
    assert known_at.known_at(e.limit(0), v, **args).count() == 0
    assert known_at.known_at(e, v.limit(0), **args).count() == 0
    assert known_at.known_at(e.union(e), v, **args).count() == 2 * len(want)


def test_known_at_is_cut_by_density(spark):
    """One outlying time and one instant with half of all events: no part holds more than twice what it should."""
    events = spark.range(20_000).selectExpr("id as event_id", "'USD' as key", "case when id = 0 then 4102444800000 when id % 2 = 0 then 500000000 else id * 50000 end as at")
    versions = spark.range(400).selectExpr("'USD' as key", "id * 2500000 as valid", "id * 2500000 + 7 as known", "id as version", "1.0D as value", "id * 2500000 + 7 as since")
    e, v = known_at._parted(events, versions, 500, 60_000)
    sizes = [r["count"] for r in e.groupBy("key", "span", "part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000
    assert v.groupBy("key", "span", "part").count().agg(F.max("count")).first()[0] <= 1000
    args = dict(event_id="event_id", event_key="key", event_ms="at", version_id="version", version_key="key", valid_ms="valid", known_ms="known", value="value")
    cut, whole = (known_at.known_at(events, versions.drop("since"), **args, **more) for more in ({"span_rows": 500}, {}))
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


# --- dense table of bars --------------------------------------------------------------------


def test_dense_bars_in_every_form(spark, small, tmp_path):
    """Against brute force: each bar is kept whose start names an instant, in whatever form."""
    h, at = 3_600_000, 1_435_795_200_000  # 2015-07-02 00:00 UTC
    starts = [
        ("2015-07-02 01:30:00 UTC", at + h * 3 // 2), ("2015-07-02T03:00:00Z", at + 3 * h), (str((at + 4 * h) // 1000), at + 4 * h),
        (str(at + 5 * h), at + 5 * h), ("2015-07-02 2:00:00 PM HKT", at + 6 * h), ("02/07/2015 07:00 UTC", at + 7 * h), ("2015-07-02T09:30:00+08:00", at + h * 3 // 2),
        ("2 Jul 2015 10:00:00 +0800", at + 2 * h), ("n/a", None), ("2015-07", None), ("2015-02-30 01:30:00 UTC", None), (None, None),
    ]
    rows = [(i, "AB"[i % 2], text, float(i), 10 * i) for i, (text, _) in enumerate(starts)] + [(90, None, "2015-07-02T08:00:00Z", 1.0, 1), (91, "A", "2015-07-02T08:00:00Z", None, 1)]
    spark.createDataFrame(rows, "hk_id long, symbol string, bar_start_utc string, close double, volume long").write.parquet(f"{tmp_path}/hk_stocks.parquet")
    spark.read.parquet(f"{small}/exchanges.parquet").write.parquet(f"{tmp_path}/exchanges.parquet")
    bars: dict[tuple, tuple] = {}
    for i, (_, ms) in enumerate(starts):
        if ms is not None:
            end = ms + (h // 2 if ms % (24 * h) // h == 1 else h)
            bars["AB"[i % 2], end] = max(bars.get(("AB"[i % 2], end), (-1, 0)), (i, 10 * i))
    want = set()
    for s in "AB":
        for end in {e for _, e in bars}:
            if seen := [(e, *bars[k, e]) for k, e in bars if k == s and e <= end]:
                last, i, volume = max(seen)
                want.add((s, end, float(i), volume if last == end else 0))
    got = market.dense_bars_all(spark, str(tmp_path)).select("symbol", "bar", "close", "volume")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert market.dense_bars(spark, str(tmp_path)).count() == 1


def _broadcast_rows(plan) -> list[int]:
    """The rows of each table that a plan that has run built in the driver."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _broadcast_rows(plan.executedPlan() if kind.startswith("Adaptive") else plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for i in range(plan.children().size()) for n in _broadcast_rows(plan.children().apply(i))]


def test_dense_bars_broadcast_no_spans(spark, tmp_path):
    """What Spark takes for a few rows of (symbol, first bar) stood for one row a day up to the last bar
    of any symbol, and was built in the driver."""
    days = [np.datetime64("1990-01-01") + 27 * i for i in range(400)]
    rows = [(i, f"s{i % 3}", f"{day} 03:00:00 UTC", float(i), i) for i, day in enumerate(days)]
    spark.createDataFrame(rows, "hk_id long, symbol string, bar_start_utc string, close double, volume long").write.parquet(f"{tmp_path}/hk_stocks.parquet")
    got = market.dense_bars(spark, str(tmp_path))
    assert len(got.collect()) == 400 + 399 + 398
    assert max(_broadcast_rows(got._jdf.queryExecution().executedPlan()), default=0) <= 400


def test_dense_bars_all_broadcast_no_spans(spark, small, tmp_path):
    """The same with starts in two forms, of which dense_bars reads one."""
    days = [np.datetime64("1990-01-01") + 27 * i for i in range(400)]
    rows = [(i, f"s{i % 3}", f"{day} 03:00:00 UTC" if i % 2 else f"{day}T03:00:00Z", float(i), i) for i, day in enumerate(days)]
    spark.createDataFrame(rows, "hk_id long, symbol string, bar_start_utc string, close double, volume long").write.parquet(f"{tmp_path}/hk_stocks.parquet")
    spark.read.parquet(f"{small}/exchanges.parquet").write.parquet(f"{tmp_path}/exchanges.parquet")
    got = market.dense_bars_all(spark, str(tmp_path))
    assert len(got.collect()) == 400 + 399 + 398
    assert max(_broadcast_rows(got._jdf.queryExecution().executedPlan()), default=0) <= 400


def _operators(plan) -> list:
    """All operators of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _operators(plan.executedPlan() if kind.startswith("Adaptive") else plan.plan())
    return [plan] + [x for i in range(plan.children().size()) for x in _operators(plan.children().apply(i))]


def test_dense_bars_all_sends_python_each_odd_stamp_once(spark, small, tmp_path, monkeypatch):
    """Python workers, which count as the driver's memory where all runs in one process, saw every row."""
    forms = ["2021-03-04 03:00:00 UTC", "2021-03-05 03:00:00 UTC", "2021-03-06T03:00:00Z", "1615086000", "n/a", None]
    rows = [(i, f"s{i % 5}", forms[i % 6], float(i), i) for i in range(300)]
    spark.createDataFrame(rows, "hk_id long, symbol string, bar_start_utc string, close double, volume long").write.parquet(f"{tmp_path}/hk_stocks.parquet")
    spark.read.parquet(f"{small}/exchanges.parquet").write.parquet(f"{tmp_path}/exchanges.parquet")
    seen, whole = [], tables.dense_latest
    monkeypatch.setattr(tables, "dense_latest", lambda readings, *a: seen.append(readings) or whole(readings, *a))
    got = market.dense_bars_all(spark, str(tmp_path))
    assert len(got.collect()) == 5 * 4
    assert len(seen[0].collect()) == 200
    python = [x for x in _operators(seen[0]._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "ArrowEvalPythonExec"]
    assert [x.metrics().get("pythonNumRowsReceived").get().value() for x in python] == [3]
    # the spans, of which there is one for each reading and block at least, are not sorted to be joined with the blocks
    joins = [k for x in _operators(got._jdf.queryExecution().executedPlan()) if "Join" in (k := x.getClass().getSimpleName())]
    assert joins[0] == "ShuffledHashJoinExec"


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_with_utc_millis_reads_as_utc_millis(spark, zone):
    texts = ["2021-03-04 05:06:07 UTC", "2021-02-30 00:00:00 UTC", "2021-13-01 00:00:00 UTC", "2021-01-01 24:00:00 UTC", "2021-01-01 00:60:00 UTC", "2021-01-01 00:00:60 UTC",
             "0000-01-01 00:00:00 UTC", "0001-01-01 00:00:00 UTC", "1582-10-10 00:00:00 UTC", "1900-02-29 00:00:00 UTC", "9999-12-31 23:59:59 UTC", "2021-03-04 05:06:07 utc", " 2021-03-04  05:06:07 UTC",
             "2021-03-04 05:06:07 UTC\n", "2021-03-04 05:06:07 UTC x", "2021-03-04 05:06:07", "2021-03-04T05:06:07+08:00", "2021-3-4 05:06:07 UTC", "1614999600", "", None, "n/a"]
    rows = [(i, texts[i % len(texts)]) for i in range(3 * len(texts))]
    parser = StampParser({"X": Place(ZoneTable.build("America/New_York"), None)}, {})
    df = spark.createDataFrame(rows, "n long, t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = normalise_time.with_utc_millis(df, parser, "t", "X", "ms")
        want = df.withColumn("ms", normalise_time.utc_millis(parser, F.col("t"), F.lit("X"))).where("ms is not null")
        assert got.columns == ["n", "t", "ms"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("block", [1, 4, 256])
def test_dense_latest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tables, "BLOCK", block)
    rng = random.Random(block)
    rows = [(n, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-40, 40)]), rng.choice([None, n])) for n in range(60)]
    rows += [(60, "late", 39, 1), (61, "a", -40, None), (62, "a", -40, 5), (63, "a", -40, None)]
    readings = spark.createDataFrame(rows, "n long, k string, t long, v long")
    got = tables.dense_latest(readings, "k", "t", "n", ["v"])
    assert got.columns == ["k", "bar", "since", "v"]
    seen = [r for r in rows if r[1] is not None and r[2] is not None]
    want = []
    for k in {r[1] for r in seen}:
        for bar in {r[2] for r in seen}:
            if before := [(t, n, v) for n, key, t, v in seen if key == k and t <= bar]:
                t, _, v = max(before, key=lambda x: x[:2])
                want.append((k, bar, t, v))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tables.dense_latest(readings.where("false"), "k", "t", "n", ["v"]).collect() == []
