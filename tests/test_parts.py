"""Names, times, sources and sinks, tables, the command line, orchestration, and streams."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import cli
from tidemark.functions import duration as D
from tidemark.functions import naming
from tidemark.operators import tables
from tidemark.plans import orchestrate as O
from tidemark.plans.graph import Source
from tidemark.plans.lower import Engine
from tidemark.sources import io, validators
from tidemark.streaming import live

EVENTS = Source("events", "ts", "id")
GRAPH = EVENTS.map("id", "k").key_by("k").post_lookup(EVENTS.map("id", "k").key_by("k").count("n"))


# --- names --------------------------------------------------------------------------------


@pytest.mark.parametrize("name,snake", [("rthOnly", "rth_only"), ("mins10", "mins_10"), ("v60lin", "v_60_lin"), ("leftFoo", "left_foo"), ("a_b", "a_b"), ("x", "x"), ("_symbol", "_symbol")])
def test_snake_case(name, snake):
    assert naming.snake_case(name) == snake


def test_flatten_and_unique_names(spark):
    inner = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("str", T.StringType())])
    df = spark.createDataFrame([((1, "a"), None)], T.StructType([T.StructField("leftFoo", inner), T.StructField("rightFoo", inner)]))
    flat = naming.flatten(df)
    assert flat.columns == ["left_foo.x", "left_foo.str", "right_foo.x", "right_foo.str"]
    assert tuple(flat.first()) == (1, "a", None, None)
    assert naming.unique_names(["value", "value", "a"]) == ["value0", "value1", "a"]


def test_cell_parsers(spark):
    df = spark.createDataFrame([("true",), ("FALSE",), (None,)], "s string")
    assert [r[0] for r in df.select(naming.parse_bool(F.col("s"))).collect()] == [True, False, None]
    for bad in (naming.parse_bool(F.lit("yes")), naming.parse_char(F.lit("ab")), naming.literal(F.lit("a"), "b")):
        with pytest.raises(Exception, match="not"):
            df.select(bad).collect()
    both = df.select(naming.either({"l": F.lit(None).cast("int"), "r": F.lit("foo")}).alias("e")).first()["e"]
    assert (both["tag"], both["l"], both["r"]) == ("r", None, "foo")


# --- time ---------------------------------------------------------------------------------


def test_durations():
    assert D.YEAR.ms == 31_557_600_000 and D.QUARTER.ms * 4 == D.YEAR.ms and D.MONTH.ms * 12 == D.YEAR.ms
    assert D.parse_duration("3days") == D.DAY * 3 and D.parse_duration("250 ms").ms == 250
    assert D.INFINITE > D.YEAR and D.INFINITE + D.DAY == D.INFINITE and D.DAY * 10**15 == D.INFINITE and D.ZERO * 5 == D.ZERO
    assert D.plus(5, D.INFINITE) == D.LONG_MAX and D.minus(5, D.INFINITE) == D.LONG_MIN and D.plus(D.LONG_MAX - 1, D.DAY) == D.LONG_MAX
    for bad in ("", "5", "h", "-1h", "3 parsecs"):
        with pytest.raises(ValueError):
            D.parse_duration(bad)


def test_time_columns(spark):
    at = [-1, 0, 1_704_189_723_456]
    df = spark.createDataFrame([(x,) for x in at], "t long")
    t = F.col("t")
    got = df.select(D.bucket(t, "1d"), D.remainder(t, "1d"), D.unix_day_of_week(t), D.unix_hour_of_day(t), D.unix_minute_of_day(t)).collect()
    day = 86_400_000
    assert [tuple(r) for r in got] == [(x // day, x % day, x % (7 * day) // day, x % day // 3_600_000, x % day // 60_000) for x in at]


def test_validators(spark):
    df = spark.createDataFrame([("2021-07-01 12:00:00", "1625140800", 7)], "s string, e string, ms long")
    ny = validators.parse_and_shift("yyyy-MM-dd HH:mm:ss", "America/New_York", "s", "1min")
    got = df.select(ny(), validators.parse_utc("yyyy-MM-dd HH:mm:ss", "s")(), validators.from_epoch_seconds_text("e")(), validators.shift_later(validators.pure("ms"), 3)()).first()
    assert tuple(got) == (1625155260000, 1625140800000, 1625140800000, 10)
    for bad in (validators.from_epoch_seconds_text("s"), validators.parse_utc("yyyy", "e"), validators.pure("nothing")):
        with pytest.raises(Exception):  # noqa: B017
            df.withColumn("nothing", F.lit(None)).select(bad()).collect()


# --- sources and sinks --------------------------------------------------------------------


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1, None), (2, 'q"x', 1e-300, True)], "id int, s string, d double, b boolean")
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):  # noqa: B017
        io.read_csv(spark, str(tmp_path / "out"), "id int, s int, d double, b boolean").collect()


def test_csv_is_read_by_position_and_skips_blank_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("any,names\n1,2\n\n3,4\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int").collect()] == [(1, 2), (3, 4)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    assert [tuple(r) for r in io.read_json_array(spark, str(tmp_path / "a.json"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    io.write_json(spark.range(3), str(tmp_path / "lines"))
    assert io.read(spark, str(tmp_path / "lines"), "json", "id long").count() == 3


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ticker_D_F/DBX_2000_2009.txt", "l1\nl2\n")
        z.writestr("readme.md", "x")
    rows = io.read_zip_members(spark, str(tmp_path / "*.zip"), r"\.txt$").select("line_no", "line", *io.member_symbol())
    assert sorted(map(tuple, rows.collect())) == [(0, "l1", "DBX", 2000), (1, "l2", "DBX", 2000)]


def test_reshard_and_tap(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    io.reshard(df, str(tmp_path / "parts"), ["k"])
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == ["k=0", "k=1", "k=2"]
    assert io.tap(df, str(tmp_path / "tap")).count() == 100


def test_inputs_merge(spark):
    one, two = io.Inputs(a=spark.range(2)), io.Inputs(a=spark.range(3), b=spark.range(1))
    bound = one.combine(two).bound()
    assert bound["a"].count() == 5 and bound["b"].count() == 1
    assert io.empty(spark, "a int").count() == 0


def test_staging_on_a_cluster_needs_a_shared_folder():
    """A session that is not local and names no folder is an error, and clearing it is not."""
    from types import SimpleNamespace

    from tidemark.session import clear_stages, shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Folder:
        def __init__(self, name):
            self.name = name

        def isDefined(self):  # noqa: N802
            return self.name is not None

        def get(self):
            return self.name

    def session(master, folder=None, **conf):
        java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: Folder(folder)))
        return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, _jsc=java, applicationId="a"), _jvm=None)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,4,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("yarn", "hdfs://x/shared")) == "hdfs://x/shared"
    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "s3a://b/c"})) == "s3a://b/c"
    assert "tidemark-" in shared_dir(session("local[4]"))


def test_staged_tables_lie_in_the_shared_folder(spark):
    from pathlib import Path

    from tidemark.session import clear_stages, shared_dir, stage

    df = stage(spark.range(5), "numbers")
    folder = Path(shared_dir(spark)) / "tidemark" / spark.sparkContext.applicationId
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir") and list(folder.glob("numbers-*"))
    assert df.count() == 5
    clear_stages(spark)
    assert not folder.exists()


# --- tables -------------------------------------------------------------------------------


def test_diff_and_positions(spark):
    a = spark.createDataFrame([(i, f"v{i}", None) for i in range(50)], "id int, v string, n int")
    b = a.withColumn("v", F.when(F.col("id") % 10 == 3, "other").otherwise(F.col("v"))).where("id < 40")
    got = [tuple(r) for r in tables.diff_rows(a, b, ["id"]).orderBy("position").collect()]
    assert got == [(i, "v", f"v{i}", "other") for i in (3, 13, 23, 33)]
    assert tables.diff_rows(a, b, ["id"], limit_in=10).count() == 1 and tables.diff_rows(a, b, ["id"], limit=2).count() == 2
    assert [r["position"] for r in tables.with_position(a.repartition(7), "id").orderBy("id").collect()] == list(range(50))
    assert tables.with_position(a.limit(0), "id").count() == 0


def brute_balance(trades, initial, smallest, hold, release):
    cash, clock, out, seen = initial, None, [], [initial]
    for at, amount, profit in trades:
        stake = min(amount, cash)
        if enters := stake >= smallest:
            cash, clock = cash - stake, at
        until = at if release else clock
        due = [x for x in out if until is not None and x[0] <= until]
        cash += sum(x[1] for x in due)
        out = [x for x in out if x not in due]
        seen.append(cash)
        if enters:
            out.append((at + hold, stake + stake / amount * profit))
    for x in sorted(out):
        cash += x[1]
        seen.append(cash)
    return cash, max(seen), min(seen)


@pytest.mark.parametrize("release", [False, True])
def test_balances(spark, release):
    r = random.Random(8)
    rows = [(k, t * 10 + r.randint(0, 3), i, float(r.randint(50, 400)), r.uniform(-60, 60)) for k in ("a", "b") for i, t in enumerate(range(60))]
    df = spark.createDataFrame(rows, "k string, ts long, id int, amount double, profit double")
    for x in tables.balances(df, ["k"], "ts", "id", "amount", "profit", 1000.0, 60.0, hold_ms=55, release_when_rejected=release).collect():
        want = brute_balance([(t, a, p) for k, t, _, a, p in sorted(rows, key=lambda z: (z[0], z[1], z[2])) if k == x["k"]], 1000.0, 60.0, 55, release)
        assert (x["last"], x["high"], x["low"]) == pytest.approx(want)
    assert tables.balances(df.limit(0), ["k"], "ts", "id", "amount", "profit", 1.0, 1.0).count() == 0


# --- command line -------------------------------------------------------------------------


def test_cli(spark, tmp_path, capsys):
    df = spark.createDataFrame([(3, 30, "a"), (1, 10, "a"), (2, 20, "b")], "id long, ts long, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    assert cli.main(["run", "tests.test_parts:GRAPH", "--input", f"events={tmp_path}/events", "--output", f"{tmp_path}/out", "--format", "parquet", "--logevery", "2", "--exclusive_upper_ms", "25"]) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("a", 1, 1), ("b", 2, 1)]
    cli.main(["show", "tests.test_parts:GRAPH"])
    assert "source events: offsets 0ms" in (said := capsys.readouterr().out) and "lookups: 1" in said
    cli.main(["sort", "--input", f"x={tmp_path}/events", "--ts", "ts", "--output", f"{tmp_path}/sorted"])
    assert [r["id"] for r in spark.read.csv(f"{tmp_path}/sorted/x", header=True, schema="id long, ts long, k string").collect()] == [1, 2, 3]
    df.withColumn("k", F.lit("a")).write.parquet(str(tmp_path / "other"))
    capsys.readouterr()
    cli.main(["diff", f"{tmp_path}/events", f"{tmp_path}/other", "--order", "id"])
    assert capsys.readouterr().out.strip() == "1 k: b | a"


def test_cli_needs_an_output_and_pairs(spark):
    with pytest.raises(SystemExit):
        cli.main(["run", "tests.test_parts:GRAPH", "--input", "nonsense"])


# --- orchestration ------------------------------------------------------------------------


def programs(r: random.Random, depth: int) -> O.Program:
    kind = r.choice(["call", "identity", "const"] if not depth else ["call", "compose", "fanout", "compose", "const"])
    if kind == "compose":
        return O.Compose(programs(r, depth - 1), programs(r, depth - 1))
    if kind == "fanout":
        parts = tuple(programs(r, depth - 1) for _ in range(r.randint(0, 3)))
        after = O.Parallel(tuple(programs(r, depth - 1) for _ in parts))
        return O.Fanout(parts).then(after)
    return O.Call(r.choice("fg")) if kind == "call" else O.Identity() if kind == "identity" else O.Const.of(r.randint(0, 9))


def test_orchestration():
    runner = O.Runner({"f": lambda x: [x, 1], "g": lambda x: {"g": x}})

    def plain(p, v):
        match p:
            case O.Compose(first=a, second=b):
                return plain(b, plain(a, v))
            case O.Fanout(parts=parts):
                return [plain(x, v) for x in parts]
            case O.Parallel(parts=parts):
                return [plain(x, y) for x, y in zip(parts, v, strict=True)]
            case O.Call(name=name):
                return runner.functions[name](v)
            case O.Const(text=text):
                return json.loads(text)
        return v

    r = random.Random(5)
    for _ in range(200):
        p = programs(r, 4)
        assert O.from_json(json.loads(json.dumps(p.to_json()))) == p
        assert runner.run(p, 7) == plain(p, 7)
        assert O.calls(O.optimize(p)) == O.calls(p)
    with pytest.raises(KeyError):
        runner.run(O.Call("nothing"), 1)
    left = [2]

    def shaky(x):
        left[0] -= 1
        if left[0] >= 0:
            raise ConnectionError
        return x

    assert O.Runner({"s": shaky}).run(O.Call("s"), 1) == 1


# --- streams ------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(7)
    rows = sorted((r.randint(0, 100_000), i, r.choice("ab"), float(r.randint(0, 9))) for i in range(300))
    schema = "t long, id long, k string, v double"
    for n, cut in enumerate((rows[:100], rows[100:200], rows[200:], [(10_000_000, 999, "a", 0.0), (10_000_000, 999, "b", 0.0)])):
        r.shuffle(cut)
        spark.createDataFrame(cut, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def out(df, name):
        q = live.write_once(df, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name))

    add = lambda a, b: a + b
    batch = spark.createDataFrame(rows, schema)
    src = Source("s", "t", "id")
    from tidemark.functions import monoids as M

    k = src.map("id", "k", "v").key_by("k")
    want = Engine(spark, {"s": batch}).run(k.pre_lookup(k.sum(b=M.Sum("v"))).post_lookup(k.sum(a=M.Sum("v"))).values("k", "id", "b", "a"))
    got = out(live.running(stream, ["k"], "t", "id", "v", 0.0, add, "50s"), "run").where("ord < 999").select("k", "ord", "before", "after")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    from tidemark.plans.graph import Label

    want = Engine(spark, {"s": batch}).run(k.labeled(Label.of(k.sum(a=M.Sum("v"))).look_forward("5s")).map("k", "id", "a"))
    got = out(live.running(stream, ["k"], "t", "id", "v", 0.0, add, "50s", "5s"), "label").where("ord < 999").select("k", "ord", "after")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    bars = out(live.candles(stream, "k", "t", "id", "v", "v", "10s", "50s"), "bars").where("start_ms < 200000")
    want = batch.groupBy("k", (F.floor(F.col("t") / 10_000) * 10_000).alias("start_ms")).agg(F.min_by("v", F.struct("t", "id")), F.max("v"), F.min("v"), F.max_by("v", F.struct("t", "id")), F.sum("v"), F.count("*"))
    assert sorted(tuple(x)[:8] for x in bars.drop("batch").collect()) == sorted(map(tuple, want.collect()))


def test_late_rows_are_counted(spark, tmp_path):
    """Rows behind the watermark change no state, and the query's progress tells how many there were."""
    schema = "t long, id long, k string, v double"
    for n, row in enumerate(((100_000, 1, "a", 1.0), (900_000, 2, "a", 1.0), (900_001, 4, "a", 1.0), (5, 3, "a", 1.0), (9_000_000, 9, "a", 1.0))):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.write_once(live.running(stream, ["k"], "t", "id", "v", 0.0, lambda a, b: a + b, "50s"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts_ms").select("ord", "before", "after").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 1.0), (2, 1.0, 2.0), (4, 2.0, 3.0)]
    assert live.dropped(query) == 1


# --- databases ------------------------------------------------------------------------------


def test_queries_of_a_database_are_read_in_parts(spark):
    """A semi-join inside the database, and a query that is read by four tasks."""
    url, driver = "jdbc:derby:memory:tidemark;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(1000).selectExpr("id", "id % 7 as k", "if(id = 5, null, id * 1.5D) as v")
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "rows_").mode("overwrite").save()
    some = io.read_query(spark, url, 'select "id", "v" from rows_ where "k" in (select "k" from rows_ where "id" < 2)', driver=driver)
    assert {r["id"] for r in some.collect()} == {i for i in range(1000) if i % 7 in (0, 1)}
    parts = io.read_query(spark, url, 'select "id", "v" from rows_', driver=driver, partitionColumn="id", lowerBound="0", upperBound="1000", numPartitions="4")
    assert parts.rdd.getNumPartitions() == 4
    assert {(r["id"], r["v"]) for r in parts.collect()} == {(i, None if i == 5 else i * 1.5) for i in range(1000)}
