import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weirflow.functions import lineage as L
from weirflow.operators import dataflow as O
from weirflow.operators import timing as T
from weirflow.operators.numbering import number, ranged, running
from weirflow.plans import registry
from weirflow.plans.flow import FlowBuilder


def ticks(spark, channel, n, start=0, **columns):
    return O.generate(spark, channel, n, 1000, **columns).withColumn("arrival", F.col("seq") + start)


def test_numbering_over_many_buckets(spark):
    rows = [(random.Random(i).randrange(1000), i, "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "t long, i long, k string")
    got = {(r.t, r.i): r.seq for r in number(df, ["t", "i"], ranges=7).collect()}
    assert got == {x[:2]: n for n, x in enumerate(sorted(rows))}
    by = {r.i: (r.seq, r.s, r.m) for r in running(df, ["t", "i"], {"s": ("sum", "t"), "m": ("max", "i")}, by=["k"], ranges=7).collect()}
    for k in "ab":
        s, m = 0, -1
        for n, (t, i, _) in enumerate(x for x in sorted(rows) if x[2] == k):
            s, m = s + t, max(m, i)
            assert by[i] == (n, s, m)


def test_numbering_of_nothing(spark):
    assert number(spark.createDataFrame([], "t long"), ["t"]).columns == ["t", "seq"]
    assert number(spark.createDataFrame([], "t long"), ["t"]).count() == 0


def test_map_chain_and_describe(spark):
    f = FlowBuilder("demo")
    f.source("ticks", lambda s: s.range(5).select((F.col("id") * 1000).alias("ts_ns"), F.col("id").alias("tick"))).map(v=F.col("tick") * 2).map(v=F.col("v") + 0.5).sink()
    flow = f.build()
    assert flow.describe() == "flow demo: src[demo/ticks] map[demo/ticks -> demo/~0] map[demo/~0 -> demo/~1] sink[demo/~1]"
    rows = flow.lower(spark)["demo/~1"].select("seq", "v", L.describe("lineage").alias("l")).collect()
    assert {(r.seq, float(r.v), r.l) for r in rows} == {(i, 2 * i + 0.5, f"demo/ticks#{i} -> demo/~0#{i} -> demo/~1#{i}") for i in range(5)}


def test_op_init_and_handle(spark):
    out = O.op(ticks(spark, "bx/ticks", 2, tick=F.col("seq")), "bx/out", F.array(F.struct("tick")), F.array(F.struct(F.lit(-1).cast("bigint").alias("tick"))))
    got = [r.l for r in out.orderBy("seq").select(L.describe("lineage").alias("l")).collect()]
    assert got[:2] == ["bx/out#0", "bx/ticks#0 -> bx/out#1"]


def test_zip_is_positional(spark):
    a = ticks(spark, "a", 3, t=F.col("seq"))
    b = ticks(spark, "b", 2, start=100, t=F.col("seq") * 10)
    rows = O.zip_join(a, b, "j", lambda x, y: {"fast": x("t"), "slow": y("t")}).collect()
    assert {(r.fast, r.slow) for r in rows} == {(0, 0), (1, 10)}
    assert not O.overflows(a, b)
    assert O.overflows(ticks(spark, "a", 40), b)


def simulate(sides, depth):
    queues, counts, pairs = (deque(), deque()), [0, 0], []
    for s in sides:
        queues[s].append(counts[s])
        counts[s] += 1
        if len(queues[s]) > depth:
            queues[s].popleft()
        if all(queues):
            pairs.append((queues[0].popleft(), queues[1].popleft()))
    return pairs


@pytest.mark.parametrize("depth", [1, 16])
def test_queues_drop_oldest(spark, depth):
    r = random.Random(depth)
    runs = {k: [int(r.random() < 0.3 + 0.1 * k) for _ in range(150)] for k in range(4)}
    df = spark.createDataFrame([(k, i, s) for k, v in runs.items() for i, s in enumerate(v)], "k long, at long, side long")
    got = O.zip_with_queues(df, ["k"], "side", ["at"], depth).collect()
    for k, sides in runs.items():
        mine = sorted((x.pair, x.a, x.b) for x in got if x.k == k)
        assert [(a, b) for _, a, b in mine] == simulate(sides, depth)


def test_span_join_golden(spark):
    imu = O.generate(spark, "sp/imu", 41, 1000, t=F.col("seq")).withColumn("ts_ns", F.col("t"))
    lidar = spark.createDataFrame([(0, 41, 1), (1, 42, 2)], "seq long, arrival long, t long").withColumn("ts_ns", F.col("t")).withColumn("lineage", L.rooted("sp/lidar", "seq"))
    s = O.span_join(lidar, imu, "sp/~0", "sp/imu", (20 * F.col("t") - 18, 20 * F.col("t")), 20)
    got = {r.seq: (r.n, r.l) for r in s.select("seq", F.size("items").alias("n"), L.describe("lineage").alias("l")).collect()}
    assert got == {0: (19, "sp/lidar#0 -> sp/~0#0 | sp/imu#2..#20 -> sp/~0#0"), 1: (19, "sp/lidar#1 -> sp/~0#1 | sp/imu#22..#40 -> sp/~0#1")}
    far = O.span_join(lidar, imu, "sp/~0", "sp/imu", (F.col("t") + 100, F.col("t") + 200), 100)
    assert {(r.n, r.l) for r in far.select(F.size("items").alias("n"), L.describe("lineage").alias("l")).collect()} == {(0, "sp/lidar#0 -> sp/~0#0"), (0, "sp/lidar#1 -> sp/~0#1")}


def test_bounded_span_sees_last_64(spark):
    data = O.generate(spark, "d", 100, 1000, t=F.col("seq")).withColumn("ts_ns", F.col("t"))
    trig = spark.createDataFrame([(0, 100, 0, 99), (1, 101, 90, 95)], "seq long, arrival long, a long, b long").withColumn("ts_ns", F.col("b")).withColumn("lineage", L.rooted("t", "seq"))
    s = O.span_join(trig, data, "o", "d", (F.col("a"), F.col("b")), 50, history=64)
    assert {(r.seq, r.n, r.seq_lo, r.seq_hi, r.truncated) for r in s.withColumn("n", F.size("items")).collect()} == {(0, 64, 36, 99, True), (1, 6, 90, 95, False)}


FOLDS = {"n": ("sum", "one"), "total": ("sum", "v")}


def test_fold_and_recovery(spark):
    rows = O.generate(spark, "ev", 100, 1000, v=(1 + F.col("seq") % 7).cast("double"), one=F.lit(1))
    out, state = O.stateful(rows, "out", "acc", FOLDS, {"n": F.col("n")})
    last = state.filter("seq = 99").select("n", "total", L.describe("lineage").alias("l")).first()
    assert (last.n, last.total, last.l) == (100, 395.0, "ev#99 -> acc#99")
    r = O.recover(rows, state, 59, FOLDS).first()
    assert (r.absorbed, r.replayed, r.n, r.total) == (59, 40, 100, 395.0)
    assert out.count() == 100


def test_history_keeps_64(spark):
    h = O.history(ticks(spark, "c", 80)).agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    assert tuple(h) == (64, 16, 79)


def test_several_producers_and_unknown_component(spark):
    f = FlowBuilder("m")
    f.tap("a").map_to("all", v=F.col("v"))
    f.tap("b").map_to("all", v=F.col("v"))
    given = {"m/a": ticks(spark, "m/a", 3, v=F.col("seq")).withColumn("arrival", F.col("seq") * 2), "m/b": ticks(spark, "m/b", 3, v=-F.col("seq")).withColumn("arrival", F.col("seq") * 2 + 1)}
    got = f.build().lower(spark, given)["m/all"].orderBy("seq").select("v", L.describe("lineage").alias("l")).collect()
    assert [r.v for r in got] == [0, 0, 1, -1, 2, -2]
    assert got[3].l == "m/b#1 -> m/all#3"
    assert not f.from_("nobody", f.tap("a"))


def test_loops_are_refused_and_fallback_is_checked(spark):
    f = FlowBuilder("l")
    f.tap("x").map_to("x", v=F.lit(1))
    with pytest.raises(ValueError, match="loop"):
        f.build().lower(spark)
    with pytest.raises(ValueError, match="fallback"):
        FlowBuilder("l").with_fallback("l").build()
    registry.flow("spare")(lambda: FlowBuilder("spare").build())
    assert FlowBuilder("l").with_fallback("spare").build().fallback == "spare"


def test_calibration_golden(spark):
    src = spark.range(10).select(F.lit("s/in").alias("channel"), F.col("id").alias("seq"), ((F.col("id") + 1) * 1_000_000).alias("ts_ns"), (F.col("id") * 2).alias("arrival"), L.rooted("s/in", "id").alias("lineage"))
    out = spark.range(10).select(F.lit("s/out").alias("channel"), F.col("id").alias("seq"), ((F.col("id") + 1) * 1_000_000 + 1000).alias("ts_ns"), (F.col("id") * 2 + 1).alias("arrival"), L.add_hop(L.rooted("s/in", "id"), "s/out", "id").alias("lineage"))
    c = T.calibrate(src.unionByName(out))
    r = c.first()
    assert (r.stage, r.n, r.p50_us, r.p99_us, r.p999_us, round(r.suggest_us, 9)) == ("s/out", 10, 1.0, 1.0, 1.0, 1.3)
    d = T.drift(c, spark.createDataFrame([("s/out", 1.0), ("x", 1.0)], "stage string, declared_us double"))
    assert {(x.stage, x.verdict) for x in d.collect()} == {("s/out", "OK"), ("x", "UNKNOWN")}


def test_percentile_rule(spark):
    df = spark.range(1, 11).select(F.lit("a").alias("k"), F.col("id").alias("v"))
    assert T.exact_percentiles(df, "k", "v", {"p": 0.5}).first().p == 6


def test_bucket_percentiles_and_misses(spark):
    df = spark.range(100).select(F.lit("e").alias("k"), F.lit(5000).alias("us"), F.lit(4000).alias("d"))
    assert T.misses(df, "k", "us", "d").first().misses == 100
    p = T.bucket_percentiles(T.histogram(df, "k", "us"), "k", {"p50": 0.5, "p99": 0.99}).first()
    assert (p.p50, p.p99) == (1000, 1000)


def test_rate_is_capped(spark):
    df = spark.range(400).select(F.lit("c").alias("k"), (F.col("id") * 5_000_000).alias("ts_ns"))
    r = T.rate_hz(df, "k").orderBy(F.desc("ts_ns")).first()
    assert (r.hz, r.shown_hz) == (201, 128)


def test_fusion_of_four(spark):
    rows = [ticks(spark, f"c{k}", 3 + k, v=F.col("seq") * k) for k in range(4)]
    out = O.zip_many(rows, "j", lambda a, b, c, d: {"v": a("v") + b("v") + c("v") + d("v")}).orderBy("seq")
    got = out.select("seq", "v", L.describe("lineage").alias("l")).collect()
    assert [(r.seq, r.v) for r in got] == [(0, 0), (1, 6), (2, 12)]
    assert got[1].l == " | ".join(f"c{k}#1 -> j#1" for k in range(4))
    with pytest.raises(ValueError):
        O.zip_many(rows[:1], "j", lambda a: {})


def test_component_files_become_flows(spark):
    from weirflow.plans import dagfile

    registry.component("Camera", 0)(lambda s: s.range(4).select((F.col("id") * 1000).alias("ts_ns"), F.col("id").alias("frame")))
    registry.component("Even", 1)(lambda df: df.filter("frame % 2 = 0"))
    f = dagfile.to_flow(dagfile.parse("[component cam]\ntype=Camera\ninterval_ms=50\n[component even]\ntype=Even\ninputs=cam"), "d")
    rows = f.build().lower(spark)["d/even"].orderBy("seq").select("seq", "frame", L.describe("lineage").alias("l")).collect()
    assert [(r.seq, r.frame, r.l) for r in rows] == [(0, 0, "d/cam#0 -> d/even#0"), (1, 2, "d/cam#2 -> d/even#1")]
    with pytest.raises(ValueError, match="no component"):
        dagfile.to_flow(dagfile.parse("[component x]\ntype=Nothing"), "d")


def test_queues_of_one_long_instance(spark):
    # one instance over many ranges, and through a flow with payload and lineage
    r = random.Random(5)
    sides = [int(r.random() < (0.2 if i // 300 % 2 else 0.8)) for i in range(2000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sides)], "at long, side long")
    got = sorted((x.pair, x.a, x.b) for x in O.zip_with_queues(df, [], "side", ["at"], 16, ranges=9).collect())
    assert got == [(k, a, b) for k, (a, b) in enumerate(simulate(sides, 16))]
    given = {}
    for side, name in enumerate("ab"):
        at = [i for i, s in enumerate(sides) if s == side]
        rows = [(n, i, i * 10, n * 100 + side) for n, i in enumerate(at)]
        given[f"q/{name}"] = spark.createDataFrame(rows, "seq long, arrival long, ts_ns long, v long").withColumn("lineage", L.rooted(f"q/{name}", "seq"))
    f = FlowBuilder("q")
    f.join(f.tap("a"), f.tap("b"), lambda x, y: {"a": x("v"), "b": y("v")}, depth=O.QUEUE)
    out = f.build().lower(spark, given)["q/~0"].select("seq", "a", "b", L.describe("lineage").alias("l")).collect()
    want = {(k, a * 100, b * 100 + 1, f"q/a#{a} -> q/~0#{k} | q/b#{b} -> q/~0#{k}") for k, (a, b) in enumerate(simulate(sides, 16))}
    assert {(x.seq, x.a, x.b, x.l) for x in out} == want


def test_numbering_of_equal_and_far_values(spark):
    df = spark.range(4000).select(F.when(F.col("id") == 7, 1 << 60).otherwise(5).alias("t"), "id")
    rows = number(df, ["t", "id"], ranges=8)
    assert {r.id: r.seq for r in rows.collect()} == {i: 3999 if i == 7 else i - (i > 7) for i in range(4000)}
    assert max(r["count"] for r in ranged(df, ["t", "id"], ranges=8).groupBy("_bucket").count().collect()) < 2000


def test_folds_and_loops_of_a_flow(spark):
    r = random.Random(6)
    rows = [(n, n * 2, n * 5, r.randrange(100), "xy"[n % 2]) for n in range(300)]
    given = {"g/in": spark.createDataFrame(rows, "seq long, arrival long, ts_ns long, v long, k string").withColumn("lineage", L.rooted("g/in", "seq"))}

    def step(state, row):  # two outputs for a large value, none for a small one; the state feeds back
        state = (state * 3 + row.v) % 97
        return state, [(state, j) for j in range(row.v // 40)]

    want, state, seq = [], 0, 0
    for n, _, _, v, _ in rows:
        state = (state * 3 + v) % 97
        for j in range(v // 40):
            want.append((seq, state, j, f"g/in#{n} -> g/out#{seq}"))
            seq += 1
    f = FlowBuilder("g")
    f.fold(f.tap("in"), "out", lambda: 0, step, "state long, j long")
    out = f.build().lower(spark, given)["g/out"].select("seq", "state", "j", L.describe("lineage").alias("l"))
    assert sorted(tuple(x) for x in out.collect()) == want
    keyed = O.fold_by_key(given["g/in"], ["k"], ["arrival"], lambda: 0, lambda s, x: (s + x.v, [(x.seq, s + x.v)]), "k string, seq long, total long")
    sums = {"x": 0, "y": 0}
    expect = set()
    for n, _, _, v, k in rows:
        sums[k] += v
        expect.add((k, n, sums[k]))
    assert {tuple(x) for x in keyed.collect()} == expect


def test_aggregates_of_spans(spark):
    data = ticks(spark, "s/d", 50, v=F.col("seq") * 2)
    trigger = ticks(spark, "s/t", 3, start=100).withColumn("ts_ns", F.col("seq") * 20_000_000)
    span = (F.col("ts_ns") - 5_000_000, F.col("ts_ns"))
    got = {r.seq: (r.n, r.total, r.l) for r in O.span_aggregate(trigger, data, "s/~0", "s/d", span, 5_000_000, {"total": F.sum("v")}).withColumn("l", L.describe("lineage")).collect()}
    whole = {r.seq: (r.n, r.total, r.l) for r in O.span_join(trigger, data, "s/~0", "s/d", span, 5_000_000).select("seq", F.size("items").cast("bigint").alias("n"), F.when(F.size("items") > 0, F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["v"])).alias("total"), L.describe("lineage").alias("l")).collect()}
    assert got == whole and got[0][0] == 1 and got[1][0] == 6


def test_slices_are_cut_without_shuffling_pairs(spark):
    """Data numbers that do not follow time, equal times, nulls, spans of any length, triggers that see nothing."""
    r = random.Random(5)
    data = [(i, 1000 + i, r.choice([None, *range(60)]), r.choice([None, -3, 1 << 40, 7]), r.choice([None, 0.1, 0.7])) for i in range(300)]
    asks = [(i, i, r.choice([None, *range(-20, 70)]), r.choice([None, 0, 5, 40, -1])) for i in range(200)]
    d = spark.createDataFrame(data, "seq long, arrival long, t long, v long, x double").withColumn("ts_ns", F.col("t")).withColumn("lineage", L.rooted("d", "seq"))
    t = spark.createDataFrame(asks, "seq long, arrival long, a long, more long").withColumn("ts_ns", F.col("a")).withColumn("lineage", L.rooted("t", "seq"))
    span = (F.col("a"), F.col("a") + F.col("more"))
    whole = O.span_join(t, d, "o", "d", span, 7, "t")
    plan = whole._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "_trigger" not in plan
    want = {}
    for seq, _, a, more in asks:
        want[seq] = [x for x in data if None not in (a, more, x[2]) and a <= x[2] <= a + more]
    got = {x.seq: x for x in whole.withColumn("l", L.describe("lineage")).collect()}
    assert {k: [(i.seq, i.t, i.v, i.x) for i in x["items"]] for k, x in got.items()} == {k: [(x[0], *x[2:]) for x in v] for k, v in want.items()}
    assert {(k, x.a, x.more) for k, x in got.items()} == {(x[0], *x[2:]) for x in asks}
    folds = {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "xs": ("sum", "x"), "x_high": ("max", "x")}
    made = O.span_join(t, d, "o", "d", span, 7, "t", folds=folds).withColumn("l", L.describe("lineage")).collect()
    assert len(made) == 200
    for x in made:
        own = want[x.seq]
        v, xs = [i[3] for i in own if i[3] is not None], [i[4] for i in own if i[4] is not None]
        assert (x.n, x.total, x.low, x.high) == (len(own), sum(v) if v else None, min(v, default=None), max(v, default=None))
        assert (x.seq_lo, x.seq_hi) == (min([i[0] for i in own], default=None), max([i[0] for i in own], default=None))
        assert x.x_high == max(xs, default=None) and (x.xs == pytest.approx(sum(xs)) if xs else x.xs is None)
        assert x.l == got[x.seq].l
    empty = O.span_join(t, d.limit(0), "o", "d", span, 7, "t", folds={}).select("n").collect()
    assert [x.n for x in empty] == [0] * 200
