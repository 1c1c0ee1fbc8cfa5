from pyspark.sql import functions as F

from weirflow.functions import lineage as L


def text(spark, column):
    return spark.range(1).select(L.describe(column).alias("t")).first().t


def test_merge_then_hop(spark):
    a = L.add_hop(L.rooted("a", F.lit(1)), "x", F.lit(1))
    b = L.rooted("b", F.lit(5))
    assert text(spark, L.add_hop(L.merge(a, b), "j", F.lit(0))) == "a#1 -> x#1 -> j#0 | b#5 -> j#0"


def test_range_root_and_single(spark):
    assert text(spark, L.rooted("imu", F.lit(102), F.lit(121))) == "imu#102..#121"
    assert text(spark, L.rooted("imu", F.lit(7), F.lit(7))) == "imu#7"


def test_merge_keeps_longer_branch_of_same_root(spark):
    short, long = L.rooted("a", F.lit(1)), L.add_hop(L.rooted("a", F.lit(2)), "x", F.lit(3))
    assert text(spark, L.merge(short, long)) == "a#2 -> x#3"
    assert text(spark, L.merge(long, short)) == "a#2 -> x#3"
    assert text(spark, L.merge(short, L.rooted("a", F.lit(9)))) == "a#1"


def test_merge_is_capped(spark):
    x = L.rooted("c0", F.lit(0))
    for k in range(1, 12):
        x = L.merge(x, L.rooted(f"c{k}", F.lit(k)))
    assert text(spark, x).count("|") == L.MAX_BRANCHES - 1


def test_own_and_input_hop(spark):
    x = L.add_hop(L.add_hop(L.rooted("a", F.lit(1)), "x", F.lit(2)), "y", F.lit(3))
    r = spark.range(1).select(L.own_hop(x).alias("o"), L.input_hop(x).alias("i"), L.own_hop(L.rooted("a", F.lit(1))).alias("r"), L.root(F.array().cast(L.LINEAGE)).alias("e")).first()
    assert (r.o.channel, r.o.seq, r.i.channel, r.r.channel, r.e) == ("y", 3, "x", "a", None)


def test_trace_and_forward(spark):
    rows = spark.range(3).select(F.col("id").alias("n"), L.add_hop(L.rooted("a", "id"), "x", "id").alias("lineage"))
    assert L.trace(rows).count() == 6
    assert [r.n for r in L.forward(rows, "a", 1).collect()] == [1]
