from pyspark.sql import functions as F

from weirflow.shared import fresh_path
from weirflow.streaming import twins


def rows(spark, lo, hi):
    return spark.range(lo, hi).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), (F.col("id") * 7 % 11).alias("v")).coalesce(1)


def folded(lo, hi):
    state, out = {}, set()
    for i in range(lo, hi):
        state[i % 3] = (3 * state.get(i % 3, 0) + i * 7 % 11) % 1009
        out.add((i % 3, i, state[i % 3]))
    return out


def test_state_survives_a_restart(spark):
    given, out = fresh_path(spark, "in"), fresh_path(spark, "out")

    def step(state, row):
        state = (3 * state + int(row.v)) % 1009
        return state, [(int(row.at), state)]

    fold = lambda: twins.fold_stream(twins.stream_of(spark, given), ["k"], ["at"], lambda: 0, step, "k long, at long, state long")
    rows(spark, 0, 40).write.parquet(given)
    assert {tuple(r) for r in twins.drain(fold(), "fold", out).collect()} == folded(0, 40)
    rows(spark, 40, 100).write.mode("append").parquet(given)
    # another query on the same folder goes on from the checkpoint and reads only what is new
    assert {tuple(r) for r in twins.drain(fold(), "fold", out).collect()} == folded(0, 100)
    assert twins.drain(fold(), "fold", out).count() == 100


def test_stop_after_a_time(spark):
    made = twins.run_for(twins.ticks(spark, 50), 6, "ticks")
    seqs = sorted(r.seq for r in made.collect())
    assert seqs and seqs == list(range(len(seqs)))


def test_each_batch(spark):
    given, seen = fresh_path(spark, "in"), []
    rows(spark, 0, 10).write.parquet(given)
    twins.each_batch(twins.stream_of(spark, given), lambda df, n: seen.append(df.count()), "sink")
    assert sum(seen) == 10


def test_queues_of_a_stream_drop_their_oldest(spark):
    given = fresh_path(spark, "in")
    spark.createDataFrame([(0, i, int(i >= 6)) for i in range(9)], "k long, at long, side long").coalesce(1).write.parquet(given)
    got = twins.drain(twins.zip_stream(twins.stream_of(spark, given), ["k"], "side", ["at"], depth=2), "zip")
    assert sorted((r.pair, r.a, r.b) for r in got.collect()) == [(0, 4, 0), (1, 5, 1)]


def test_slices_keep_empty_ones_and_no_more_than_their_depth(spark):
    given = fresh_path(spark, "in")
    data = [(1, i, i, False) for i in range(100)] + [(1, 200, 100, True), (1, 201, 10_000, True), (2, 300, 5, True)]
    spark.createDataFrame(data, "k long, id long, at long, is_trigger boolean").coalesce(1).write.parquet(given)
    s = twins.span_history(twins.stream_of(spark, given), ["k"], ["at", "id"], "is_trigger", "at", -90, 0, "k long, id long, n long, data_lo long, data_hi long")
    got = sorted(tuple(r) for r in twins.drain(s, "slices").collect())
    assert got == [(1, 200, 64, 36, 99), (1, 201, 0, None, None), (2, 300, 0, None, None)]


def test_span_join_of_streams_drops_nothing_unless_told(spark):
    given = fresh_path(spark, "in")
    spark.createDataFrame([(1, 0), (2, 86_400), (3, 100)], "id long, s long").select("id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(given)
    late = fresh_path(spark, "late")
    spark.createDataFrame([(9, 95), (8, 86_390)], "id long, s long").select("id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(late)
    join = lambda lateness: twins.span_stream(twins.stream_of(spark, given), twins.stream_of(spark, late), 20, lateness)
    assert {tuple(r) for r in twins.drain(join(None), "span").collect()} == {(3, 9), (2, 8)}
    # with a watermark a trigger whose span stays empty appears once the watermark has passed it
    assert {(1, None), (3, 9), (2, 8)} >= {tuple(r) for r in twins.drain(join("1 hour"), "span").collect()} >= {(3, 9), (2, 8)}
