import zlib

import pytest
from pyspark.sql import functions as F

from weirflow.functions import lineage as L
from weirflow.operators import records as R
from weirflow.shared import fresh_path
from weirflow.sources import trec


def log(spark, channel, n, step, start=0):
    return spark.range(n).select(
        F.lit(channel).alias("channel"), F.col("id").alias("seq"), (F.col("id") * step + start).alias("ts_ns"), (F.col("id") * step + start).alias("arrival"),
        F.col("id").cast("string").cast("binary").alias("payload"), L.rooted(channel, "id").alias("lineage"),
    )


def test_round_trip_of_files(spark):
    both = R.merge(log(spark, "imu", 1200, 1000), log(spark, "lidar", 10, 10_000, 500)).repartition(2)
    for compression in (0, 1, 2):
        path = fresh_path(spark, "trec")
        trec.write(both, path, compression)
        back = trec.read(spark, path)
        pick = lambda d: sorted((r.channel, r.seq, r.ts_ns, bytes(r.payload), r.l) for r in d.withColumn("l", L.describe("lineage")).collect())
        assert pick(back) == pick(both)


def test_damage_is_found():
    rows = [{"channel": "a", "seq": i, "ts_ns": i, "payload": b"x" * 9, "lineage": [{"root": {"channel": "r", "seq": i, "seq_end": i + 2}, "hops": []}]} for i in range(3)]
    data = trec.encode_file(rows)
    assert [(r["seq"], r["lineage"]) for r in trec.decode_file(data)] == [(r["seq"], r["lineage"]) for r in rows]
    assert trec.decode_file(trec.encode_file([])) == []
    for at in (10, 140, len(data) - 60):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            trec.decode_file(bytes(broken))
    for n in (0, 50, 200, len(data) - 1):
        with pytest.raises(ValueError):
            trec.decode_file(data[:n])
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_legacy_files():
    one = (1).to_bytes(4, "little") + b"c" + (7).to_bytes(8, "little") + (2).to_bytes(4, "little") + b"xy" + (3).to_bytes(4, "little") + b"c#7"
    data = trec.MAGIC_V0.to_bytes(8, "little") + (1).to_bytes(4, "little") + one
    assert [(r["channel"], r["seq"], r["payload"]) for r in trec.decode_file(data)] == [("c", 7, b"xy")]
    with pytest.raises(ValueError):
        trec.decode_file(data[:-1])
    assert trec.encode_v0([{"channel": "c", "seq": 7, "payload": b"xy", "lineage": "c#7"}]) == data


def test_field_tables(spark):
    fields = [trec.Field("d", 0, "double"), trec.Field("u", 8, "uint64"), trec.Field("vec", 16, "double", 3)]
    blob = trec.encode_schema("Pod", fields)
    assert trec.decode_schema(blob) == ("Pod", fields)
    for n in range(len(blob)):
        with pytest.raises(ValueError):
            trec.decode_schema(blob[:n])
    df = spark.createDataFrame([(1, 0.5, 5, [1.0, 2.0, 3.0])], "k long, d double, u long, vec array<double>")
    packed = trec.pack_pod(df, fields)
    assert trec.decode_pod(packed, fields).first().asDict() == {"k": 1, "d": 0.5, "u": 5, "vec": [1.0, 2.0, 3.0]}
    short = packed.withColumn("payload", F.substring("payload", 1, 16))
    assert trec.decode_pod(short, fields).first().vec is None


def test_split_and_merge_goldens(spark):
    a = log(spark, "a", 100, 1000)
    assert R.split_by_time(a, 20_000, 50_000).count() == 31
    m = R.merge(log(spark, "a", 10, 1000), log(spark, "b", 5, 1000), log(spark, "a", 1, 1))
    assert (m.count(), m.select("channel").distinct().count()) == (16, 2)
    assert R.seek(a, 4500).first().seq == 5


def test_stats_of_empty_and_single(spark):
    s = R.channel_stats(log(spark, "a", 1, 10)).first()
    assert (s.n, s.rate_hz) == (1, 0.0)
    assert R.totals(log(spark, "a", 0, 1)).first().n == 0


def test_rendering(spark):
    fields = [trec.Field("d", 0, "double"), trec.Field("v", 8, "int32", 2)]
    packed = trec.pack_pod(spark.createDataFrame([(3.5, [1, 2])], "d double, v array<int>"), fields)
    assert trec.render_pod(packed, fields).first().text == "d=3.5 v=1,2"
    assert trec.render_pod(packed, None).first().text == "0000000000000c400100000002000000"


def test_command(spark, capsys):
    from weirflow import cli

    path = fresh_path(spark, "log")
    src = log(spark, "s/in", 10, 1_000_000)
    out = src.select(F.lit("s/out").alias("channel"), "seq", (F.col("ts_ns") + 1000).alias("ts_ns"), (F.col("arrival") + 1).alias("arrival"), "payload", L.add_hop("lineage", "s/out", "seq").alias("lineage"))
    R.write(R.merge(src, out), path)
    assert cli.main([path, "--messages", "1", "--calibrate"], spark) == 0
    assert "s/out: N=10 p50=1 p99=1 p99.9=1 us, suggest 1.3 us" in capsys.readouterr().out
    assert cli.main([path, "--declared", "s/out=1"], spark) == 0
    assert cli.main([path, "--declared", "s/out=100"], spark) == 3
    assert cli.main([path, "--declared", "gone=1"], spark) == 2
    assert cli.main([path + "/nothing"], spark) == 1


def test_files_of_a_log_are_bounded_and_in_order(spark, monkeypatch):
    from weirflow.operators.numbering import number

    both = R.merge(log(spark, "imu", 1300, 1000), log(spark, "lidar", 130, 10_000, 500)).repartition(3)
    path = fresh_path(spark, "trec")
    monkeypatch.setattr(trec, "FILE_MESSAGES", 500)
    trec.write(both, path)
    back = number(trec.read(spark, path).withColumnRenamed("arrival", "came"), ["came"], "place")
    want = [(r.channel, r.seq) for r in both.orderBy("arrival").collect()]
    assert [(r.channel, r.seq) for r in back.orderBy("place").collect()] == want
    assert trec.read(spark, path).select("arrival").distinct().count() == len(want)
    day = trec.read(spark, path, ["lidar"], 200_000, 300_000)
    assert sorted(r.seq for r in day.collect()) == [i for i in range(130) if 200_000 <= i * 10_000 + 500 <= 300_000]
    first = trec.seek(spark, path, 200_001).first()
    assert (first.channel, first.ts_ns) == ("lidar", 200_500)
    files = [f"{path}/{r.path.rpartition('/')[2]}" for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    again = fresh_path(spark, "legacy")
    assert len(files) > 1 and trec.read(spark, path + "/" + files[0].rpartition("/")[2]).count() > 0
    trec.write(both.limit(0), again)


def test_chunks_without_wanted_messages_are_passed_over():
    rows = [{"channel": "ab"[i // 500 % 2], "seq": i, "ts_ns": i, "payload": b"x", "lineage": []} for i in range(2000)]
    data = trec.encode_file(rows)
    assert [len(c) for c in trec._chunks(data)] == [500] * 4
    assert [c[0]["seq"] for c in trec._chunks(data, ["b"])] == [500, 1500]
    assert [c[0]["seq"] for c in trec._chunks(data, None, 600, 1100)] == [500, 1000]
    places = [m["place"] for c in trec._chunks(data) for m in c]
    assert places == sorted(set(places)) and [m["place"] for c in trec._chunks(data, ["b"]) for m in c] == places[500:1000] + places[1500:]


def test_record_from_start_to_stop_and_append(spark):
    made = R.record({"a": log(spark, "a", 30, 10), "b": log(spark, "b", 5, 10, 3)}, start=20, stop=60)
    assert sorted((r.channel, r.seq) for r in made.collect()) == [("a", k) for k in range(2, 6)] + [("b", k) for k in range(2, 5)]
    path = fresh_path(spark, "log")
    R.write(made, path)
    R.append(R.record({"a": log(spark, "a", 3, 10), "c": log(spark, "c", 2, 10, 5)}), path)
    back = sorted((r.channel, r.seq) for r in R.read(spark, path).collect())
    assert back == [("a", k) for k in range(2, 9)] + [("b", k) for k in range(2, 5)] + [("c", 0), ("c", 1)]
    assert R.read(spark, path).select("arrival").distinct().count() == len(back)
