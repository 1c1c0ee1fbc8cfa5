"""``python -m weirflow.cli PATH``: what a recorded log holds, and how its stages perform.

Exit codes: 0, 1 for a path that cannot be read, 2 for a declared stage that was never seen,
3 for a declared cost that has drifted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from weirflow.operators import records, timing
from weirflow.sources import trec


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return trec.read(spark, path) if kind == "trec" else records.read(spark, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="weirflow")
    p.add_argument("path")
    p.add_argument("--format", choices=["parquet", "trec"], default="parquet")
    p.add_argument("--messages", type=int, default=0, help="show the first N messages of each channel")
    p.add_argument("--calibrate", action="store_true")
    p.add_argument("--declared", action="append", default=[], metavar="STAGE=US")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        log = load(spark, a.path, a.format)
        stats = records.channel_stats(log).orderBy("channel").collect()
    except Exception as e:  # an unreadable record is this command's answer, not its crash
        print(f"cannot read {a.path}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    for r in stats:
        print(f"{r.channel}: {r.n} messages, {r.n_bytes} bytes, seq {r.first_seq}..{r.last_seq}, {r.rate_hz:.6g} Hz")
    if a.messages:
        for r in records.first_n(log, a.messages).orderBy("channel", "arrival").collect():
            print(f"{r.channel}#{r.seq} @{r.ts_ns} {len(r.payload)} bytes")
    if not (a.calibrate or a.declared):
        return 0
    found = timing.calibrate(log)
    for r in found.orderBy("stage").collect():
        print(f"{r.stage}: N={r.n} p50={r.p50_us:.6g} p99={r.p99_us:.6g} p99.9={r.p999_us:.6g} us, suggest {r.suggest_us:.6g} us")
    if not a.declared:
        return 0
    pairs = [(k, float(v)) for k, _, v in (d.rpartition("=") for d in a.declared)]
    verdicts = timing.drift(found, spark.createDataFrame(pairs, "stage string, declared_us double")).collect()
    for r in verdicts:
        print(f"{r.stage}: declared {r.declared_us:.6g} us is {r.verdict}")
    if any(r.verdict == "UNKNOWN" for r in verdicts):
        return 2
    return 3 if any(r.verdict in ("HIGH", "LOW") for r in verdicts) else 0


if __name__ == "__main__":
    sys.exit(main())
