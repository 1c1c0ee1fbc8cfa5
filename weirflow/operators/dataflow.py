"""The graph operators over channels.

A channel is a DataFrame with ``seq`` (its own numbering), ``arrival`` (place in the
order in which all messages of the flow came), ``ts_ns``, payload columns and
``lineage``.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from weirflow.functions import lineage as L
from weirflow.shipping import ship

from . import spans
from .numbering import number, running
from .queues import zip_with_queues

__all__ = ["zip_with_queues"]

META = ("seq", "arrival", "ts_ns", "lineage")
#: Depth of an operator's input queue, and of a channel's history.
QUEUE, HISTORY = 16, 64


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def source(rows: DataFrame, channel: str, order: Sequence[str]) -> DataFrame:
    """Number table rows as the messages of a source; ``order`` leads with the time in ns (``ts_ns``)."""
    return number(rows, order).withColumn("lineage", L.rooted(channel, "seq"))


def generate(spark, channel: str, n: int, interval_us: int, **columns: Column) -> DataFrame:
    """A periodic source: tick i at i * interval."""
    if interval_us <= 0:
        raise ValueError("a periodic source needs a positive interval")
    t = spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("arrival"), (F.col("id") * interval_us * 1000).alias("ts_ns"))
    return t.withColumns(columns).withColumn("lineage", L.rooted(channel, "seq"))


def map_rows(df: DataFrame, channel: str, **columns: Column) -> DataFrame:
    """One output a message: ``columns`` become the payload."""
    return df.select(
        "seq", "arrival", "ts_ns", *[v.alias(k) for k, v in columns.items()], L.add_hop("lineage", channel, "seq").alias("lineage")
    )


def merge_into(channel: str, *inputs: DataFrame) -> DataFrame:
    """Several producers of one named channel, numbered by arrival."""
    stripped = [i.withColumn("lineage", F.col("lineage")) for i in inputs]
    union = reduce(lambda a, b: a.unionByName(b), stripped).drop("seq")
    out = number(union, ["arrival"])
    return out.withColumn("lineage", L.add_hop("lineage", channel, "seq")).select("seq", *[c for c in out.columns if c != "seq"])


def op(df: DataFrame, channel: str, emit: Column, init: Column | None = None) -> DataFrame:
    """0 to n outputs a message: ``emit`` is an array of payload structs, none to drop the message.

    ``init`` (an array of such structs without input columns) is emitted first; its rows are rooted at
    the channel and take its first numbers.
    """
    out = df.select("arrival", "ts_ns", "lineage", F.posexplode(emit).alias("_pos", "_row"))
    out = number(out, ["arrival", "_pos"])
    first = None
    if init is not None:
        first = df.sparkSession.range(1).select(F.posexplode(init).alias("seq", "_row")).withColumn("seq", F.col("seq").cast("bigint"))
        out = out.withColumn("seq", F.col("seq") + F.size(init))
    out = out.select("seq", "arrival", "ts_ns", "_row.*", L.add_hop("lineage", channel, "seq").alias("lineage"))
    if first is None:
        return out
    at = first.select("seq", F.lit(-1).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("ts_ns"), "_row.*", L.rooted(channel, "seq").alias("lineage"))
    return at.unionByName(out)


def zip_join(a: DataFrame, b: DataFrame, channel: str, fn: Callable[[Callable, Callable], dict[str, Column]]) -> DataFrame:
    """The n-th message of ``a`` with the n-th of ``b``, for queues that never overflow.

    ``fn`` gets two accessors of payload columns and returns the payload of the pair.
    """
    x = a.select("seq", *[F.col(c).alias(f"_a_{c}") for c in a.columns if c != "seq"])
    y = b.select("seq", *[F.col(c).alias(f"_b_{c}") for c in b.columns if c != "seq"])
    columns = fn(lambda c: F.col(f"_a_{c}"), lambda c: F.col(f"_b_{c}"))
    return x.join(y, "seq").select(
        "seq",
        F.greatest("_a_arrival", "_b_arrival").alias("arrival"),
        F.greatest("_a_ts_ns", "_b_ts_ns").alias("ts_ns"),
        *[v.alias(k) for k, v in columns.items()],
        L.add_hop(L.merge("_a_lineage", "_b_lineage"), channel, "seq").alias("lineage"),
    )


def zip_many(inputs: Sequence[DataFrame], channel: str, fn: Callable[..., dict[str, Column]]) -> DataFrame:
    """The n-th messages of two to four channels; ``fn`` gets an accessor of payload columns for each."""
    if not 2 <= len(inputs) <= 4:
        raise ValueError("two to four channels are fused")
    sides = [d.select("seq", *[F.col(c).alias(f"_{k}_{c}") for c in d.columns if c != "seq"]) for k, d in enumerate(inputs)]
    both = reduce(lambda x, y: x.join(y, "seq"), sides)
    columns = fn(*[lambda c, k=k: F.col(f"_{k}_{c}") for k in range(len(sides))])
    lineage = reduce(L.merge, [F.col(f"_{k}_lineage") for k in range(len(sides))])
    return both.select(
        "seq",
        F.greatest(*[f"_{k}_arrival" for k in range(len(sides))]).alias("arrival"),
        F.greatest(*[f"_{k}_ts_ns" for k in range(len(sides))]).alias("ts_ns"),
        *[v.alias(k) for k, v in columns.items()],
        L.add_hop(lineage, channel, "seq").alias("lineage"),
    )


def overflows(a: DataFrame, b: DataFrame, depth: int = QUEUE) -> bool:
    """Whether one side ever runs more than ``depth`` ahead, so that its queue drops messages."""
    both = a.select("arrival", F.lit(1).alias("d")).unionByName(b.select("arrival", F.lit(-1).alias("d")))
    lead = running(both, ["arrival"], {"ahead": ("sum", "d")}).agg(F.max(F.abs("ahead"))).first()[0]
    return (lead or 0) > depth


def zip_dropping(
    a: DataFrame, b: DataFrame, channel: str, fn: Callable[[Callable, Callable], dict[str, Column]], depth: int = QUEUE, ranges: int | None = None
) -> DataFrame:
    """``zip_join`` for queues that hold ``depth`` messages and drop their oldest; lineage stays with its payload."""
    both = a.select("arrival", F.lit(0).alias("_q")).unionByName(b.select("arrival", F.lit(1).alias("_q")))
    pairs = zip_with_queues(both, [], "_q", ["arrival", "_q"], depth, ranges)
    x = a.join(pairs.select("pair", F.col("a").alias("_n")), F.col("seq") == F.col("_n"))
    y = b.join(pairs.select("pair", F.col("b").alias("_n")), F.col("seq") == F.col("_n"))
    renumbered = lambda d, own: d.select(F.col("pair").alias("seq"), *[c for c in own.columns if c != "seq"])
    return zip_join(renumbered(x, a), renumbered(y, b), channel, fn)


def span_aggregate(
    trigger: DataFrame, data: DataFrame, channel: str, data_channel: str, span: tuple[Column, Column], width: int, reduce: dict[str, Column], time: str = "ts_ns"
) -> DataFrame:
    """``span_join`` where only reductions of each slice are wanted: aggregates over the data's columns, combined before any shuffle of slices.

    A slice is never held as an array, so it may be of any size. Aggregates of empty slices are those of no rows.
    """
    t = trigger.select(F.col("seq").alias("_trigger"), span[0].cast("bigint").alias("_lo"), span[1].cast("bigint").alias("_hi"))
    t = t.filter("_lo <= _hi").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    d = data.withColumnRenamed("seq", "_seq").withColumn("_time", F.col(time).cast("bigint"))
    d = d.withColumn("_cell", F.floor(F.col("_time") / width)).drop("lineage", "arrival")
    found = t.join(d, "_cell").filter("_time between _lo and _hi")
    made = found.groupBy("_trigger").agg(F.min("_seq").alias("seq_lo"), F.max("_seq").alias("seq_hi"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in reduce.items()])
    own = trigger.select("seq", "arrival", "ts_ns", F.col("lineage").alias("_lineage"))
    joined = own.join(made, F.col("seq") == F.col("_trigger"), "left")
    both = F.when(F.col("n") > 0, L.merge("_lineage", L.rooted(data_channel, "seq_lo", "seq_hi"))).otherwise(F.col("_lineage"))
    lineage = L.add_hop(both, channel, "seq").alias("lineage")
    return joined.select("seq", "arrival", "ts_ns", F.coalesce("n", F.lit(0)).alias("n"), *reduce, "seq_lo", "seq_hi", lineage)


def _slices(found: DataFrame, trigger: DataFrame, channel: str, data_channel: str) -> DataFrame:
    """Group the data rows of each trigger into a slice; triggers without any get an empty one."""
    items = found.groupBy("_trigger").agg(F.array_sort(F.collect_list("_item")).alias("items"))
    t = trigger.select("seq", "arrival", "ts_ns", *payload(trigger), F.col("lineage").alias("_lineage"))
    kind = found.schema["_item"].dataType.simpleString()
    joined = t.join(items, F.col("seq") == F.col("_trigger"), "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{kind}>")))
    lo, hi = F.get("items", F.lit(0))["seq"], F.try_element_at("items", F.lit(-1))["seq"]
    both = F.when(F.size("items") > 0, L.merge("_lineage", L.rooted(data_channel, lo, hi))).otherwise(F.col("_lineage"))
    return joined.select(
        "seq", "arrival", "ts_ns", *payload(trigger), "items", lo.alias("seq_lo"), hi.alias("seq_hi"), L.add_hop(both, channel, "seq").alias("lineage")
    )


def _cut_slices(
    trigger: DataFrame, data: DataFrame, channel: str, data_channel: str, span: tuple[Column, Column], width: int, time: str, folds: dict[str, tuple[str, str]] | None
) -> DataFrame:
    """``span_join`` without a bound: a task sorts the data that a bucket's triggers can see, and cuts their slices out of it."""
    kept = [c for c in data.columns if c not in ("seq", "lineage", "arrival")] if folds is None else list(dict.fromkeys(c for _, c in folds.values()))
    lo, hi = span[0].cast("bigint"), span[1].cast("bigint")
    rest = payload(trigger) if folds is None else []
    t = trigger.select(F.struct(*META, *rest).alias("_own"), lo.alias("_lo"), hi.alias("_hi"))
    # a trigger of no span sees nothing and may be anywhere
    t = t.withColumn("_home", F.coalesce(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width), F.lit(0)))
    seen = t.filter("_lo <= _hi").groupBy("_home").agg(F.min("_lo").alias("_from"), F.max("_hi").alias("_to"))
    seen = seen.withColumn("_cell", F.explode(F.sequence("_home", F.floor(F.col("_to") / width))))
    d = data.select(F.struct("seq", *kept).alias("_item"), F.col("seq").alias("_seq"), F.col(time).cast("bigint").alias("_lo"))
    d = d.withColumn("_cell", F.floor(F.col("_lo") / width)).join(seen, "_cell").filter("_lo between _from and _to")
    both = d.select("_home", F.lit(False).alias("_asks"), "_lo", F.lit(None).cast("bigint").alias("_hi"), "_seq", "_item").unionByName(
        t.select("_home", F.lit(True).alias("_asks"), "_lo", "_hi", F.col("_own"), F.col("_own.seq").alias("_seq")), allowMissingColumns=True
    )
    item, own = both.schema["_item"].dataType, both.schema["_own"].dataType
    if folds is None:
        made = [StructField("items", ArrayType(item))]
    else:
        wide = lambda f, kind: data.agg(getattr(F, f)(kind)).schema[0].dataType
        made = [StructField("n", LongType()), *[StructField(k, wide(f, c)) for k, (f, c) in folds.items()]]
    schema = StructType([StructField("_own", own), *made, StructField("seq_lo", LongType()), StructField("seq_hi", LongType())])
    ship(trigger.sparkSession)
    cut = spans.cutter(to_arrow_schema(schema), folds)
    dealt = both.select("_home", "_asks", "_lo", "_hi", "_seq", "_item", "_own").repartition("_home").sortWithinPartitions("_home", "_asks", "_lo", "_seq")
    found = dealt.mapInArrow(cut, schema).select("_own.*", *[f.name for f in made], "seq_lo", "seq_hi")
    merged = F.when(F.col("seq_lo").isNotNull(), L.merge("lineage", L.rooted(data_channel, "seq_lo", "seq_hi"))).otherwise(F.col("lineage"))
    return found.select("seq", "arrival", "ts_ns", *rest, *[f.name for f in made], "seq_lo", "seq_hi", L.add_hop(merged, channel, "seq").alias("lineage"))


def span_join(
    trigger: DataFrame,
    data: DataFrame,
    channel: str,
    data_channel: str,
    span: tuple[Column, Column],
    width: int,
    time: str = "ts_ns",
    history: int | None = None,
    folds: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """All data messages whose time lies in each trigger's closed ``span``, as a slice.

    Data rows go to the time buckets of ``width`` (near the usual span length) whose triggers can see
    them, and a slice is cut in the task of its trigger, so pairs are never shuffled. Slices take as much room
    as they have items in all; with ``folds`` (output: function sum, min or max, and column) only ``n`` and
    the folds of each slice are kept, null where it has no value, beside the trigger's number and times. With ``history`` a trigger sees only the last so
    many data messages that arrived before it, found by buckets of the data's own numbers, and gets
    ``truncated`` if older ones may be missing. Triggers with an empty slice stay.
    """
    if history is None:
        return _cut_slices(trigger, data, channel, data_channel, span, width, time, folds)
    if folds is not None:
        raise ValueError("folds are for complete slices")
    t = trigger.select(F.col("seq").alias("_trigger"), F.col("arrival").alias("_at"), span[0].cast("bigint").alias("_lo"), span[1].cast("bigint").alias("_hi"))
    item = F.struct("seq", *[F.col(c) for c in data.columns if c not in ("seq", "lineage", "arrival")]).alias("_item")
    d = data.select(item, F.col("seq").alias("_seq"), F.col("arrival").alias("_came"), F.col(time).cast("bigint").alias("_time"))
    came = d.select("_came", F.lit(1).alias("one")).unionByName(t.select(F.col("_at").alias("_came"), F.lit(0).alias("one")))
    seen = running(came, ["_came"], {"before": ("sum", "one")}, "_n").filter("one = 0").select(F.col("_came").alias("_at"), "before")
    t = t.join(seen, "_at").withColumn("_first", F.greatest(F.col("before") - history, F.lit(0)))
    cells = t.filter("before > 0").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_first") / history), F.floor((F.col("before") - 1) / history))))
    kept = cells.join(d.withColumn("_cell", F.floor(F.col("_seq") / history)), "_cell").filter("_seq between _first and before - 1")
    out = _slices(kept.filter("_time between _lo and _hi"), trigger, channel, data_channel)
    cut = kept.filter("_seq = _first and _first > 0 and _time > _lo").select(F.col("_trigger"), F.lit(True).alias("truncated"))
    return out.join(cut, F.col("seq") == F.col("_trigger"), "left").drop("_trigger").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def stateful(
    df: DataFrame, channel: str, state_channel: str, folds: dict[str, tuple[str, str]], columns: dict[str, Column], state: dict[str, F.lit] | None = None
) -> tuple[DataFrame, DataFrame]:
    """An ordered associative fold with two outputs: results, and the state as versioned messages.

    ``folds`` are running sums, minima or maxima over the payload; ``columns`` and ``state`` (all folds,
    if not given) are expressions over payload and folds. Version i of the state derives from message i.
    """
    kept = {k: F.col(k) for k in folds} if state is None else state
    run = running(df.withColumnRenamed("seq", "_seq"), ["_seq"], folds, "_place").withColumnRenamed("_seq", "seq").drop("_place")
    return map_rows(run, channel, **columns), map_rows(run, state_channel, **kept)


def fold_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], zero: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Any ordered fold or feedback loop, one instance a key (or one in all, without keys).

    ``step(state, row) -> state, outputs`` is called in order; outputs are tuples after the keys. The rows of
    an instance stream through one task, as its order demands, and only its state and a batch are held.
    """
    ship(rows.sparkSession)
    keys, order = list(keys), list(order)
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = namedtuple("Row", names, rename=True)
        at = [names.index(k) for k in keys]
        key, state = None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out: list[tuple] = []
            for values in zip(*columns, strict=True):
                own = tuple(values[i] for i in at)
                if own != key:
                    key, state = own, zero()
                state, made = step(state, row_of(*values))
                out += [own + m for m in made]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_op(df: DataFrame, channel: str, zero: Callable[[], object], step: Callable, schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """An operator with state of its own: ``step(state, row) -> state, outputs`` over the messages by arrival, 0 to n outputs a message.

    ``schema`` names the payload. A loop is a fold as well: what one message leaves behind is the state that
    the next one finds. Each output derives from the message that made it.
    """
    inner = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kinds = (inner + ", " if inner else "") + f"arrival long, ts_ns long, lineage {L.LINEAGE}, _pos long, {schema}"

    def run(state, row):
        state, made = step(state, row)
        return state, [(row.arrival, row.ts_ns, row.lineage, pos, *m) for pos, m in enumerate(made)]

    found = fold_by_key(df, keys, ["arrival"], zero, run, kinds)
    out = number(found.drop(*keys), ["arrival", "_pos"]).drop("_pos")
    rest = [c for c in out.columns if c not in META]
    return out.select("seq", "arrival", "ts_ns", *rest, L.add_hop("lineage", channel, "seq").alias("lineage"))


def history(df: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` messages of a channel; a top-n by number, no full sort."""
    return df.orderBy(F.desc("arrival"), F.desc("seq")).limit(n)


def latest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The newest message of each group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("arrival", "seq")).alias("_r")).select(*by, "_r.*")


def recover(df: DataFrame, state: DataFrame, version: int, folds: dict[str, tuple[str, str]]) -> DataFrame:
    """The final state by replaying only what version ``version`` of the state had not absorbed.

    The number of the last absorbed message is read from the lineage of that version. Returns one row:
    the folds, ``absorbed`` and ``replayed``.
    """
    at = state.filter(F.col("seq") == version).select(L.root("lineage")["seq"].alias("absorbed"), *[F.col(k).alias(f"_{k}") for k in folds])
    # the version's row takes part in the aggregation itself, so nothing is joined
    known = at.first()
    if known is None:
        raise ValueError(f"the state has no version {version}")
    rest = df.filter(F.col("seq") > known.absorbed)
    tail = rest.agg(F.count(F.lit(1)).alias("replayed"), *[getattr(F, f)(c).alias(k) for k, (f, c) in folds.items()])
    add = {"sum": lambda x, y: F.coalesce(x + y, x, y), "min": F.least, "max": F.greatest}
    old = {k: F.lit(known[f"_{k}"]).cast(state.schema[k].dataType) for k in folds}
    return tail.select(F.lit(known.absorbed).alias("absorbed"), "replayed", *[add[f](old[k], F.col(k)).alias(k) for k, (f, _) in folds.items()])


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
