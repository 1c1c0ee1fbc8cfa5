"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of rows. Block j of a source with weight w is released
at slot floor(j / w) and due before slot ceil((j + 1) / w); among the released blocks
the one with the earliest deadline gets the next slot. Releases and deadlines come from
the exact rational weights over the whole run, so nothing is rounded and no error adds
up: as long as all sources last, after any number of slots a source has had its weighted
share up to less than one block. The driver draws the schedule block by block, a few
microseconds each, and writes it as a table of slots while it goes; it holds no more
than a part of it.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path

#: Sources at most: the driver counts and schedules them one by one.
SOURCES = 10_000
#: Blocks of a row of the schedule's table, and rows of it that the driver writes at once.
CHUNK, CHUNKS = 512, 2000
#: Slots beyond which times without any block are passed over, so that places stay below 2**63.
LAST_SLOT = 1 << 40
#: Rows of a rank bucket, about; buckets are ranked apart, so no task holds a whole source.
BUCKET_ROWS = 5_000


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of ``period`` by largest remainder, one at least for each source."""
    total = math.fsum(weights.values())
    names = sorted(weights)
    free = period - len(names)
    exact = {k: Fraction(weights[k]) / Fraction(total) * free for k in names}
    out = {k: 1 + math.floor(exact[k]) for k in names}
    for k in sorted(names, key=lambda k: (-(exact[k] - math.floor(exact[k])), k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def integers(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*[x.denominator for x in exact])
    return [int(x * unit) for x in exact]


def assigned(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """Source and slot of every block, slot by slot, by earliest deadline among released blocks."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    time = passed = 0
    while waiting or ready:
        if not ready and waiting[0][0] > time:  # only after a source is used up
            if waiting[0][0] - passed > LAST_SLOT:
                passed += waiting[0][0] - time
            time = waiting[0][0]
        while waiting and waiting[0][0] <= time:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i, time - passed
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
        time += 1


def schedule(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period of as many slots as shares."""
    names = sorted(shares)
    slots: dict[str, list[int]] = {k: [] for k in names}
    for i, slot in assigned([shares[k] for k in names], [shares[k] for k in names]):
        slots[names[i]].append(slot)
    return slots


def written_schedule(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """``_source, _chunk, _slots``: the slots of blocks ``CHUNK * _chunk`` and on."""
    path, names = fresh_path(spark, "schedule"), sorted(blocks)
    schema = pa.schema([("_source", pa.string()), ("_chunk", pa.int64()), ("_slots", pa.list_(pa.int64()))])
    open_chunks, numbers = [array("q") for _ in names], [0] * len(names)
    full: list[tuple[str, int, array]] = []

    def close(i: int) -> None:
        full.append((names[i], numbers[i], open_chunks[i]))
        open_chunks[i], numbers[i] = array("q"), numbers[i] + 1

    def flush() -> None:
        columns = [[x[0] for x in full], [x[1] for x in full], [np.array(x[2], np.int64) for x in full]]
        t = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        spark.createDataFrame(t, "_source string, _chunk long, _slots array<long>").write.mode("append").parquet(path)
        full.clear()

    for i, slot in assigned(integers([weights[k] for k in names]), [blocks[k] for k in names]) if names else ():
        open_chunks[i].append(slot)
        if len(open_chunks[i]) == CHUNK:
            close(i)
            if len(full) == CHUNKS:
                flush()
    for i, rest in enumerate(open_chunks):
        if rest:
            close(i)
    flush()
    return spark.read.schema("_source string, _chunk long, _slots array<long>").parquet(path)


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of an id's text, which any engine can follow."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    block_rows: int = 32,
    temperature: float = 0.5,
    keep_columns: bool = False,
    place_col: str = "place",
) -> DataFrame:
    """The rows' places in the mixture: ``doc_id, source, block, slot, place``.

    ``place`` orders the whole mixture: slot by slot, inside a block by a hash of the id,
    which also shuffles each source; rows with equal ids are ordered by a hash of the whole row. Without ``weights`` a source's weight is its number of rows to the
    power ``temperature``. Sources that ``weights`` omit or give no positive weight raise
    ``ValueError``, as do more than ``SOURCES`` sources: no row is ever left out. When a
    source is used up its later slots stay empty and the others go on. A null source is the source of the empty string.
    With ``keep_columns`` the rows keep their own columns, whatever they are called, and the place
    is added to them as ``place_col`` (which must not be among them). Null, empty and very long texts are rows like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = {r[0]: r[1] for r in docs.select(source.alias("s")).groupBy("s").agg(F.count(F.lit(1))).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if weights is None:
        weights = {k: n**temperature for k, n in counts.items()}
    short = [k for k in counts if not weights.get(k, 0) > 0]
    if short:
        raise ValueError(f"no positive weight for the sources {short[:5]}")
    chunks = written_schedule(spark, weights, {k: -(-n // block_rows) for k, n in counts.items()})
    groups = max(1, sum(counts.values()) // BUCKET_ROWS)
    # the rows' own columns stay inside a struct, apart from the helpers
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep_columns else [id_col])])
    tie = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    d = docs.select(own.alias("_row"), source.alias("_source"), id_hash(F.col(f"`{id_col}`")).alias("_hash"), F.xxhash64(*tie).alias("_tie"))
    d = d.withColumn("_group", F.pmod(F.col("_hash"), F.lit(groups)))
    sizes = d.groupBy("_source", "_group").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_source", "_group", "n", F.coalesce(before, F.lit(0)).alias("_before"))
    sizes = sizes.withColumn("_first", F.expr(f"_before div {block_rows}")).withColumn("_last", F.expr(f"(_before + n - 1) div {block_rows}"))
    # the slots of a group's blocks, about BUCKET_ROWS / block_rows of them in a row
    parts = sizes.withColumn("_chunk", F.explode(F.expr(f"sequence(_first div {CHUNK}, _last div {CHUNK})"))).join(chunks, ["_source", "_chunk"])
    sizes = parts.groupBy("_source", "_group", "_before", "_first", "_last").agg(F.sort_array(F.collect_list(F.struct("_chunk", "_slots"))).alias("_parts"))
    inside = F.flatten(F.transform("_parts", lambda x: x["_slots"]))
    sizes = sizes.select("_source", "_group", "_before", "_first", F.slice(inside, (F.col("_first") % CHUNK + 1).cast("int"), (F.col("_last") - F.col("_first") + 1).cast("int")).alias("_slots"))
    rank = F.row_number().over(Window.partitionBy("_source", "_group").orderBy("_hash", f"_row.`{id_col}`", "_tie")) - 1
    ranked = d.withColumn("_rank", rank)
    ranked = ranked.join(sizes, ["_source", "_group"])
    rank = F.col("_rank") + F.col("_before")
    block = F.floor(rank / block_rows).cast("long")
    slot = F.get("_slots", (block - F.col("_first")).cast("int"))
    placed = ranked.withColumn("_block", block).withColumn("_slot", slot)
    place = F.col("_slot") * block_rows + (F.col("_rank") + F.col("_before")) % block_rows
    if keep_columns:
        return placed.select("_row.*", place.alias(place_col))
    return placed.select(
        F.col(f"_row.`{id_col}`").alias("doc_id"), F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), place.alias("place")
    )
