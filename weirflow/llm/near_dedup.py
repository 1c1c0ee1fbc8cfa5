"""Near-duplicate documents by HyperMinHash banding, estimation and exact verification.

Documents with the same shingle set form a class, and only one document of a class goes
on, so exact copies cost one aggregation. Classes that share a band key meet in a
bucket. First each class proposes one partner, the document that is the least of most of
its buckets; that links most of a group of any size by one pair a document. Buckets whose
members are not all connected by then are searched in rounds: a bounded number of pivots
from outside the bucket's largest component meet the members of other components as
these stream by, and drop out, until no bucket holds two components and an unsearched
member. In a round each pivot first proposes its likeliest partner; then all that still
have a likely partner in another component meet once more with their full sets, and the
links found are confirmed there. So the tables between steps grow with the classes and
their buckets, never with the pairs. Estimates are corrected for collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import discard
from weirflow.shipping import ship

from .common import slices, written
from .components import components, extended
from .hyperminhash import BANDS, BUCKETS, band_keys, similarity, sketch
from .shingles import STEPS, mix, shingle_sets

#: Pivots of a bucket in a round, about; with fewer members outside the largest component one does.
PIVOTS = 128
#: Members of a bucket that one task compares with its pivots, about.
STRETCH = 20_000
#: Stands for the largest component of a bucket, whatever its name.
LARGEST = -(1 << 63)
#: How far an estimate may lie below the threshold: so many of its standard deviations, and a hundredth.
DEVIATIONS, SLACK = 4, 0.01


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, h1, h2, registers``: set size, 128-bit sum hash of the set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            sets = shingle_sets([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
            h1 = [int(mix(s ^ STEPS[3]).sum(dtype=np.uint64)) for s in sets]
            h2 = [int(mix(s + STEPS[4]).sum(dtype=np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "h1", "h2", "registers"],
            )

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, registers binary")


def band_entries(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in b.column(1).to_pylist()]
            if keys:
                ids = np.repeat(b.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], ["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(run, "key long, rep long")


def least_estimate(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """The lowest estimate that a pair of sets at the threshold may get.

    Registers sample the union without replacement, one element a bucket, so small
    unions are known almost exactly.
    """
    union = (n + m) / (1 + threshold)
    sampled = BUCKETS * -np.expm1(-union / BUCKETS)
    variance = threshold * (1 - threshold) / sampled * np.maximum(0, 1 - sampled / np.maximum(union, sampled))
    return threshold - SLACK - DEVIATIONS * np.sqrt(variance)


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``u, v`` whose corrected estimate does not rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
            n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
            fit = (similarity(a, c, n, m) >= least_estimate(n, m, threshold)) & (np.minimum(n, m) >= threshold * np.maximum(n, m) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(fit))

    side = lambda k: reps.select(F.col("rep").alias(k), F.col("registers").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "ru", "rv", "nu", "nv")
    return joined.mapInArrow(run, "u long, v long")


def search(live: DataFrame, percent: int, mode: str) -> DataFrame:
    """Meetings of pivots and members of other components in each bucket.

    ``live`` has ``key, size, rep, comp, pivot, n, registers`` (``exact``: and ``shingles``). A large bucket is
    dealt out in stretches, each with all of its pivots, and members stream past them. What comes out is in
    proportion to the rows, never to the pairs:

    * ``best``: ``u, v, estimate``, of each pivot ``u`` the member ``v`` with the highest estimate;
    * ``flag``: ``key, rep``, all that have a likely partner, looked for by the first band that both share;
    * ``exact``: ``u, v``, confirmed links, of each pivot one to each component that it meets.
    """
    threshold = percent / 100
    names = ["key", "salt", "role", "rep", "comp", "n", "registers"] + (["shingles"] if mode == "exact" else [])
    kind = {"best": "u long, v long, estimate double", "flag": "key long, rep long", "exact": "u long, v long"}[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots, pivot_reps = None, [], np.zeros(0, np.int64)
        best: dict[int, tuple[float, int]] = {}
        flagged: set[int] = set()
        met: dict[tuple[int, int], int] = {}

        def meet(rows: list[tuple]) -> None:
            regs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, BUCKETS)
            rep, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
            bands: dict[int, np.ndarray] = {}
            is_pivot = np.isin(rep, pivot_reps)
            for p in pivots:
                own = np.frombuffer(p[6], np.uint16)
                # two pivots meet once
                fit = (comp != p[4]) & (np.minimum(n, p[5]) >= threshold * np.maximum(n, p[5]) * (1 - 1e-9)) & ~(is_pivot & (rep > p[3]))
                at = np.flatnonzero(fit)
                est = similarity(regs[at], own[None], n[at], np.full(len(at), p[5]))
                some = est >= least_estimate(n[at], p[5], threshold)
                at, est = at[some], est[some]
                if not len(at):
                    continue
                if mode == "best":
                    k = int(np.lexsort((rep[at], -est))[0])
                    found = (float(est[k]), -int(rep[at[k]]))
                    best[p[3]] = max(best.get(p[3], found), found)
                    continue
                keys = band_keys(own)
                for k in at.tolist():
                    if mode == "exact" and (p[3], rows[k][4]) in met:
                        continue
                    if k not in bands:
                        bands[k] = band_keys(regs[k])
                    if int(keys[np.argmax(bands[k] == keys)].view(np.int64)) != group[0]:
                        continue
                    if mode == "flag":
                        flagged.update((p[3], rows[k][3]))
                    elif similar(np.frombuffer(p[7], np.uint64), np.frombuffer(rows[k][7], np.uint64), percent):
                        met[p[3], rows[k][4]] = rows[k][3]

        def report() -> pa.RecordBatch | None:
            if best:
                out = [(p, -m, e) for p, (e, m) in best.items()]
            elif flagged:
                out = [(group[0], r) for r in flagged]
            else:
                out = [(max(p, m), min(p, m)) for (p, _), m in met.items()]
            best.clear()
            flagged.clear()
            met.clear()
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], [f.split()[0] for f in kind.split(", ")])

        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(len(names))), strict=True))
            i = 0
            while i < len(rows):
                if rows[i][:2] != group:
                    if best or flagged or met:
                        yield report()
                    group, pivots = rows[i][:2], []
                j = i
                while j < len(rows) and rows[j][:2] == group and rows[j][2] == rows[i][2]:
                    j += 1
                if rows[i][2] == 0:
                    pivots += rows[i:j]
                    pivot_reps = np.array([p[3] for p in pivots], np.int64)
                elif pivots:
                    for k in range(i, j, 4096):
                        meet(rows[k : min(j, k + 4096)])
                i = j
        if best or flagged or met:
            yield report()

    salts = F.ceil(F.col("size") / STRETCH).cast("int")
    members = live.withColumn("role", F.lit(1)).withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    pivots = live.filter("pivot").withColumn("role", F.lit(0)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = members.select(names).unionByName(pivots.select(names)).repartition("key", "salt")
    return both.sortWithinPartitions("key", "salt", "role", "rep").mapInArrow(run, kind)


def best_of(meetings: DataFrame) -> DataFrame:
    """Of each pivot the likeliest partner over all buckets, as pairs ``u > v``."""
    first = meetings.groupBy("u").agg(F.min(F.struct(-F.col("estimate"), "v")).alias("first"))
    return first.select(F.greatest("u", "first.v").alias("u"), F.least("u", "first.v").alias("v")).distinct()


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if not len(s) or not len(t):
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def shingles_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles``: the full sets of the documents that ``nodes`` names, as a written table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = shingle_sets([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    d = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    return written(d.join(nodes.distinct(), "node", "left_semi").mapInArrow(sets, "node long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union, as a written table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    wanted = shingles_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), docs, id_col, text_col)
    side = lambda k: wanted.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))
    out = written(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv").mapInArrow(check, "u long, v long"), "links")
    discard(wanted)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Ids are integers. A null or empty text, or one without words, has no shingles and is
    linked with nothing; a row without id likewise, its component is null. Rows with the
    same id are one document, linked through any of its texts; equal texts are one class
    whatever their number, and ties between likely partners go to the smaller id. Texts of
    any length are taken whole. Other columns are ignored; an empty table gives an empty
    result. A link is lost only if no band agrees, which at the threshold has a probability
    of (1 - 0.75^5)^51, about 1e-6, or if the estimate is too low (see ``least_estimate``).
    """
    spark = docs.sparkSession
    ship(spark)
    threshold = percent / 100
    sig = written(signatures(docs, id_col, text_col), "signatures")
    classes = sig.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    reps = written(
        sig.filter("n > 0").withColumnRenamed("doc_id", "rep").join(classes, ["rep", "h1", "h2", "n"]).select("rep", "n", "registers").distinct(),
        "representatives",
    )
    entries = band_entries(reps)
    buckets = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").drop("hi")
    shared = written(entries.join(buckets, "key"), "buckets")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("u", "v"), "likely")
        found = confirmed(pairs, docs, percent, id_col, text_col)
        discard(pairs)
        return found

    # the least member of most of its buckets is a class's first proposal
    votes = shared.filter("rep > lo").groupBy("rep", "lo").agg(F.count(F.lit(1)).alias("n"))
    star = votes.groupBy("rep").agg(F.min(F.struct(-F.col("n"), "lo")).alias("first")).select(F.col("rep").alias("u"), F.col("first.lo").alias("v"))
    comp = components(links(likely(star, reps, threshold)))

    def linked(found: DataFrame) -> DataFrame:
        out = extended(comp, found)
        discard(comp, found)
        return out

    def named(rows: DataFrame) -> DataFrame:
        of = comp.select(F.col("u").alias("rep"), F.col("v").alias("_c"))
        return rows.join(of, "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")

    def renamed(outside: DataFrame) -> DataFrame:
        """Outsiders by their components now; one that has joined the bucket's largest component is a member like any other."""
        of = comp.select(F.col("u").alias("largest"), F.col("v").alias("_l"))
        now = named(outside.drop("comp")).join(of, "largest", "left").withColumn("largest", F.coalesce("_l", "largest"))
        joined = F.col("comp") == F.col("largest")
        now = now.withColumn("pivot", F.col("pivot") & ~joined).withColumn("comp", F.when(joined, F.lit(LARGEST)).otherwise(F.col("comp")))
        out = written(now.drop("_l"), "outside")
        discard(outside)
        return out

    members, step, stale = shared.select("key", "rep"), 0, ()
    while True:
        step += 1
        rows = named(members)
        parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        mixed = parts.groupBy("key").agg(
            F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps")
        )
        mixed = mixed.filter("comps > 1").drop("comps")
        is_outside = F.col("comp") != F.col("largest")
        pivot = is_outside & (F.pmod(F.xxhash64("rep", F.lit(step)), F.col("size") - F.col("most")) < PIVOTS)
        met = written(rows.join(mixed, "key").select("key", "size", "largest", "rep", "comp", pivot.alias("pivot")), "met")
        discard(*stale)
        if met.isEmpty():
            break
        live = written(met.join(reps, "rep"), "live")
        discard(met)
        # the largest component's members stay as they are through the round; only outsiders get new names
        inside = live.filter(~is_outside).withColumn("comp", F.lit(LARGEST))
        outside = live.filter(is_outside)
        found = links(best_of(search(inside.unionByName(outside), percent, "best")))
        if not found.isEmpty():
            comp = linked(found)
            outside = renamed(outside)
        # whatever may still be similar is compared in full where it meets
        everyone = inside.unionByName(outside)
        flagged = written(search(everyone, percent, "flag").distinct(), "flagged")
        if not flagged.isEmpty():
            sets = shingles_of(flagged.select(F.col("rep").alias("node")), docs, id_col, text_col)
            full = everyone.join(flagged, ["key", "rep"], "left_semi").join(sets.withColumnRenamed("node", "rep"), "rep")
            found = written(search(full, percent, "exact").distinct(), "links")
            discard(sets)
            if not found.isEmpty():
                comp = linked(found)
                outside = renamed(outside)
        discard(flagged)
        members, stale = inside.unionByName(outside).filter(~F.col("pivot")).select("key", "rep"), (live, outside)
    discard(shared, reps, met)
    ids = sig.select("doc_id", "n", "h1", "h2")
    out = ids.join(classes, ["h1", "h2", "n"], "left").join(comp.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left")
    # an id whose texts fall into several classes is one node: its own component counts as well
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("c", "rep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )
