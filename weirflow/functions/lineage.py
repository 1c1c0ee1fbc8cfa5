"""Provenance as a column: branches from a root hop over further hops.

A hop is a channel with a sequence number, or a range of them. All functions are
expressions over arrays of structs; text is made only by :func:`describe`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOP = "struct<channel:string,seq:bigint,seq_end:bigint>"
LINEAGE = f"array<struct<root:{HOP},hops:array<{HOP}>>>"
#: Branches that a lineage holds at most.
MAX_BRANCHES = 8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hop(channel: str, seq, seq_end=None) -> Column:
    lo = _c(seq).cast("bigint")
    hi = lo if seq_end is None else _c(seq_end).cast("bigint")
    return F.struct(F.lit(channel).alias("channel"), lo.alias("seq"), hi.alias("seq_end"))


def rooted(channel: str, seq, seq_end=None) -> Column:
    """One branch that starts at a message, or at a range of messages."""
    return F.array(F.struct(hop(channel, seq, seq_end).alias("root"), F.array().cast(f"array<{HOP}>").alias("hops")))


def add_hop(lineage, channel: str, seq, seq_end=None) -> Column:
    """Append a hop to every branch."""
    new = F.array(hop(channel, seq, seq_end))
    return F.transform(_c(lineage), lambda b: F.struct(b["root"].alias("root"), F.concat(b["hops"], new).alias("hops")))


def merge(lineage, other) -> Column:
    """``lineage`` with each branch of ``other``, in order.

    A branch whose root channel is there already replaces that branch if it has more
    hops; a new one is appended while there is room.
    """

    def add(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda b: b["root"]["channel"] == x["root"]["channel"])
        longer = F.transform(
            acc, lambda b: F.when((b["root"]["channel"] == x["root"]["channel"]) & (F.size(x["hops"]) > F.size(b["hops"])), x).otherwise(b)
        )
        return F.when(known, longer).when(F.size(acc) < MAX_BRANCHES, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(_c(other), F.coalesce(_c(lineage), F.array().cast(LINEAGE)), add)


def describe(lineage) -> Column:
    """``a#1 -> x#1 | b#5 -> j#0``; a range of messages is ``imu#102..#121``."""

    def text(h: Column) -> Column:
        tail = F.when(h["seq_end"] != h["seq"], F.concat(F.lit("..#"), h["seq_end"].cast("string"))).otherwise(F.lit(""))
        return F.concat(h["channel"], F.lit("#"), h["seq"].cast("string"), tail)

    return F.array_join(
        F.transform(_c(lineage), lambda b: F.array_join(F.concat(F.array(text(b["root"])), F.transform(b["hops"], text)), " -> ")), " | "
    )


def root(lineage) -> Column:
    """The first branch's root hop; null for an empty lineage."""
    return F.get(_c(lineage), F.lit(0))["root"]


def hops(lineage) -> Column:
    return F.get(_c(lineage), F.lit(0))["hops"]


def own_hop(lineage) -> Column:
    """The hop of the message itself: the first branch's last hop, or its root."""
    return F.coalesce(F.try_element_at(hops(lineage), F.lit(-1)), root(lineage))


def input_hop(lineage) -> Column:
    """The hop before the message itself: the first branch's second to last, or its root."""
    return F.coalesce(F.try_element_at(hops(lineage), F.lit(-2)), root(lineage))


def trace(rows: DataFrame, lineage: str = "lineage") -> DataFrame:
    """``branch, step, channel, seq, seq_end`` of every hop, beside the other columns; steps count from the root."""
    rest = [c for c in rows.columns if c != lineage]
    b = rows.select(*rest, F.posexplode(lineage).alias("branch", "_b"))
    path = F.concat(F.array(F.col("_b.root")), F.col("_b.hops"))
    return b.select(*rest, "branch", F.posexplode(path).alias("step", "_h")).select(*rest, "branch", "step", "_h.*")


def forward(rows: DataFrame, channel: str, seq: int, lineage: str = "lineage") -> DataFrame:
    """The rows that derive from one message."""
    held = lambda h: (h["channel"] == channel) & (h["seq"] <= seq) & (h["seq_end"] >= seq)
    return rows.filter(F.exists(lineage, lambda b: held(b["root"]) | F.exists(b["hops"], held)))
