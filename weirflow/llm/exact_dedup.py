"""Exact deduplication by 128-bit content hash with byte comparison.

Rows are grouped by the MD5 of their text; per group the surviving id, the size and
the least and greatest text are aggregated. Least equal to greatest proves that all
texts of the group have the same bytes, so no pair is ever formed, and the partial
aggregates collapse a hot group inside each map task. Groups in which they differ
are hash collisions and are grouped once more by hash and whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hash_of=content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names the id of a group that stays, ``smallest`` or ``largest``. A null
    text counts as empty, and empty texts equal one another. A null id never wins
    against another id; a group of null ids keeps them all (``keep_id`` null). Rows
    repeated with the same id and text count in ``group_size`` and are all reported
    kept if their id stays. Other columns are ignored; an empty table gives an empty
    result. ``hash_of`` may be replaced, as a test does to force collisions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("h", hash_of(F.col("text")))
    groups = written(
        d.groupBy("h")
        .agg(
            best("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("text").alias("lo"),
            F.max("text").alias("hi"),
        )
        .select("h", "keep_id", "group_size", (F.col("lo") != F.col("hi")).alias("mixed")),
        "groups",
    )

    def result(rows: DataFrame) -> DataFrame:
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.sha2(F.col("text"), 256).alias("text_sha256") if "text" in rows.columns else F.col("text_sha256"),
        )

    sound = groups.filter(~F.col("mixed")).drop("mixed")
    slim = d.select("doc_id", "h", F.sha2(F.col("text"), 256).alias("text_sha256"))
    out = result(slim.join(sound, "h"))
    collided = groups.filter("mixed").select("h")
    if collided.isEmpty():
        return out
    suspects = d.join(collided, "h", "left_semi")
    texts = suspects.groupBy("h", "text").agg(
        best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return out.unionByName(result(suspects.join(texts, ["h", "text"])))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns kept.

    Of rows with equal texts the one with the smallest id stays (of equal ids, that with
    the smallest other columns); a null id comes after all others. A null text counts as
    empty; if the row that stays has a null text it stays null. Rows are grouped by hash
    and whole text, so the bytes decide, and are combined before the shuffle.
    """
    h, t = unused("_h", docs.columns), unused("_t", docs.columns)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    flags = [F.col(f"`{id_col}`").isNull().alias("_0"), F.col(f"`{id_col}`").alias("_1"), F.col(f"`{text_col}`").isNull().alias("_2")]
    columns = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)]
    # maps have no order; they are carried along
    ordered = [c for c, f in zip(columns, rest, strict=True) if not re.search("map<|variant", f.dataType.simpleString())]
    row = F.min_by(F.struct(flags[2], *columns), F.struct(*flags, *ordered))
    first = docs.select("*", content_hash(text).alias(h), text.alias(t)).groupBy(h, t).agg(row.alias("row"))
    own = {f.name: F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(rest)}
    own[text_col] = F.when(~F.col("row._2"), F.col(t)).alias(text_col)
    return first.select(*[own[c] for c in docs.columns])
