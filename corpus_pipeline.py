"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All
carry further columns along, whatever they are called, and an empty table through.
More than ``langid.LANGUAGES`` distinct languages or ``mixing.SOURCES`` distinct sources
raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import table, unused, written
from weirflow.llm.exact_dedup import distinct_texts
from weirflow.llm.langid import fit, held_out, keep_identified
from weirflow.llm.mixing import mix_sources
from weirflow.llm.near_dedup import near_dedup
from weirflow.llm.packing import pack_in_order
from weirflow.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or with hardly any n-gram of a learned language.

    Null and empty texts go, as they have no letter; rows without ``lang`` or ``doc_id`` are judged but
    not learned from. Repeated rows are judged alike.
    """
    return keep_identified(docs, fit(docs.filter(~held_out(F.col("doc_id")))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of those with equal texts, that with the smallest id (of equal ids, with the smallest other columns).

    A null text equals an empty one; a null id comes after all others.
    """
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Texts without words, and rows without id, are linked with nothing and stay. Rows with the same id are one
    document.
    """
    gone = near_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Put the documents into the order of the mixture, across and inside the files.

    A null source is the source of the empty string; rows that are equal in every column follow one another.
    """
    place = unused("place", docs.columns)
    placed = mix_sources(docs, weights=weights, keep_columns=True, place_col=place)
    return placed.repartitionByRange(place).sortWithinPartitions(place).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences that follow the mixture; one row a piece.

    A null or empty text is its end token alone; a very long one is cut into pieces.
    """
    return pack_in_order(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: The learned language model and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
