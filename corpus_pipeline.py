"""A corpus pipeline over ``documents``: language, exact copies, near copies, source mix, token pieces.

Every stage takes whole texts of any length, columns of any further name, repeated
rows and empty tables (which give empty tables).  What NULLs and ties give stands
at each stage; columns stay as they are up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm.exact_dedup import drop_exact_copies
from seriesmill.llm.jaccard_join import drop_similar
from seriesmill.llm.language import drop_unidentified
from seriesmill.llm.mixing import take_mix
from seriesmill.llm.pieces import round_trip
from seriesmill.llm.queries import PIECES
from seriesmill.session import checkpoint_folder, read_table


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts in a language that the network knows.

    NULL, empty texts and texts without a letter go; NULL languages are not learned
    from; identifiers and sources play no part beyond the fold of a row.
    """
    return drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text, the one with the smallest identifier.

    NULL and empty texts are one text; a NULL identifier stays only where a text has
    no other; of rows that repeat identifier and text one stays.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that links on five-word shingles at a similarity of 0.8, the one with the smallest identifier.

    Texts without words and rows without identifier link with nothing and stay.
    """
    return drop_similar(docs, size=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    NULL sources are one source, the last; texts without words have size 0 and add
    nothing to the mix.
    """
    return take_mix(docs)


def token_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of every text and the digest of what they decode to; NULL texts have 0 pieces and a NULL digest."""
    return round_trip(docs, PIECES)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("token_pieces", token_pieces),
]

#: The language network and the piece machine have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    place = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
