"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept.

All stages take empty tables and give empty ones; columns other than those of ``documents`` are not handed on.  What a stage
does with null and empty texts, rows without an id and repeated rows stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import decontaminate, langid, lines, packing, simhash
from auditspark.llm.common import learns, stored
from auditspark.llm.queries import TOKENIZER, table


#: Share of letters times certainty, in parts of what an equal mixture of all languages would have.
LEAST_SHARE = 0.8


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Texts that are null, empty or without letters go, and those in which no language stands out by ``LEAST_SHARE``.  Rows
    without an id are judged alike; repeated rows stay or go together.
    """
    model = langid.learn(docs, learns(F.col("doc_id")))
    found = langid.identify(docs, model)
    least = LEAST_SHARE / max(1, len(model.languages))
    return _documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one of the smallest id; ``n_chars`` follows the text.

    A null text becomes an empty one; every row stays, without an id or repeated ones too.
    """
    cleaned = lines.dedup_lines(docs)
    return _documents(cleaned.withColumn("n_chars", F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; a group without any id stays as it is.

    Null, empty and blank texts are one group.  Repeated rows of the document that stays all stay.
    """
    return _documents(simhash.keep_one(docs, drop_unnamed=True, shingle=3, max_bits=3))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts hold none.  Repeated rows stay or go together."""
    return _documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences.

    A null or empty text is a piece of one token, the end of the document; every repeated row has pieces of its own.
    """
    packed = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), checksum=True)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language prediction, fingerprints and packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = docs if number == len(STAGES) else stored(docs)
    return docs
