"""A corpus pipeline of five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import linededup, mixing, nearcopies, packing, toxicity
from sondage.llm._io import Scratch
from sondage.llm.queries import vocabulary
from sondage.session import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.3 or more go. Learns from the labelled rows among its input.

    Null and empty texts score what the bias says, repeated rows are judged each, rows without an id are no training rows;
    an empty table, or one without labels of both kinds, learns nothing and keeps all rows.
    """
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts lose lines that an earlier document holds; n_chars follows.

    Every row stays; null texts become empty ones; rows that repeat an id are one document, those without an id one after all
    others; an empty table gives no rows.
    """
    prepare(spark)
    kept = linededup.dedup_lines(docs).selectExpr(*(f"cast(length(text) as {t}) as n_chars" if c == "n_chars" else f"`{c}`" for c, t in docs.dtypes))
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, and what its radius does not reach: of texts that its links (fingerprints within 4 bits) or pairs with similarity
    0.8 of five-word shingles join, the smallest id stays.

    Texts without words are copies of each other, and of rows that repeat an id one stays; a null id comes last; an empty
    table gives no rows.
    """
    prepare(spark)
    return nearcopies.drop_near_copies(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row per copy that the mix takes, cut where it ends within a document.

    Texts without words are never taken; null sources are one source; repeated rows are documents of their own; an empty table
    gives no rows.
    """
    prepare(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces in sequences of at most 2048 ids. Null and empty texts are pieces of one id, repeated rows are packed
    each, an empty table gives no rows.
    """
    prepare(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", drop_near_copies), ("mix_sources", mix_sources), ("packing", pack)]

#: Fingerprints and the fitted model cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(prepare(spark), "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
