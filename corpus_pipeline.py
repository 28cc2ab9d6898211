"""Corpus preparation in five stages, each written to the shared folder and read again.

Defined cases of all stages: an empty table gives an empty result of the same columns;
extra columns stay, whatever their names, up to the last stage; very long texts are taken
whole; null ids are ids like any other but for the last place that they take among near
copies. What a stage does with null and empty texts, ties and repeated rows is said at
each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotlattice.llm import decontaminate, jaccard, pieces, pii, quality
from spotlattice.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the threshold table rejects (operator 1).

    Null and empty texts have no words and go; repeated rows are judged alike.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies (operator 9).

    Of rows with that id the one whose text has the least hash stays, of rows with equal id and text
    the one whose other columns have the least hash; different texts that share an id are
    different documents. Texts without words all stay.
    """
    return jaccard.keep_one(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item (operator 6).

    Null and empty texts hold none and stay, as do all if there are no items; repeated rows are judged alike.
    """
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts (operator 8).

    Null texts stay null; ``n_chars`` is the new length; repeated rows are treated alike. Where the
    documents hold no span to learn from, the base patterns alone are used.
    """
    return pii.redact(docs, pii.fit(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; per document doc_id, n_tokens, ids_crc32, round_trip and ids (operator 7).

    Null texts count as empty and have no ids; every row gives one row, repeated ones too.
    """
    return pieces.encode(docs, pieces.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the trained tagger nor the encoder; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
