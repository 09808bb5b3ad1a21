"""From raw documents to packed training sequences: five stages, each by one training-data operator.

Every stage gets (spark, docs, sf_dir) with the columns of documents and returns a DataFrame, which is written as Parquet and read
again before the next stage. Each one works on all rows that its predecessor kept; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import jaccard, langid, mixing, packing, quality_crf
from lintlake.llm.common import cut, held_out, whole_row
from lintlake.llm.queries import tokenizer_path


def _held(docs: DataFrame) -> DataFrame:
    """(doc, text): the row as it came in a struct, where no column of an operator can replace one of it."""
    return docs.select(F.struct(*whole_row(docs)).alias("doc"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language that the bank knows; learned from the rows' own lang, as in the query of operator 1.

    Null texts, texts without a letter and texts of which the bank knows under half of the trigrams go. Without a row that has a
    text and a lang nothing is known, and all go. Repeated rows stay or go together; ids may be null or repeat.
    """
    bank = langid.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(_held(docs), bank).where(langid.identified()).select("doc.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line model predicts to be good; learned from labels.quality, as in the query of operator 6.

    Null and empty texts are one empty line and get its score. With labels of one kind only all rows stay or go alike; without
    any all stay. Repeated rows stay or go together; ids may be null or repeat.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_crf.fit(docs.where(~held_out(F.col("doc_id"), 5, 0)), labels)
    return quality_crf.score(_held(docs), model, threshold=0.3).where("predicted = 1").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints of operator 10 and MinHash bands propose, the sets decide. The row with the smallest id stays (null last). Null,
    empty and white-space texts are one group; rows that share an id, or have none, are grouped by their texts like any others.
    """
    return jaccard.keep_one(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by source weights; a row that is taken twice is there twice.

    Texts without a word have size 0 and stay with their source's decision; null is a source like any other, the last one.
    The hash of the id decides: rows that share an id, or have none, go together.
    """
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, most=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset. Null and empty texts are one end token; repeated rows are packed once each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned models and fingerprints have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
