"""Corpus pipeline: raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from sitescope.llm.common import materialise, table

COLUMNS = ['doc_id', 'text', 'lang', 'source', 'n_chars']
WORDS_FILE = 'word_bpe_49k.json'

#: No SQL: a trained classifier and fingerprints decide; tests hold every stage against brute force.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return docs.select('doc_id', 'text', 'lang', 'source',
                       F.coalesce(F.char_length('text').cast('long'), F.col('n_chars')).alias('n_chars'))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, 'labels'))
    return _documents(docs.where(toxicity.score(docs, model) < 0.5))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; a copy becomes empty."""
    return _documents(line_dedup.dedup_lines(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the smallest id."""
    return _documents(simhash.keep_first(docs, shingle=4, distance=4))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur earlier."""
    return _documents(suffix_dedup.dedup_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path(WORDS_FILE)))


STAGES = [('toxicity', drop_toxic), ('line dedup', dedup_lines), ('SimHash near-dedup', dedup_near),
          ('suffix-array dedup', dedup_passages), ('best-fit packing', pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, 'documents').select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
