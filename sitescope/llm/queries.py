"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.llm import (ann, bpe, chat, debruijn, langid, line_dedup, packing, quality, resample, search, simhash,
                           suffix_dedup, toxicity)
from sitescope.llm.common import table

RANKS = 'byte_bpe_multi_50k.tiktoken'
WORDS_FILE = 'word_bpe_49k.json'


def in_fold(modulus: int, remainder: int, id_col: str = 'doc_id') -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; never for a null id."""
    left = F.pmod(F.crc32(F.col(id_col).cast('string').cast('binary')), F.lit(modulus))
    return F.coalesce(left == remainder, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, 'documents')
    return bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, 'documents'))
    return docs.select('doc_id', 'n_lines', 'n_removed_lines', F.md5('text').alias('text_md5'))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, 'conversations').select('conv_id', 'turn', 'role', 'text')
    probe = spark.createDataFrame([(-7, 0, 'user', chat.PROBE), (-7, 1, 'assistant', chat.PROBE)],
                                  'conv_id long, turn long, role string, text string')
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, 'documents'), public_tokenizers.path(WORDS_FILE)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, 'documents'))
    return spans.select(F.col('id').alias('doc_id'), F.col('start').alias('span_start'), F.col('stop').alias('span_end'))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, 'embeddings'))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, 'documents'))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, 'documents'), table(spark, sf_dir, 'labels')
    model = toxicity.fit(docs, labels.where(~in_fold(5, 0)))
    scored = docs.select('doc_id', in_fold(5, 0).alias('held_out'), toxicity.score(docs, model).alias('score'))
    return scored.withColumn('predicted', (F.col('score') >= 0.5).cast('int'))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, 'documents')
    model = langid.fit(docs.where(~in_fold(4, 2)))
    found = langid.predict(docs, model, reject=False)
    return found.select('doc_id', in_fold(4, 2).alias('held_out'), 'lang_pred', 'score', 'rejected')


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, 'documents'), shingle=4, distance=4)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, 'documents'), table(spark, sf_dir, 'benchmark'), keep=['doc_id'])
    return drawn.select('doc_id', 'n_features', 'weight', 'score', 'rank')


def op12_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = debruijn.dedup_substrings(table(spark, sf_dir, 'documents'), keep=['doc_id'])
    return cut.select('doc_id', 'n_words', 'n_removed', 'kept_sha256')


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, 'documents'), table(spark, sf_dir, 'benchmark'))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bpe, op2_line_dedup, op3_chat_format, op4_best_fit_packing, op5_suffix_dedup, op6_nearest_vectors,
    op7_quality_rules, op8_toxicity, op9_language_id, op10_simhash, op11_importance_resampling, op12_debruijn_dedup, op13_lexical_search)}

ORACLE: dict[str, str] = {
    'op2_line_dedup': line_dedup.ORACLE,
    'op3_chat_format': chat.ORACLE,
    'op5_suffix_dedup': suffix_dedup.ORACLE,
    'op7_quality_rules': quality.ORACLE,
    'op11_importance_resampling': resample.ORACLE,
    'op12_debruijn_dedup': debruijn.ORACLE,
    'op13_lexical_search': search.ORACLE,
}
