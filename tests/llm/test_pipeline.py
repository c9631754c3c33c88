"""The corpus pipeline, stage by stage against brute force."""

import hashlib

import corpus_pipeline
import duckdb
from test_llm_operators import SMALL, brute_classes, brute_spans, words

from sitescope.llm import line_dedup, suffix_dedup, toxicity
from sitescope.session import ensure_checkpoint_dir, ship_package


def read(df):
    return sorted((r.doc_id, r.text) for r in df.select('doc_id', 'text').collect())


def test_stages(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ['toxicity', 'line dedup', 'SimHash near-dedup', 'suffix-array dedup', 'best-fit packing']
    docs = spark.read.parquet(f'{SMALL}/documents.parquet')
    step = stages['toxicity'](spark, docs, SMALL).cache()
    model = toxicity.fit(docs, spark.read.parquet(f'{SMALL}/labels.parquet'))
    odds = toxicity.log_odds([t for _, t in read(docs)], model.bucket_scores()) + model.offset()
    assert read(step) == [r for r, z in zip(read(docs), odds) if z < 0]
    assert step.columns == docs.columns

    before = read(step)
    sql = duckdb.connect()
    sql.register('documents', step.toPandas())
    want = {r[0]: r[3] for r in sql.sql(line_dedup.ORACLE).fetchall()}
    step = stages['line dedup'](spark, step, SMALL).cache()
    assert {i: hashlib.md5(t.encode()).hexdigest() for i, t in read(step)} == want and len(before) == step.count()

    before = read(step)
    step = stages['SimHash near-dedup'](spark, step, SMALL).cache()
    assert [r[0] for r in read(step)] == sorted(i for i, _, c in brute_classes(before) if i == c)

    before = read(step)
    step = stages['suffix-array dedup'](spark, step, SMALL).cache()
    texts = {i: words(t) for i, t in before}
    for i, a, b in sorted(brute_spans(before), reverse=True):
        del texts[i][a:b]
    assert {i: words(t) for i, t in read(step)} == texts
    changed = {i for i, _, _ in brute_spans(before)}
    assert [r for r in read(step) if r[0] not in changed] == [r for r in before if r[0] not in changed]

    packed = stages['best-fit packing'](spark, step, SMALL).toPandas()
    assert set(packed.doc_id) == set(texts) and packed.groupby('sequence_id').length.sum().max() <= 2048


def test_run_equals_the_stages(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.count() > 0 and 'sequence_id' in packed.columns
    assert suffix_dedup.LENGTH == 50


def test_cut_spans_keeps_white_space():
    text = 'a  b\n c\td e '
    assert suffix_dedup.cut_spans(text, [{'start': 1, 'stop': 3}]) == 'a  d e '
    assert suffix_dedup.cut_spans(text, [{'start': 0, 'stop': 5}]) == ''
